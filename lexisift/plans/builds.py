"""Reports on builds, test runs and package restores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import basename, if_any, is_blank, project_name, severity, severity_text, source_path, trim, truncate, whole_number
from ..operators.ordered import RUN, carried, ranked, top_k
from ..sources.captures import merged, text_lines
from ..tables import once
from .report import raw_tail, rows, titled, together

# The grammars of the lines that carry a meaning. Classes of characters are those of Unicode.
DIAGNOSTIC = r"(?U)^([^\r\n(]+)\((\d+),(\d+)\):\s*(error|warning)\s+([A-Za-z]*\d*)\s*:\s*([^\[]+?)(\[[^\]]*\])?\s*$"
TOOL_DIAGNOSTIC = r"(?U)^(.+?)\s*:\s*(error|warning)\s+([A-Za-z]*\d+)\s*:\s*(.+)$"
PROJECT = r"(?U)^\s+(.+?)\s+->\s+"
ELAPSED = r"(?U)Time Elapsed\s+(\S+)"
TEST_TOTALS = r"(?U)(?:Passed|Failed)!\s+-\s+Failed:\s*(\d+),\s*Passed:\s*(\d+),\s*Skipped:\s*(\d+),\s*Total:\s*(\d+)"
FAILED_TEST = r"(?U)^\s+Failed\s+(.+?)(?:\s+\[\S+\])?\s*$"
PACKAGE_WARNING = r"(?U)warning NU\d{4}"
TOOL_ERROR = r"(?U)^.+?\s*:\s*error\s+[A-Za-z]*\d+\s*:"
VULNERABILITY_CODES = ["NU1901", "NU1902", "NU1903", "NU1904"]


def diagnostics(lines: DataFrame) -> DataFrame:
    """Lines with ``class`` (placed, tool, project, elapsed or null, the first that fits) and a diagnostic's fields."""
    line = F.col("line")
    kind = F.when(line.rlike(DIAGNOSTIC), "placed").when(line.rlike(TOOL_DIAGNOSTIC), "tool").when(line.rlike(PROJECT), "project").when(line.rlike(ELAPSED), "elapsed")
    got = lambda pattern, i: F.regexp_extract("line", pattern, i)
    placed, tool = F.col("class") == "placed", F.col("class") == "tool"
    pick = lambda a, b: F.when(placed, a).when(tool, b)
    out = lines.withColumn("class", kind).select(
        "source_id", "line_no", "line", "class",
        pick(source_path(trim(got(DIAGNOSTIC, 1))), trim(got(TOOL_DIAGNOSTIC, 1))).alias("file"),
        pick(whole_number(got(DIAGNOSTIC, 2)), F.lit(0)).alias("at_line"),
        pick(whole_number(got(DIAGNOSTIC, 3)), F.lit(0)).alias("at_column"),
        pick(got(DIAGNOSTIC, 4), got(TOOL_DIAGNOSTIC, 2)).alias("kind"),
        pick(got(DIAGNOSTIC, 5), got(TOOL_DIAGNOSTIC, 3)).alias("code"),
        pick(trim(got(DIAGNOSTIC, 6)), trim(got(TOOL_DIAGNOSTIC, 4))).alias("message"),
        pick(project_name(got(DIAGNOSTIC, 7)), F.lit("")).alias("project"),
        F.when(F.col("class") == "project", F.lower(trim(got(PROJECT, 1)))).alias("built"),
        F.when(F.col("class") == "elapsed", got(ELAPSED, 1)).alias("elapsed"),
    )
    vulnerable = F.col("code").isin(VULNERABILITY_CODES) | ((F.col("code") == "") & F.col("message").contains("severity vulnerability"))
    return out.withColumn("vulnerable", F.coalesce(vulnerable, F.lit(False)))


def diagnostic_groups(found: DataFrame, files: int = 3) -> DataFrame:
    """(source_id, kind, key, n, first, code, message, n_files, files): by code, or by the message without one, in order of sight."""
    key = F.when(F.col("code") == "", F.substring("message", 1, 80)).otherwise(F.col("code"))
    used = found.where(F.col("kind").isNotNull() & ~F.col("vulnerable")).withColumn("key", key).withColumn("name", basename("file"))
    by = ["source_id", "kind", "key"]
    groups = used.groupBy(*by).agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.min_by("code", "line_no").alias("code"), F.min_by("message", "line_no").alias("message"))
    names = used.where("name <> ''").groupBy(*by, "name").agg(F.min("line_no").alias("seen"))
    n_files = names.groupBy(*by).agg(F.count("*").alias("n_files"))
    few = top_k(names, by, ["seen", "name"], files).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("few"))
    joined = groups.join(n_files, by, "left").join(few, by, "left")
    return joined.withColumn("files", F.transform("few", lambda x: x["name"])).withColumn("n_files", F.coalesce("n_files", F.lit(0))).drop("few")


def group_text(files: int = 3):
    """One group as a line: alone with its file, or counted with a few."""
    code = F.when(F.col("code") == "", "").otherwise(F.concat(F.lit(" "), "code"))
    message = truncate("message", 140)
    more = F.when(F.col("n_files") > files, F.concat(F.lit(" +"), (F.col("n_files") - files).cast("string"))).otherwise("")
    listed = F.when(F.col("n_files") == 0, "").otherwise(F.concat(F.lit(" ["), F.array_join("files", ", "), more, F.lit("]")))
    one = F.concat(F.when(F.col("n_files") > 0, F.concat(F.element_at("files", 1), F.lit(" "))).otherwise(""), "kind", code, F.lit(": "), message)
    many = F.concat("kind", code, F.lit(" (x"), F.col("n").cast("string"), F.lit("): "), message, listed)
    return F.concat(F.lit("  "), F.when(F.col("n") == 1, one).otherwise(many))


def vulnerabilities(found: DataFrame) -> DataFrame:
    """(source_id, kind, package, version, low, moderate, high, critical, total, first), errors and warnings apart."""
    package = F.regexp_extract("message", r"Package '([^']+)'", 1)
    version = F.regexp_extract("message", r"^.*?' ([^ ]+) ", 1)
    used = found.where("vulnerable").select("source_id", "kind", "line_no", package.alias("package"), version.alias("version"), severity("message").alias("severity"))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("low", "moderate", "high", "critical")]
    return used.groupBy("source_id", "kind", "package", "version").agg(*counts, F.count("*").alias("total"), F.min("line_no").alias("first"))


def build_report(captures: DataFrame, detail: str = "default") -> DataFrame:
    base = merged(captures)
    lines = text_lines(base)
    found = once(diagnostics(lines).where("class is not null").drop("line"))
    real = F.col("kind").isNotNull() & ~F.col("vulnerable")
    sums = found.groupBy("source_id").agg(
        F.countDistinct("built").alias("p"), F.count_if(real & (F.col("kind") == "error")).alias("e"), F.count_if(real & (F.col("kind") == "warning")).alias("w"),
        F.count_if("vulnerable").alias("nu"), F.max_by("elapsed", F.when(F.col("elapsed").isNotNull(), F.col("line_no"))).alias("t"),
    )
    totals = once(base.select("source_id", "exit_code").join(sums, "source_id", "left").fillna(0, ["p", "e", "w", "nu"]))
    failed = F.col("exit_code") != 0
    some = failed | (F.col("e") + F.col("w") + F.col("nu") > 0)
    counts = F.when(some, F.concat(F.lit(" e="), F.col("e").cast("string"), F.lit(" w="), F.col("w").cast("string"), if_any(F.col("nu"), "nu"))).otherwise("")
    head = F.concat(F.when(failed, "FAIL").otherwise("ok"), F.lit(" build p="), F.col("p").cast("string"), counts, F.coalesce(F.concat(F.lit(" t="), "t"), F.lit("")))
    groups = once(ranked(diagnostic_groups(found), ["source_id", "kind"], ["first"]))
    errors, warnings = groups.where("kind = 'error' and rank <= 20"), groups.where("kind = 'warning' and rank <= 15")
    weak = ranked(vulnerabilities(found), ["source_id"], [F.col("kind") != "error", "first"])
    text = F.concat(F.lit("  "), "package", F.lit(" "), "version", F.lit(": "), F.col("total").cast("string"), F.lit(" ("), severity_text(F.col("low"), F.col("moderate"), F.col("high"), F.col("critical")), F.lit(")"))
    return together(
        rows(totals, "head", 0, head, n=F.col("e") + F.col("w")),
        raw_tail(lines, totals.where(failed & (F.col("e") + F.col("w") == 0)), 1),
        titled(errors, "errors", 2, "---", "Errors:"),
        rows(errors, "errors", 2, group_text(), F.col("rank"), F.col("key"), F.col("n")),
        titled(warnings, "warnings", 3, "Warnings:"),
        rows(warnings, "warnings", 3, group_text(), F.col("rank"), F.col("key"), F.col("n")),
        titled(weak, "vulnerabilities", 4, "NuGet Vulnerabilities:"),
        rows(weak, "vulnerabilities", 4, text, F.col("rank"), F.concat("package", F.lit("@"), "version"), F.col("total")),
    )


def test_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``class`` (totals, failed, detail or null), ``owner`` (the line of the failed test a detail belongs to) and ``name``.

    A failed test's details are lines of four blanks or more, until a blank line or totals.
    """
    line = F.col("line")
    opened = F.when(line.rlike(TEST_TOTALS), "totals").when(line.rlike(FAILED_TEST), "failed")
    mark = F.when(F.col("class").isNotNull(), F.col("class")).when(is_blank("line"), "blank")
    marked = carried(lines.withColumn("class", opened), F.when(mark.isNotNull(), F.struct(mark.alias("kind"), F.col("line_no").alias("at"))), ["source_id"], "line_no", "last", RUN)
    is_detail = F.col("class").isNull() & (F.col("last.kind") == "failed") & line.startswith("    ") & ~is_blank("line")
    return marked.select(
        "source_id", "line_no", "line", F.when(is_detail, "detail").otherwise(F.col("class")).alias("class"),
        F.when(is_detail, F.col("last.at")).alias("owner"), F.when(F.col("class") == "failed", trim(F.regexp_extract("line", FAILED_TEST, 1))).alias("name"),
    )


def test_report(captures: DataFrame, detail: str = "default") -> DataFrame:
    base = merged(captures)
    lines = text_lines(base)
    seen = F.col("class").isNotNull() | F.col("line").rlike(ELAPSED)
    found = once(test_lines(lines).where(seen))
    is_totals = F.col("class") == "totals"
    total = lambda i: F.coalesce(F.sum(F.when(is_totals, whole_number(F.regexp_extract("line", TEST_TOTALS, i)))), F.lit(0))
    elapsed = F.when(F.col("class").isNull() & F.col("line").rlike(ELAPSED), F.regexp_extract("line", ELAPSED, 1))
    sums = found.withColumn("elapsed", elapsed).groupBy("source_id").agg(
        total(2).alias("passed"), total(1).alias("failed"), total(3).alias("skipped"), total(4).alias("total"), F.count_if(is_totals).alias("p"),
        F.count_if(F.col("class") == "failed").alias("named"), F.max_by("elapsed", F.when(F.col("elapsed").isNotNull(), F.col("line_no"))).alias("t"),
    )
    sums = once(base.select("source_id", "exit_code").join(sums, "source_id", "left").fillna(0, ["passed", "failed", "skipped", "total", "p", "named"]))
    broke = F.col("exit_code") != 0
    bad = broke | (F.col("failed") > 0) | (F.col("named") > 0)
    nothing = (F.col("total") == 0) & (F.col("named") == 0)
    passed = F.concat(F.lit(" test pass="), F.col("passed").cast("string"))
    counts = F.when(nothing & broke, " test e=1").when(nothing, " test").when(bad, F.concat(passed, F.lit(" fail="), F.col("failed").cast("string"), if_any(F.col("skipped"), "skip"))).otherwise(F.concat(passed, if_any(F.col("skipped"), "skip")))
    head = F.concat(F.when(bad, "FAIL").otherwise("ok"), counts, if_any(F.col("p"), "p"), F.coalesce(F.concat(F.lit(" t="), "t"), F.lit("")))
    named = ranked(found.where("class = 'failed'"), ["source_id"], ["line_no"])
    few = named.where("rank <= 15")
    details = top_k(found.where("class = 'detail'"), ["source_id", "owner"], ["line_no"], 5, "place").select("source_id", F.col("owner").alias("at"), "place", "line")
    inner = few.select("source_id", F.col("line_no").alias("at"), "rank").join(details, ["source_id", "at"])
    more = sums.where("named > 15")
    return together(
        rows(sums, "head", 0, head, n=F.col("failed")),
        raw_tail(lines, sums.where(broke & (F.col("named") == 0)), 1),
        titled(named, "failed", 2, "---", "Failed:"),
        rows(few, "failed", 2, F.concat(F.lit("  "), "name"), F.col("rank") * 10, F.col("name")),
        rows(inner, "failed", 2, F.concat(F.lit("    "), truncate(trim("line"), 200)), F.col("rank") * 10 + F.col("place")),
        rows(more, "failed", 2, F.concat(F.lit("  ... +"), (F.col("named") - 15).cast("string"), F.lit(" more")), 1000, n=F.col("named") - 15),
    )


def restore_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``class``, the first that fits."""
    line, plain = F.col("line"), F.regexp_replace("line", r"(?U)^\s+", "")
    noise = plain.startswith("Determining projects") | plain.startswith("Nothing to do") | line.contains("Microsoft (R) Build Engine") | line.contains("Copyright (C) Microsoft")
    kind = (
        F.when(is_blank("line"), "blank").when(noise, "noise").when(plain.startswith("All projects are up-to-date"), "current").when(line.rlike(r"(?U)Restored\s+"), "restored")
        .when(line.rlike(ELAPSED), "elapsed").when(line.contains("severity vulnerability") | line.rlike(PACKAGE_WARNING), "warning").when(line.contains(": error ") | line.rlike(TOOL_ERROR), "error")
    )
    return lines.withColumn("class", kind)


def without_project(line):
    """A warning without the project in brackets at its end."""
    return F.when(trim(line).rlike(r"(?s)^.+\[[^\[]*\]$"), F.regexp_replace(trim(line), r"(?Us)\s*\[[^\[]*$", "")).otherwise(trim(line))


def restore_report(captures: DataFrame, detail: str = "default") -> DataFrame:
    base = merged(captures)
    lines = text_lines(base)
    found = once(restore_lines(lines).where("class is not null and class not in ('blank', 'noise')"))
    elapsed = F.when(F.col("class") == "elapsed", F.regexp_extract("line", ELAPSED, 1))
    of = lambda kind: F.count_if(F.coalesce(F.col("class") == kind, F.lit(False)))
    sums = found.withColumn("t", elapsed).groupBy("source_id").agg(
        of("restored").alias("p"), of("current").alias("up"), of("error").alias("e"), of("warning").alias("nu"), F.max_by("t", F.when(F.col("t").isNotNull(), F.col("line_no"))).alias("t")
    )
    sums = once(base.select("source_id", "exit_code").join(sums, "source_id", "left").fillna(0, ["p", "up", "e", "nu"]))
    ok = F.col("exit_code") == 0
    restored = F.concat(F.lit("p="), F.col("p").cast("string"))
    calm = ok & (F.col("e") == 0) & (F.col("nu") == 0)
    counts = F.when(calm & (F.col("up") > 0), "up=1").when(calm, restored).otherwise(F.concat(restored, if_any(F.col("e"), "e"), if_any(F.col("nu"), "nu")))
    head = F.concat(F.when(ok, "ok").otherwise("FAIL"), F.lit(" restore "), counts, F.coalesce(F.concat(F.lit(" t="), "t"), F.lit("")))
    errors = top_k(found.where("class = 'error'"), ["source_id"], ["line_no"], 10)
    warned = found.where("class = 'warning'").select("source_id", "line_no", without_project(F.col("line")).alias("key")).groupBy("source_id", "key").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    warnings = top_k(warned, ["source_id"], ["first"], 8)
    return together(
        rows(sums, "head", 0, head, n=F.col("p")),
        titled(errors, "errors", 1, "Errors:"),
        rows(errors, "errors", 1, F.concat(F.lit("  "), trim("line")), F.col("rank"), trim("line")),
        raw_tail(lines, sums.where(~ok & (F.col("e") == 0)), 2),
        titled(warnings, "vulnerabilities", 3, "NuGet Vulnerabilities:"),
        rows(warnings, "vulnerabilities", 3, F.concat(F.lit("  "), "key", F.when(F.col("n") > 1, F.concat(F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise("")), F.col("rank"), F.col("key"), F.col("n")),
    )
