"""Reports on search hits and path listings, and the search itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import compact, if_any, is_blank, kind_of, kind_rank, top_group, trim, truncate, whole_number
from ..operators.ordered import ranked
from ..operators.paths import common_depth, without_directories
from ..sources.captures import merged, text_lines
from ..tables import once
from .report import blank_raw, by_detail, joined_top, rows, titled, together, unchanged

# Fixed value: the grammar of a hit with its line number.
HIT = r"(?U)^(.+?):(\d+):(.*)$"
NUMBERED_HIT = r"^([^:]*):([^:]*):(.*)$"


def contains_text(line: Column | str, query: str) -> Column:
    """Whether the line holds the query as it stands, whatever its case if the query has no capital."""
    line = F.col(line) if isinstance(line, str) else line
    if all(not c.isalpha() or c.islower() for c in query):
        return F.lower(line).contains(query.lower())
    return line.contains(query)


def search_lines(lines: DataFrame, query: str, most: int | None = None) -> DataFrame:
    """(file, hit_line, content) of lines (source_id, line_no, line) with the query; ``most``: only the first so many."""
    if not query.strip():
        raise ValueError("query is required")
    hits = lines.where(contains_text("line", query)).select(F.col("source_id").alias("file"), F.col("line_no").alias("hit_line"), F.col("line").alias("content"))
    return hits if most is None else hits.orderBy("file", "hit_line").limit(most)


def parsed_hits(lines: DataFrame) -> DataFrame:
    """(source_id, line_no, binary, file, hit_line, content) of hits in any of the usual forms; other lines go.

    Tried in this order: a note on a binary file, ``file:line:content``, ``file:content`` (a drive's colon does not
    part), a bare path.
    """
    line = F.col("line")
    binary = line.startswith("Binary file ") & line.endswith(" matches")
    drive = line.rlike(r"^\p{L}:")
    of = lambda i: F.when(drive, F.regexp_extract(line, r"^(\p{L}:[^:]*):(.*)$", i)).otherwise(F.regexp_extract(line, r"^([^:]*):(.*)$", i))
    has = F.when(drive, line.rlike(r"^\p{L}:[^:]*:")).otherwise(line.rlike(r"^[^:]*:")) & ~is_blank(of(1))
    bare = line.contains("/") | line.contains("\\")
    kind = F.when(binary, "binary").when(line.rlike(HIT), "numbered").when(has, "plain").when(bare, "bare")
    found = lines.where(~is_blank("line")).withColumn("class", kind).where("class is not null")
    numbered, content = F.col("class") == "numbered", F.col("class") == "plain"
    return found.select(
        "source_id", "line_no", (F.col("class") == "binary").alias("binary"),
        F.when(numbered, F.regexp_extract("line", HIT, 1)).when(content, of(1)).when(F.col("class") == "bare", F.col("line")).alias("file"),
        F.when(numbered, whole_number(F.regexp_extract("line", HIT, 2))).otherwise(0).alias("hit_line"),
        F.when(numbered, F.regexp_extract("line", HIT, 3)).when(content, of(2)).otherwise("").alias("content"),
    )


def stripped(hits: DataFrame, name: str = "file") -> DataFrame:
    """Hits with ``path``: the file without the directories that all files of a source share."""
    depth = common_depth(hits.select("source_id", name).distinct(), ["source_id"], name)
    return hits.join(depth, "source_id").withColumn("path", without_directories(name, "depth")).drop("depth")


def grep_report(captures: DataFrame, detail: str = "default", tool: str = "grep") -> DataFrame:
    most = by_detail(detail, 3, 6)
    base = merged(captures)
    parsed = once(parsed_hits(text_lines(base)))
    some = parsed.groupBy("source_id").agg(F.count_if("binary").alias("bin"), F.count_if(~F.col("binary")).alias("m"))
    empty = base.where(blank_raw() & (F.col("exit_code") <= 1))
    odd = base.join(some, "source_id", "left_anti").where(~(blank_raw() & (F.col("exit_code") <= 1)))
    hits = stripped(parsed.where(~F.col("binary")))
    files = once(ranked(hits.groupBy("source_id", "path").agg(F.count("*").alias("n")), ["source_id"], [F.desc("n"), "path"]))
    f = files.groupBy("source_id").agg(F.count("*").alias("f"))
    sums = some.join(f, "source_id", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    head = F.concat(F.lit(f"{tool} m="), F.col("m").cast("string"), F.lit(" f="), F.col("f").cast("string"), if_any(F.col("bin"), "bin"))
    item = F.concat("path", F.lit("("), F.col("n").cast("string"), F.lit(")"))
    said = hits.where(~is_blank("content")).withColumn("text", trim("content"))
    grouped = once(said.groupBy("source_id", "text").agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.min_by(F.struct("path", "hit_line"), "line_no").alias("at")))
    samples = ranked(grouped, ["source_id"], [F.desc("n"), "first"]).where(F.col("rank") <= most)
    at = F.concat("at.path", F.when(F.col("at.hit_line") > 0, F.concat(F.lit(":"), F.col("at.hit_line").cast("string"))).otherwise(""))
    paths = files.join(grouped.select("source_id").distinct(), "source_id", "left_anti").where(F.col("rank") <= most)
    parts = [
        rows(empty, "head", 0, f"{tool} m=0 f=0", n=0),
        unchanged(odd),
        rows(sums, "head", 0, head, n=F.col("m")),
        rows(joined_top(files, item, most), "top", 1, F.concat(F.lit("top="), "top")),
        titled(samples, "samples", 2, "samples:"),
        rows(samples, "samples", 2, F.concat(F.lit("  "), at, F.lit(" "), truncate("text", 120)), F.col("rank"), F.col("text"), F.col("n")),
        titled(paths, "paths", 3, "paths:"),
        rows(paths, "paths", 3, F.concat(F.lit("  "), "path"), F.col("rank"), F.col("path"), F.col("n")),
        rows(sums.where(F.col("f") > most), "more", 5, F.concat(F.lit("+"), (F.col("f") - most).cast("string"), F.lit(" more files")), n=F.col("f") - most),
    ]
    if detail == "more":
        rest = joined_top(files.where(F.col("rank") > most), item, 2 * most)
        parts.append(rows(rest, "list", 4, F.concat(F.lit("more="), "top")))
    return together(*parts)


def find_report(captures: DataFrame, detail: str = "default") -> DataFrame:
    most, groups = by_detail(detail, 5, 20), by_detail(detail, 3, 6)
    base = merged(captures)
    line = F.col("line")
    lines = text_lines(base.where(~blank_raw())).where(~is_blank("line")).withColumn("error", line.startswith("find:") | line.contains("Permission denied"))
    sums = lines.groupBy("source_id").agg(F.count_if(~F.col("error")).alias("n"), F.count_if("error").alias("err"))
    paths = once(stripped(lines.where(~F.col("error")).select("source_id", "line_no", F.col("line").alias("file"))))
    grouped = ranked(paths.groupBy("source_id", top_group("path").alias("group")).agg(F.count("*").alias("n")), ["source_id"], [F.desc("n"), "group"])
    listed = ranked(paths, ["source_id"], ["line_no"]).where(F.col("rank") <= most)
    return together(
        rows(base.where(blank_raw() & (F.col("exit_code") == 0)), "head", 0, "find n=0", n=0),
        unchanged(base.where(blank_raw() & (F.col("exit_code") != 0))),
        rows(sums, "head", 0, F.concat(F.lit("find n="), F.col("n").cast("string"), if_any(F.col("err"), "err")), n=F.col("n")),
        rows(joined_top(grouped, F.concat("group", F.lit("("), F.col("n").cast("string"), F.lit(")")), groups), "top", 1, F.concat(F.lit("top="), "top")),
        titled(listed, "paths", 2, "paths:"),
        rows(listed, "paths", 2, F.concat(F.lit("  "), "path"), F.col("rank"), F.col("path")),
        rows(sums.where(F.col("n") > most), "more", 3, F.concat(F.lit("+"), (F.col("n") - most).cast("string"), F.lit(" more paths")), n=F.col("n") - most),
    )


def numbered_hits(captures: DataFrame) -> DataFrame:
    """(source_id, file, hit_line, content) of ``file:line:content``, parted at the first two colons; other lines go."""
    lines = text_lines(merged(captures))
    hit_line = F.regexp_extract("line", NUMBERED_HIT, 2).try_cast("int")
    return lines.where(F.col("line").rlike(NUMBERED_HIT)).select("source_id", "line_no", F.regexp_extract("line", NUMBERED_HIT, 1).alias("file"), hit_line.alias("hit_line"), F.regexp_extract("line", NUMBERED_HIT, 3).alias("content")).where("hit_line is not null")


def focus_files(hits: DataFrame, scope: str = "default") -> DataFrame:
    """(source_id, path, kind, n, hit_line, sample, rank) of the files of a scope, with the first hit of each."""
    grouped = stripped(hits).groupBy("source_id", "path").agg(F.count("*").alias("n"), F.min_by(F.struct("hit_line", "content"), F.struct("hit_line", "line_no")).alias("at"))
    files = grouped.select("source_id", "path", kind_of("path").alias("kind"), "n", F.col("at.hit_line").alias("hit_line"), compact("at.content").alias("sample"))
    seen = files if scope in ("default", "all") else files.where(F.col("kind") == scope)
    return ranked(seen, ["source_id"], [kind_rank("kind", scope), F.desc("n"), "path"])


def focus_report(captures: DataFrame, detail: str = "default", scope: str = "default", files_only: bool = False) -> DataFrame:
    """Captured hits by file: code first, with samples. ``scope``: default, all, docs or code."""
    base = merged(captures)
    if detail == "raw":
        return unchanged(base)
    return focus_rows(base, numbered_hits(captures.where("coalesce(exit_code, 0) <= 1")), detail, scope, files_only)


def search_report(hits: DataFrame, source: str, detail: str = "default", scope: str = "default", files_only: bool = False) -> tuple[DataFrame, int]:
    """The same of what a search found in files (file, hit_line, content), and 0, or 1 where that is nothing."""
    found = hits.select(F.lit(source).alias("source_id"), F.xxhash64("file").alias("line_no"), "file", "hit_line", "content")
    exit_code = 1 if found.isEmpty() else 0
    if detail == "raw":  # a source for each file, so that no task orders all hits
        own = found.withColumn("source_id", F.col("file"))
        return rows(own, "raw", 0, F.concat("file", F.lit(":"), F.col("hit_line").cast("string"), F.lit(":"), "content"), F.col("hit_line")), exit_code
    base = hits.sparkSession.createDataFrame([(source, exit_code, "")], "source_id string, exit_code int, raw string")
    return focus_rows(base, found, detail, scope, files_only), exit_code


def focus_rows(base: DataFrame, hits: DataFrame, detail: str, scope: str, files_only: bool) -> DataFrame:
    """The report of ``base`` (source_id, exit_code, raw) and its hits (source_id, line_no, file, hit_line, content)."""
    if scope not in ("default", "all", "docs", "code"):
        raise ValueError("scope is default, all, docs or code")
    most, docs_most, samples_most = by_detail(detail, 5, 8), by_detail(detail, 2, 4), by_detail(detail, 3, 6)
    broken = base.where("exit_code > 1")
    hits = once(hits)
    files = once(focus_files(hits, scope))
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    sums = files.groupBy("source_id").agg(F.count("*").alias("f"), F.sum("n").alias("m"), of("code"), of("docs"), of("logs"), of("other"))
    name = "focus" + ("" if scope == "default" else f" {scope}")
    raw_kinds = hits.withColumn("kind", kind_of("file"))
    visible = (raw_kinds if scope in ("default", "all") else raw_kinds.where(F.col("kind") == scope)).groupBy("source_id").agg(F.count("*").alias("visible"))
    told = sums.join(visible, "source_id", "left").withColumn("visible", F.coalesce("visible", F.lit(0)))
    counts = F.concat(F.lit(f"{name} m="), F.col("visible").cast("string"), F.lit(" f="), F.col("f").cast("string"))
    if scope in ("default", "all"):
        for k in ("code", "docs", "logs"):
            counts = F.concat(counts, F.lit(f" {k}="), F.col(k).cast("string"))
        counts = F.concat(counts, if_any(F.col("other"), "other"))
    item = F.concat("path", F.lit("("), F.col("n").cast("string"), F.lit(")"))
    parts = [unchanged(broken), rows(base.where("exit_code <= 1").join(sums, "source_id", "left_anti"), "head", 0, f"{name} m=0 f=0", n=0), rows(told, "head", 0, counts, n=F.col("visible"))]
    if scope == "default":
        code = files.where("kind = 'code'").drop("rank")
        other = files.join(code.select("source_id").distinct(), "source_id", "left_anti").drop("rank")
        lead = ranked(code, ["source_id"], [F.desc("n"), "path"]).withColumn("label", F.lit("code")).unionByName(ranked(other, ["source_id"], [kind_rank("kind"), F.desc("n"), "path"]).withColumn("label", F.lit("top")))
        shown = lead.where(F.col("rank") <= most)
        labels = shown.groupBy("source_id").agg(F.min("label").alias("label"))
        parts.append(rows(joined_top(shown, item, most).join(labels, "source_id"), "top", 1, F.concat("label", F.lit("="), "top")))
        if detail == "more":
            docs = ranked(files.where("kind = 'docs'").drop("rank"), ["source_id"], [F.desc("n"), "path"]).where(F.col("rank") <= docs_most)
            parts.append(rows(joined_top(docs, item, docs_most), "docs", 2, F.concat(F.lit("docs="), "top")))
            shown = shown.select("source_id", "path").unionByName(docs.select("source_id", "path")).distinct()
    else:
        shown = files.where(F.col("rank") <= most)
        parts.append(rows(joined_top(shown, item, most), "top", 1, F.concat(F.lit("top="), "top")))
    if not files_only:
        kept = ranked(files.drop("rank").join(shown.select("source_id", "path"), ["source_id", "path"], "left_semi"), ["source_id"], [kind_rank("kind", scope), F.desc("n"), "path"]).where(F.col("rank") <= samples_most)
        parts += [titled(kept, "samples", 3, "samples:"), rows(kept, "samples", 3, F.concat(F.lit("  "), "path", F.lit(":"), F.col("hit_line").cast("string"), F.lit(" "), "sample"), F.col("rank"), F.col("path"), F.col("n"))]
    rest = sums.join(shown.groupBy("source_id").agg(F.count("*").alias("shown")), "source_id").withColumn("extra", F.col("f") - F.col("shown")).where("extra > 0")
    parts.append(rows(rest, "more", 4, F.concat(F.lit("+"), F.col("extra").cast("string"), F.lit(" more files")), n=F.col("extra")))
    return together(*parts)
