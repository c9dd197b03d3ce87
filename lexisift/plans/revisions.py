"""Reports on version control: status, differences, commits, other commands, and changes as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import basename, branch_name, if_any, is_blank, trim, truncate
from ..operators.ordered import RUN, budgeted, carried, head_and_tail, in_order, ranked, records, top_k, two_levels
from ..sources.captures import merged, text_lines
from ..tables import once
from .report import blank_raw, by_detail, joined_top, rows, titled, together, unchanged

# The grammars of status codes, differences and commits.
STATUS_CODE = r"(?U)^(?:\?\?|!!|[ MARCUD][ MARCUD])\s"
DIFF_NAME = r"diff --git a/(.+?) b/"
HUNK = r"(?U)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
COMMIT = r"(?U)^commit[^\S\n]+([0-9a-f]{7,40})"
COMMIT_STARTS = r"(?U)\n(?=commit[^\S\n]+[0-9a-f]{7,40})"
MESSAGE = r"(?U)\n    (?!Co-Authored-By:)([^\S\n]*\S[^\n]*)"
DIFF_META = ["index ", "---", "+++", "old mode", "new mode", "new file", "deleted file", "similarity", "rename ", "copy "]
SECTIONS = [("Changes to be committed:", "staged"), ("Changes not staged", "modified"), ("Untracked files:", "untracked")]
MOST_COMMITS = 50


def status_entries(lines: DataFrame) -> DataFrame:
    """(source_id, line_no, section, path) of a status, short or long, whichever each source is in."""
    used = lines.where(~is_blank("line"))
    line = F.col("line")
    short = used.groupBy("source_id").agg((F.bool_or(line.startswith("## ")) | F.bool_and((F.length("line") >= 3) & line.rlike(STATUS_CODE))).alias("short"))
    told = used.join(short, "source_id")
    x, y = F.substring("line", 1, 1), F.substring("line", 2, 1)
    set_ = lambda c: ~c.isin(" ", "?")
    sections = F.when((x == "?") & (y == "?"), F.array(F.lit("untracked"))).otherwise(F.array_compact(F.array(F.when(set_(x), "staged"), F.when(set_(y), "modified"))))
    brief = told.where(F.col("short") & ~line.startswith("## ") & (F.length("line") >= 4)).select("source_id", "line_no", F.explode(sections).alias("section"), trim(F.substring("line", 4, 1 << 20)).alias("path")).where("path <> ''")
    title = F.lit(None).cast("string")
    for start, name in reversed(SECTIONS):
        title = F.when(line.startswith(start), name).otherwise(title)
    filled = carried(told.where(~F.col("short")), title, ["source_id"], "line_no", "section", RUN)
    long = filled.where(line.startswith("\t") & F.col("section").isNotNull()).select("source_id", "line_no", "section", trim("line").alias("path"))
    return brief.unionByName(long)


def status_report(captures: DataFrame, detail: str = "default") -> DataFrame:
    base = merged(captures)
    ok = base.where("exit_code = 0")
    lines = text_lines(ok)
    entries = once(status_entries(lines))
    of = lambda s: F.count_if(F.col("section") == s)
    counts = entries.groupBy("source_id").agg(of("staged").alias("st"), of("modified").alias("mod"), of("untracked").alias("untr"))
    line = F.col("line")
    named = F.when(line.startswith("## "), F.substring("line", 4, 1 << 20)).when(line.startswith("On branch "), F.substring("line", 11, 1 << 20))
    branch = lines.withColumn("b", named).where("b is not null").groupBy("source_id").agg(branch_name(trim(F.max_by("b", "line_no"))).alias("br"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = ok.select("source_id").join(counts, "source_id", "left").join(branch, "source_id", "left").select("source_id", "br", *(zero(c).alias(c) for c in ("st", "mod", "untr")))
    n = F.col("st") + F.col("mod") + F.col("untr")
    head = F.concat(F.when(n == 0, "ok status").otherwise("status"), F.lit(" st="), F.col("st").cast("string"), F.lit(" mod="), F.col("mod").cast("string"), F.lit(" untr="), F.col("untr").cast("string"), F.when(F.length("br") > 0, F.concat(F.lit(" br="), "br")).otherwise(""))
    place = F.when(F.col("section") == "staged", 1).when(F.col("section") == "modified", 2).otherwise(3)
    ordered = ranked(entries.withColumn("place", place), ["source_id"], ["place", "line_no"])
    top = joined_top(ordered, F.concat(F.substring("section", 1, 1), F.lit(":"), "path"), by_detail(detail, 5, 12))
    parts = [unchanged(base.where("exit_code <> 0")), rows(sums, "head", 0, head, n=n), rows(top, "top", 1, F.concat(F.lit("top="), "top"))]
    if detail == "more":
        for i, (_, section) in enumerate(SECTIONS):
            own = ordered.where(F.col("section") == section)
            parts += [titled(own, section, 2 + i, f"{section}:"), rows(own, section, 2 + i, F.concat(F.lit("  "), "path"), F.col("rank"), F.col("path"))]
    return together(*parts)


def diff_lines(lines: DataFrame, run: int = RUN) -> DataFrame:
    """Lines from the first file on with ``class``, and the numbers of their file and of the hunk in it, 0 before the first.

    ``run``: so many lines of a text go to a task at most, of one file or of several.
    """
    line = F.col("line")
    meta = F.lit(False)
    for start in DIFF_META:
        meta = meta | line.startswith(start)
    kind = (
        F.when(line.startswith("diff --git "), "file").when(line.startswith("Binary files "), "binary").when(line.startswith("@@"), "hunk")
        .when(line.startswith("new file"), "new").when(line.startswith("deleted file"), "deleted").when(meta, "meta").when(line.startswith("+"), "add").when(line.startswith("-"), "remove")
    )
    return two_levels(lines.withColumn("class", kind), F.col("class") == "file", F.col("class") == "hunk", ["source_id"], "line_no", ("file_no", "hunk_no"), run)


def diff_files(found: DataFrame) -> DataFrame:
    """(source_id, file_no, name, additions, deletions, is_binary, is_new, is_deleted, hunks)."""
    of = lambda kind: F.count_if(F.coalesce(F.col("class") == kind, F.lit(False)))
    whole = F.min_by("line", "line_no")
    return found.groupBy("source_id", "file_no").agg(whole.alias("line"), of("add").alias("additions"), of("remove").alias("deletions"), (of("binary") > 0).alias("is_binary"), (of("new") > 0).alias("is_new"), (of("deleted") > 0).alias("is_deleted"), of("hunk").alias("hunks")).select(
        "source_id", "file_no", F.when(F.col("line").rlike(DIFF_NAME), F.regexp_extract("line", DIFF_NAME, 1)).otherwise(F.col("line")).alias("name"), "additions", "deletions", "is_binary", "is_new", "is_deleted", "hunks"
    )


def diff_texts(texts: DataFrame, most_hunks: int, per_hunk: int) -> DataFrame:
    """``diff_files`` of whole texts (source_id, raw), and the start of each file: ``units`` of up to ``most_hunks`` hunks, a head and the first ``per_hunk`` lines changed.

    A text is parted where it lies, so nothing is shuffled or ordered; with parts of files go their numbers.
    """
    bare = lambda line: F.regexp_replace(line, r"\r+$", "")
    parts = texts.select("source_id", F.col("raw").startswith("diff --git ").cast("int").alias("first"), F.posexplode(F.split("raw", r"\n(?=diff --git )", -1)).alias("at", "text"))
    files = parts.select("source_id", (F.col("at") + F.col("first")).cast("long").alias("file_no"), "text", bare(F.substring_index("text", "\n", 1)).alias("line")).where("file_no > 0")
    of = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    has = lambda start: F.contains("text", F.lit(f"\n{start}"))
    changed = F.lit(r"\n((?:\+(?!\+\+)|-(?!--))[^\n]*)")
    unit = lambda hunk: F.struct(bare(F.substring_index(hunk, "\n", 1)).alias("head"), F.transform(F.slice(F.regexp_extract_all(hunk, changed, F.lit(1)), 1, per_hunk), bare).alias("changed"))
    return files.select(
        "source_id", "file_no", F.when(F.col("line").rlike(DIFF_NAME), F.regexp_extract("line", DIFF_NAME, 1)).otherwise(F.col("line")).alias("name"), of(r"\n\+(?!\+\+)").alias("additions"), of(r"\n-(?!--)").alias("deletions"),
        has("Binary files ").alias("is_binary"), has("new file").alias("is_new"), has("deleted file").alias("is_deleted"), of(r"\n@@").alias("hunks"), F.transform(F.slice(F.split("text", r"\n(?=@@)", -1), 2, most_hunks), unit).alias("units"),
    )


def hunk_text(name, line):
    """A hunk's head: the file's name and the range of new lines."""
    start, count = F.regexp_extract(line, HUNK, 3).try_cast("int"), F.coalesce(F.regexp_extract(line, HUNK, 4).try_cast("int"), F.lit(1))
    span = F.when(count <= 1, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), (start + count - 1).cast("string")))
    return F.concat(F.lit("@@ "), basename(name), F.when(line.rlike(HUNK), F.concat(F.lit(" "), span)).otherwise(""))


def diff_report(captures: DataFrame, detail: str = "default") -> DataFrame:
    top_files, shown_files = by_detail(detail, 3, 6), by_detail(detail, 3, 6)
    most_hunks, per_hunk, most_lines = by_detail(detail, 6, 14), by_detail(detail, 4, 8), by_detail(detail, 18, 42)
    base = merged(captures)
    ok = base.where("exit_code = 0")
    files = once(diff_texts(ok, most_hunks, per_hunk))
    largest = [F.desc(F.col("additions") + F.col("deletions")), "name", "file_no"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    sums = files.groupBy("source_id").agg(F.count("*").alias("f"), F.sum("additions").alias("a"), F.sum("deletions").alias("d"), F.count_if("is_binary").alias("bin"), F.sum("hunks").alias("hunks"), F.count_if(F.col("hunks") > 0).alias("with_hunks"))
    each = ok.select("source_id", blank_raw().alias("blank")).join(sums, "source_id", "left").select("source_id", "blank", *map(zero, ("f", "a", "d", "bin", "hunks", "with_hunks")))
    head = F.when(F.col("blank"), "ok diff f=0").otherwise(F.concat(F.lit("diff f="), F.col("f").cast("string"), F.lit(" +"), F.col("a").cast("string"), F.lit(" -"), F.col("d").cast("string"), if_any(F.col("bin"), "bin")))
    flags = F.concat_ws("|", F.when(F.col("is_new"), "*new"), F.when(F.col("is_deleted"), "del"), F.when(F.col("is_binary"), "bin"))
    item = F.concat(basename("name"), F.lit("(+"), F.col("additions").cast("string"), F.lit(" -"), F.col("deletions").cast("string"), F.lit(")"), F.when(flags != "", F.concat(F.lit("["), flags, F.lit("]"))).otherwise(""))
    top = joined_top(top_k(files, ["source_id"], largest, top_files), item, top_files)
    preview = top_k(files.where("hunks > 0"), ["source_id"], largest, shown_files, "place")
    # a hunk is no earlier a unit than its number in its file, so those past the budget of units never leave their text
    inside = preview.select("source_id", "place", "name", F.posexplode("units").alias("hunk_no", "in_hunk"))
    shown_lines = inside.select("source_id", "place", "name", "hunk_no", F.posexplode(F.concat(F.array("in_hunk.head"), "in_hunk.changed")).alias("line_no", "line"))
    unit = F.dense_rank().over(in_order(["source_id"], ["place", "hunk_no"]))
    numbered = shown_lines.withColumn("row_in_unit", F.when(F.col("line_no") > 0, F.col("line_no"))).withColumn("unit", unit)
    lines_ = budgeted(numbered, ["source_id"], ["place", "hunk_no", "line_no"], "unit", most_hunks, most_lines)
    text = F.when(F.col("row_in_unit").isNull(), hunk_text(F.col("name"), F.col("line"))).otherwise(truncate("line", 120))
    shown = once(ranked(lines_, ["source_id"], ["place", "hunk_no", "line_no"]))
    hunks_shown = shown.where("row_in_unit is null").groupBy("source_id").agg(F.count("*").alias("hunks_shown"))
    rest = each.join(hunks_shown, "source_id", "left").select("source_id", (F.col("f") - F.least("with_hunks", F.lit(shown_files))).alias("files"), (F.col("hunks") - F.coalesce("hunks_shown", F.lit(0))).alias("hunks"))
    some = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}")))
    return together(
        unchanged(base.where("exit_code <> 0")),
        rows(each, "head", 0, head, n=F.col("f")),
        rows(top, "top", 1, F.concat(F.lit("top="), "top")),
        rows(shown, "preview", 2, text, F.col("rank"), F.col("name")),
        rows(rest.where("files > 0 or hunks > 0"), "more", 3, F.concat(F.lit("+"), F.concat_ws(", ", some("files"), some("hunks")), F.lit(" more")), n=F.col("files")),
    )


def commits(lines: DataFrame) -> DataFrame:
    """(source_id, line_no, hash, author, date, message): message is the first line that has text, null for none."""
    line = F.col("line")
    own = records(lines, line.rlike(COMMIT), ["source_id"], "line_no", run=RUN)
    author = F.when(line.startswith("Author:"), trim(F.regexp_replace(F.substring("line", 8, 1 << 20), r"(?<=.)<.*$", "")))
    date = F.when(line.startswith("Date:"), trim(F.substring("line", 6, 1 << 20)))
    said = line.startswith("    ") & ~line.startswith("    Co-Authored-By:") & ~is_blank("line")
    return own.groupBy("source_id", "record").agg(
        F.min("line_no").alias("line_no"), F.substring(F.regexp_extract(F.min_by("line", "line_no"), COMMIT, 1), 1, 7).alias("hash"),
        F.max_by(author, F.when(author.isNotNull(), F.col("line_no"))).alias("author"), F.max_by(date, F.when(date.isNotNull(), F.col("line_no"))).alias("date"),
        F.min_by(F.when(said, trim("line")), F.when(said, F.col("line_no"))).alias("message"),
    ).drop("record")


def commit(text):
    """The hash and the message, as in ``commits``, of the text of one commit."""
    said = F.regexp_extract(text, MESSAGE, 1)
    return F.struct(F.substring(F.regexp_extract(text, COMMIT, 1), 1, 7).alias("hash"), F.when(said != "", trim(said)).alias("message"))


def log_report(captures: DataFrame, detail: str = "default") -> DataFrame:
    base = merged(captures)
    parsed = base.where((F.col("exit_code") == 0) & F.col("raw").startswith("commit "))
    # each text is parted into commits where it lies, and those that are not shown never leave it
    parts = F.filter(F.split("raw", COMMIT_STARTS, -1), lambda x: x.rlike(COMMIT))
    told = once(parsed.withColumn("parts", parts).select("source_id", F.size("parts").alias("n"), F.transform(F.slice("parts", 1, MOST_COMMITS), commit).alias("first")))
    found = told.select("source_id", F.posexplode("first").alias("at", "commit")).select("source_id", (F.col("at") + 1).alias("rank"), "commit.*")
    text = F.concat("hash", F.lit(" "), truncate(F.coalesce("message", F.lit("(no message)")), 100))
    more = told.where(F.col("n") > MOST_COMMITS)
    plain = base.where(~((F.col("exit_code") == 0) & F.col("raw").startswith("commit "))).unionByName(parsed.join(told.where("n = 0"), "source_id", "left_semi"))
    short = plain.where((F.col("exit_code") != 0) | blank_raw() | (F.size(F.split("raw", "\n", -1)) <= MOST_COMMITS))
    long = plain.join(short.select("source_id"), "source_id", "left_anti")
    parts = F.split("raw", "\n", -1)
    cut = F.concat(F.array_join(F.slice(parts, 1, MOST_COMMITS), "\n"), F.lit("\n... +"), (F.size(parts) - MOST_COMMITS).cast("string"), F.lit(" more lines"))
    return together(
        unchanged(short),
        rows(long, "raw", 0, cut),
        rows(found, "commits", 1, text, F.col("rank"), F.col("hash")),
        rows(more, "more", 2, F.concat(F.lit("... +"), (F.col("n") - MOST_COMMITS).cast("string"), F.lit(" more commits")), n=F.col("n") - MOST_COMMITS),
    )


def compact_report(captures: DataFrame, detail: str = "default") -> DataFrame:
    """The first three and last two lines of what other commands say."""
    base = merged(captures)
    used = text_lines(base).where(~is_blank("line"))
    size = used.groupBy("source_id").agg(F.count("*").alias("n"))
    sized = base.join(size, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cut = head_and_tail(used.join(size.where("n > 5"), "source_id", "left_semi"))
    return together(
        rows(sized.where("n = 0 and exit_code = 0"), "head", 0, "ok"),
        unchanged(sized.where("n <= 5 and not (n = 0 and exit_code = 0)")),
        rows(cut, "lines", 1, F.col("line"), F.col("rank"), n=F.when(F.col("omitted") > 0, F.col("omitted"))),
    )


def changes_report(status: DataFrame, diff: DataFrame, detail: str = "default") -> DataFrame:
    """A status and then a difference of the same sources; where the status fails it alone is told, where the difference fails that."""
    if detail == "raw":
        a, b = merged(status), merged(diff).select("source_id", F.col("raw").alias("more"), F.col("exit_code").alias("diff_exit"))
        both = a.join(b, "source_id", "left")
        bare = F.regexp_replace("raw", r"(?U)\s+$", "")
        text = F.when(F.col("exit_code") != 0, F.col("raw")).when(F.col("diff_exit") != 0, F.col("more")).when(is_blank(F.coalesce("more", F.lit(""))), bare).otherwise(F.concat(bare, F.lit("\n"), F.regexp_replace("more", r"(?U)\s+$", "")))
        return rows(both, "raw", 0, text)
    plain = merged(status).where("exit_code = 0").select(F.col("source_id").alias("capture_id"))
    broken = merged(diff).where("exit_code <> 0").join(plain.withColumnRenamed("capture_id", "source_id"), "source_id", "left_semi")
    first = status_report(status.join(broken.select(F.col("source_id").alias("capture_id")), "capture_id", "left_anti"), detail)
    second = diff_report(diff.join(plain, "capture_id", "left_semi"), detail).where("detail <> 'ok diff f=0'")
    return together(first.withColumn("section", F.concat(F.lit("status "), "section")), second.withColumn("section", F.concat(F.lit("diff "), "section")).withColumn("part", F.col("part") + 100))


