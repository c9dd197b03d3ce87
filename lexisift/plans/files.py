"""Reports on files and listings of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import basename, extension, file_score, is_blank, numbered, top_group, trim
from ..operators.ordered import ranked, ranked_in_ranges, top_k, with_range_end
from ..operators.paths import tree_rollup
from ..sources.files import included
from .report import by_detail, joined_top, rows, titled, together

# The grammars of symbols, in the order in which they are tried, with the group of the name.
SYMBOLS = [
    (r"^#{1,6}\s+(.+)$", 1),
    (r"\b(class|interface|record|struct|enum)\s+([A-Za-z_][A-Za-z0-9_]*)", 2),
    (r"^(?:public|private|protected|internal|static|sealed|partial|async|virtual|override|abstract|extern|new|\s)+[\w<>\[\],?.]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1),
    (r"^(?:async\s+)?(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", 1),
    (r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1),
    (r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\(", 1),
]
RANGE = re.compile(r"(.+):(\d+)(?:-(\d+))?")
SMALL_LINES, SMALL_CHARS, MOST_SYMBOLS = 40, 3000, 8


def symbol_name(line: Column | str) -> Column:
    """What a line declares, or null; classes of characters are those of Unicode."""
    bare = trim(line)
    out = F.lit(None).cast("string")
    for pattern, group in reversed(SYMBOLS):
        out = F.when(bare.rlike(f"(?U){pattern}"), trim(F.regexp_extract(bare, f"(?U){pattern}", group))).otherwise(out)
    return out


def symbols(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source_id, line, name, range_end, rank): what is declared where, and the line before the next or the last."""
    found = lines.withColumn("name", symbol_name("line")).where("name is not null").join(sizes, "source_id")
    return ranked(with_range_end(found, ["source_id"]).select("source_id", F.col("line_no").alias("line"), "name", "range_end"), ["source_id"], ["line"])


def parse_target(target: str, known: bool) -> tuple[str, int | None, int | None]:
    """A path, or a path with a line or a range of lines behind it if the whole is no known path."""
    m = None if known else RANGE.fullmatch(target)
    return (m[1], int(m[2]), int(m[3] or m[2])) if m else (target, None, None)


def file_card(lines: DataFrame, detail: str = "default", start: int | None = None, end: int | None = None, symbols_only: bool = False, binary: DataFrame | None = None) -> DataFrame:
    """Cards of files (source_id, line_no, line): whole if small, else symbols, ranges and a preview; or a range of lines.

    ``binary``: (source_id) of files that are not text.
    """
    sizes = lines.groupBy("source_id").agg(F.count("*").cast("int").alias("total"), F.sum(F.length("line")).alias("chars"))
    name = basename("source_id")
    count = F.concat(F.lit("view "), name, F.lit(" lines="), F.col("total").cast("string"))
    told = [] if binary is None else [rows(binary, "head", 0, F.concat(F.lit("view "), name, F.lit(" binary=1")))]
    if start is not None or end is not None:
        first = max(1, start or 1)
        last = F.least(F.col("total"), F.lit(max(first, end or 1 << 30) if end or start is None else first))
        head = F.concat(F.lit("view "), name, F.lit(f" {first}-"), last.cast("string"), F.lit("/"), F.col("total").cast("string"))
        part = lines.join(sizes, "source_id").where((F.col("line_no") >= first) & (F.col("line_no") <= last))
        return together(*told, rows(sizes, "head", 0, head, n=F.col("total")), rows(part, "lines", 1, numbered("line_no", "line"), F.col("line_no")))
    small = F.lit(detail == "raw") | (F.lit(not symbols_only) & (F.col("total") <= SMALL_LINES) & (F.col("chars") <= SMALL_CHARS))
    whole = lines.join(sizes.where(small).select("source_id"), "source_id", "left_semi")
    large = sizes.where(~small).select("source_id", "total")
    used = lines.join(large.select("source_id"), "source_id", "left_semi")
    found = symbols(used, large)
    listed = joined_top(found, F.concat("name", F.lit("("), F.col("line").cast("string"), F.lit(")")), MOST_SYMBOLS, ", ")
    hot = found.where(F.col("rank") <= by_detail(detail, 5, 8))
    text = F.concat(F.lit("  "), F.col("line").cast("string"), F.lit("-"), F.col("range_end").cast("string"), F.lit(" "), "name")
    out = [
        *told,
        rows(sizes, "head", 0, count, n=F.col("total")),
        rows(whole, "lines", 1, numbered("line_no", "line"), F.col("line_no")),
        rows(listed, "symbols", 2, F.concat(F.lit("symbols: "), "top")),
        titled(hot, "hot", 3, "hot:"),
        rows(hot, "hot", 3, text, F.col("rank"), F.col("name")),
    ]
    if not symbols_only:
        most = by_detail(detail, 12, 24)
        begin = used.groupBy("source_id").agg(F.min(F.when(~is_blank("line"), F.col("line_no"))).alias("text_at"))
        at = begin.join(found.groupBy("source_id").agg(F.min("line").alias("symbol_at")), "source_id", "left").select("source_id", F.coalesce("symbol_at", "text_at").alias("from")).where("from is not null")
        preview = used.join(at, "source_id").where((F.col("line_no") >= F.col("from")) & (F.col("line_no") < F.col("from") + most))
        out += [titled(preview, "preview", 4, "preview:"), rows(preview, "preview", 4, numbered("line_no", "line", "  "), F.col("line_no"))]
    return together(*out)


def files_report(files: DataFrame, detail: str = "default", code: bool = False, ext: str | None = None, top: int | None = None, changed: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """The inventory of files (source_id, path), paths relative: by first directory, and the likeliest entry points.

    ``changed``: the paths are those that a status named, so directories do not matter. Paths that end in a slash are
    directories and do not count. ``roots``: (source_id) of all sources, also of those without a path.
    """
    sources = (files if roots is None else roots).select("source_id").distinct()
    files = files.where(~F.endswith("path", F.lit("/")))
    most = max(1, top) if top is not None else by_detail(detail, 8, 20, 50)
    groups = 6 if detail == "more" else 3
    used = files.where(included("path", ignored=detail == "raw" or changed, code=code))
    ext = None if ext is None or not ext.strip() else ext if ext.startswith(".") else f".{ext}"
    if ext:
        used = used.where(F.lower(extension("path")) == ext.lower())
    counts = sources.join(used.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = F.concat(F.lit("files code n=" if code else "files n="), F.col("n").cast("string"), F.lit((f" ext={ext.lstrip('.')}" if ext else "") + (" changed=1" if changed else "")))
    grouped = ranked(used.groupBy("source_id", top_group("path", "root").alias("group")).agg(F.count("*").alias("n")), ["source_id"], [F.desc("n"), "group"])
    listed = top_k(used, ["source_id"], [file_score("path", code), "path"], most)
    return together(
        rows(counts, "head", 0, head, n=F.col("n")),
        rows(joined_top(grouped, F.concat("group", F.lit("("), F.col("n").cast("string"), F.lit(")")), groups), "top", 1, F.concat(F.lit("top="), "top")),
        titled(listed, "list", 2, "list:"),
        rows(listed, "list", 2, F.concat(F.lit("  "), "path"), F.col("rank"), F.col("path")),
        rows(counts.where(F.col("n") > most), "more", 3, F.concat(F.lit("+"), (F.col("n") - most).cast("string"), F.lit(" more files")), n=F.col("n") - most),
    )


def tree_depth(detail: str = "default", depth: int | None = None) -> int:
    return max(1, depth) if depth is not None else by_detail(detail, 2, 3, 5)


def tree_report(files: DataFrame, detail: str = "default", code: bool = False, show_all: bool = False, depth: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """The directories of files (source_id, path) down to a depth, each with what is below it.

    A path that ends in a slash is a directory, which may be empty. ``roots``: (source_id) of all sources.
    """
    most = tree_depth(detail, depth)
    used = files.where(included("path", ignored=detail == "raw" or show_all, code=code))
    nodes = tree_rollup(used, ["source_id"], "path", most, empty=not code)
    sums = (files if roots is None else roots).select("source_id").distinct().join(nodes.where("directory = ''"), "source_id", "left")
    head = F.concat(F.lit("tree code d=" if code else "tree d="), F.coalesce("n_dirs", F.lit(0)).cast("string"), F.lit(" f="), F.coalesce("n_files", F.lit(0)).cast("string"), F.lit(f" depth={most}"))
    below = nodes.where("directory <> ''").withColumn("order", F.split(F.lower("directory"), "/", -1))
    ordered = ranked_in_ranges(below, ["source_id"], [F.col("order"), F.col("directory")])
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.substring_index("directory", "/", -1), F.lit("/ d="), F.col("n_dirs").cast("string"), F.lit(" f="), F.col("n_files").cast("string"))
    shown = by_detail(detail, 5, 8, 12)
    own = top_k(used.where(~F.contains("path", F.lit("/"))), ["source_id"], [F.lower("path"), "path"], shown)
    return together(
        rows(sums, "head", 0, head, n=F.coalesce("n_files", F.lit(0))),
        rows(sums, "root", 1, F.concat(F.regexp_replace(basename(F.regexp_replace("source_id", "/+$", "")), "/+$", ""), F.lit("/"))),
        rows(ordered, "nodes", 2, text, F.col("rank"), F.col("directory"), F.col("n_files")),
        rows(joined_top(own, F.col("path"), shown), "files", 3, F.concat(F.lit("files="), "top")),
    )


def list_report(files: DataFrame) -> DataFrame:
    """What is directly below each source's root, directories with a slash, as a dictionary would order it.

    From the paths of files and, with a slash at their end, of directories.
    """
    deep = F.contains("path", F.lit("/"))
    name = F.when(deep, F.concat(F.substring_index("path", "/", 1), F.lit("/"))).otherwise(F.col("path"))
    each = files.select("source_id", name.alias("name")).distinct()
    ordered = ranked_in_ranges(each, ["source_id"], [F.expr("name collate unicode"), F.col("name")])
    return rows(ordered, "names", 0, F.col("name"), F.col("rank"), F.col("name"))
