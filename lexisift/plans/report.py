"""What all reports share. A report's rows are (source_id, section, part, rank, key, n, detail).

``part`` orders a source's sections and ``rank`` the rows of one; ``detail`` is the row as a line of text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank
from ..operators.ordered import tail_lines

DETAILS = ("default", "more", "raw")


def by_detail(detail: str, default: int, more: int, raw: int | None = None) -> int:
    """A limit by level of detail."""
    if detail not in DETAILS:
        raise ValueError(f"detail is one of {', '.join(DETAILS)}")
    return {"default": default, "more": more, "raw": more if raw is None else raw}[detail]


def _as(value: Column | str | int | None, kind: str) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(kind)


def rows(frame: DataFrame, section: str, part: int, detail: Column | str, rank: Column | int = 0, key: Column | str | None = None, n: Column | int | None = None) -> DataFrame:
    return frame.select(
        "source_id", F.lit(section).alias("section"), F.lit(part).alias("part"), _as(rank, "int").alias("rank"), _as(key, "string").alias("key"), _as(n, "long").alias("n"), _as(detail, "string").alias("detail")
    )


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def titled(frame: DataFrame, section: str, part: int, *titles: str) -> DataFrame:
    """The titles of a section, above its rows, for each source that has some."""
    some = frame.select("source_id").distinct()
    return together(*(rows(some, section, part, t, i - len(titles)) for i, t in enumerate(titles)))


def raw_tail(lines: DataFrame, sources: DataFrame, part: int) -> DataFrame:
    """The last lines of those sources, under a title."""
    kept = tail_lines(lines.join(sources.select("source_id"), "source_id", "left_semi"))
    return together(titled(kept, "tail", part, "--- raw tail ---"), rows(kept, "tail", part, F.concat(F.lit("  "), F.regexp_replace("line", r"(?U)\s+$", "")), F.col("rank"), F.col("line")))


def unchanged(base: DataFrame) -> DataFrame:
    """The raw text as it is."""
    return rows(base, "raw", 0, F.col("raw"))


def blank_raw() -> Column:
    return is_blank("raw")


def joined_top(ranked: DataFrame, item: Column, k: int, sep: str = ",") -> DataFrame:
    """(source_id, top): the first ``k`` items by ``rank``, joined."""
    few = ranked.where(F.col("rank") <= k).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"))
    return few.select("source_id", F.array_join(F.transform("items", lambda x: x["item"]), sep).alias("top"))


def render(report: DataFrame) -> DataFrame:
    """(source_id, text): each source's lines in order."""
    each = report.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("part", "rank", "detail"))).alias("lines"))
    return each.select("source_id", F.array_join(F.transform("lines", lambda x: x["detail"]), "\n").alias("text"))


def write_reports(report: DataFrame, path: str) -> None:
    """Writes each source's report as text to ``path``/source_id=..., in parts that are the report one after the other, by name.

    Rows lie in order over tasks, so a report of any length is written in parts and none is held whole.
    """
    order = ["source_id", "part", "rank", "detail"]
    ordered = report.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("source_id", F.col("detail").alias("value")).write.partitionBy("source_id").text(path)


def rendered(report: DataFrame, captures: DataFrame) -> DataFrame:
    """(source_id, text, exit_code): each capture's report with the exit code that it came with."""
    codes = captures.select(F.col("capture_id").alias("source_id"), F.coalesce("exit_code", F.lit(0)).alias("exit_code"))
    return codes.join(render(report), "source_id", "left").select("source_id", F.coalesce("text", F.lit("")).alias("text"), "exit_code")
