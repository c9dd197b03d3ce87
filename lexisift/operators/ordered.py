"""Operators in which the order of lines carries meaning. Order is a column; ties are broken by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.text import is_blank
from ..tables import once


#: Lines of one text that reports number or fill in one task.
RUN = 1 << 17


def in_order(by: list[str], order: list[str | Column]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)


def so_far(by: list[str], order: list[str]) -> WindowSpec:
    return in_order(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _in_runs(lines: DataFrame, by: list[str], order: str, run: int, value: Column, total: Callable[[DataFrame], Column]) -> DataFrame:
    """Lines with ``_value``, the number ``_run`` of the run of ``run`` places that each is in, and ``_before``: ``total`` of the values in the runs before.

    Only a row for each run is ordered within a group, so a group of any length is dealt over tasks.
    """
    keyed = lines.withColumn("_value", value).withColumn("_run", F.floor(F.col(order) / run))
    sums = keyed.groupBy(*by, "_run").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("last"), F.count("_value").alias("n"))
    earlier = in_order(by, ["_run"]).rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(sums.select(*by, "_run", total(sums).over(earlier).alias("_before")), [*by, "_run"])


def records(lines: DataFrame, is_header: Column, by: list[str], order: str, name: str = "record", run: int | None = None) -> DataFrame:
    """Lines with the number of the record that the last header began; lines before the first header go.

    ``run``: so many places of a numeric order go to a task at most.
    """
    return counted(lines, is_header, by, order, name, run).where(F.col(name) > 0)


def counted(lines: DataFrame, test: Column, by: list[str], order: str, name: str, run: int | None = None) -> DataFrame:
    """Lines with how many so far pass the test, their own among them; ``run`` as in ``records``."""
    if run is None:
        return lines.withColumn(name, F.count_if(F.coalesce(test, F.lit(False))).over(so_far(by, [order])))
    dealt = _in_runs(lines, by, order, run, F.when(test, 1), lambda sums: F.sum(sums["n"]))
    own = F.count("_value").over(so_far([*by, "_run"], [order]))
    return dealt.withColumn(name, own + F.coalesce("_before", F.lit(0))).drop("_value", "_run", "_before")


def two_levels(lines: DataFrame, outer: Column, inner: Column, by: list[str], order: str, names: tuple[str, str], run: int) -> DataFrame:
    """Lines with the number of the outer header so far and, from 0 anew after each, of the inner one; lines before the first outer header go.

    Lines are dealt once, by runs of ``run`` places of a numeric order, and counted there; of each run a row says how
    many headers it has and how many inner ones stand before its last outer one.
    """
    w = so_far([*by, "_run"], [order])
    keyed = lines.withColumn("_outer", F.coalesce(outer, F.lit(False))).withColumn("_inner", F.coalesce(inner, F.lit(False))).withColumn("_run", F.floor(F.col(order) / run))
    within = keyed.withColumn("_f", F.count_if("_outer").over(w)).withColumn("_h", F.count_if("_inner").over(w))
    within = within.withColumn("_s", F.last(F.when(F.col("_outer"), F.col("_h")), ignorenulls=True).over(w))
    sums = within.groupBy(*by, "_run").agg(F.max("_f").alias("f"), F.max("_h").alias("h"), F.max("_s").alias("s"))
    earlier = in_order(by, ["_run"]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = sums.select(*by, "_run", "s", before("f").alias("_f0"), before("h").alias("_h0"))
    starts = starts.select(*by, "_run", "_f0", "_h0", F.last(F.col("s") + F.col("_h0"), ignorenulls=True).over(earlier).alias("_s0"))
    told = within.join(starts, [*by, "_run"])
    number = F.col("_h") + F.col("_h0") - F.coalesce(F.col("_s") + F.col("_h0"), F.col("_s0"))
    out = told.withColumn(names[0], F.col("_f") + F.col("_f0")).withColumn(names[1], number).where(F.col(names[0]) > 0)
    return out.drop("_outer", "_inner", "_run", "_f", "_h", "_s", "_f0", "_h0", "_s0")


def carried(lines: DataFrame, value: Column, by: list[str], order: str, name: str, run: int | None = None) -> DataFrame:
    """Lines with the last ``value`` that was not null; ``run`` as in ``records``."""
    if run is None:
        return lines.withColumn(name, F.last(value, ignorenulls=True).over(so_far(by, [order])))
    dealt = _in_runs(lines, by, order, run, value, lambda sums: F.last(sums["last"], ignorenulls=True))
    own = F.last("_value", ignorenulls=True).over(so_far([*by, "_run"], [order]))
    return dealt.withColumn(name, F.coalesce(own, "_before")).drop("_value", "_run", "_before")


def first_seen_groups(rows: DataFrame, by: list[str], key: str, order: str, *firsts: str) -> DataFrame:
    """Count, first place and first values of each key; sums and minima only, so a hot key is added up where it lies."""
    picked = [F.min_by(c, order).alias(c) for c in firsts]
    return rows.groupBy(*by, key).agg(F.count("*").alias("n"), F.min(order).alias("first"), *picked)


def deduplicated(rows: DataFrame, by: list[str], keys: list[Column], order: str, *kept: str) -> DataFrame:
    """The first row of each key with ``repeat_count``; its other columns come from that row as a whole."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    whole = F.min_by(F.struct(*kept), order).alias("whole")
    grouped = rows.select(*by, order, *kept, *named).groupBy(*by, *(f"k{i}" for i in range(len(keys)))).agg(F.count("*").alias("repeat_count"), F.min(order).alias(order), whole)
    return grouped.select(*by, order, "whole.*", "repeat_count")


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(in_order(by, order)))


def ranked_in_ranges(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``ranked`` of groups of any size: rows are dealt by ranges of the order and ranked in each, after the counts of those before.

    No task orders a whole group; the rows are written once, so that all see the same ranges. Columns of ``order``
    ascend, or are given as ``desc``.
    """
    dealt = once(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    earlier = in_order(by, ["_range"]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    starts = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = ranked(dealt, [*by, "_range"], order, name).join(starts, [*by, "_range"])
    return own.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_range", "_before")


def top_k(rows: DataFrame, by: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` of each group with their rank; Spark cuts before it shuffles."""
    return ranked(rows, by, order, name).where(F.col(name) <= k)


def last_n(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` of each group; all for ``n`` of 0 or less."""
    return rows if n <= 0 else ranked(rows, by, [F.desc(order)], "_back").where(F.col("_back") <= n).drop("_back")


def tail_lines(lines: DataFrame, n: int = 12) -> DataFrame:
    """(source_id, rank, line): the last ``n`` lines that are not blank, in order."""
    kept = last_n(lines.where(~is_blank("line")), ["source_id"], "line_no", n)
    return ranked(kept, ["source_id"], ["line_no"])


def head_and_tail(lines: DataFrame, most: int = 5, head: int = 3, tail: int = 2) -> DataFrame:
    """(source_id, rank, line, omitted): up to ``most`` lines as they are, else the first, a mark and the last.

    The mark is the row whose ``omitted`` is above 0.
    """
    sizes = lines.groupBy("source_id").agg(F.count("*").alias("total"))
    # both ends are cut where the lines lie, before they are shuffled
    first = top_k(lines, ["source_id"], ["line_no"], most).join(sizes, "source_id").where((F.col("total") <= most) | (F.col("rank") <= head))
    last = ranked(lines, ["source_id"], [F.desc("line_no")], "_back").where(F.col("_back") <= tail).join(sizes.where(F.col("total") > most), "source_id")
    none = F.lit(0).cast("long").alias("omitted")
    plain = first.select("source_id", "rank", "line", none).unionByName(last.select("source_id", (head + tail + 2 - F.col("_back")).alias("rank"), "line", none))
    omitted = F.col("total") - (head + tail)
    mark = sizes.where(F.col("total") > most)
    return plain.unionByName(mark.select("source_id", F.lit(head + 1).alias("rank"), F.concat(F.lit("... ("), omitted.cast("string"), F.lit(" lines omitted)")).alias("line"), omitted.alias("omitted")))


def budgeted(rows: DataFrame, by: list[str], order: list[str], unit: str, most_units: int, most_rows: int) -> DataFrame:
    """Rows under a budget of units and rows: a unit starts while fewer of both came before it, rows then fill up.

    ``unit`` numbers the units of a group in the order from 1; rows with a null ``row_in_unit`` open their unit
    and do not count as rows.
    """
    counted = F.when(F.col("row_in_unit").isNull(), 0).otherwise(1)
    running = rows.withColumn("_rows", F.sum(counted).over(so_far(by, order)))
    opening = F.max(F.when(F.col("row_in_unit").isNull(), F.col("_rows"))).over(Window.partitionBy(*by, unit))
    return running.withColumn("_before", opening).where((F.col(unit) <= most_units) & (F.col("_before") < most_rows) & (F.col("_rows") <= most_rows)).drop("_rows", "_before")


def with_range_end(marks: DataFrame, by: list[str], order: str = "line_no", total: str = "total") -> DataFrame:
    """Marks with ``range_end``: the place before the next mark, or the last place of the whole."""
    after = F.lead(order).over(in_order(by, [order]))
    return marks.withColumn("range_end", F.least(F.greatest(F.col(order), F.coalesce(after, F.col(total) + 1) - 1), F.col(total)))
