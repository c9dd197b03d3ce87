"""Exact medians and median deviations over a sliding window of time, for each series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

from ..shipping import shipped
from .common import durable

#: A chunk of time is as long as so many windows, so that its halo, one window, is small beside it.
WINDOWS = 16
#: A window's length of one series with more events than this is cut into shorter chunks, down to 1 / 2**FINEST of it.
DENSE, FINEST = 1 << 17, 10
#: Rows that a task takes at a time, if no chunk holds more; nodes of all trees that it holds at once.
ROWS, NODES, LANES = 1 << 18, 1 << 24, 1024
#: Dense slots of time up to this number are broadcast, more are joined by a shuffle.
BROADCAST = 100_000


def _tree(lanes: int, size: int, rank: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Fenwick trees, one a lane and row, over the events ``lo`` to ``hi`` of each lane; column 0 stays 0."""
    tree = np.zeros((lanes, size + 1), dtype=np.int32 if weight.sum() < 2**31 else np.int64)
    for j in range(lanes):
        tree[j, 1:] = np.bincount(rank[lo[j] : hi[j]], weights=weight[lo[j] : hi[j]], minlength=size)
    step = 1
    while step < size:
        tree[:, 2 * step :: 2 * step] += tree[:, step : size : 2 * step]
        step *= 2
    return tree.reshape(-1)


def _added(tree: np.ndarray, base: np.ndarray, rank: np.ndarray, change: np.ndarray, size: int) -> None:
    node = rank + 1
    while node.size:
        np.add.at(tree, base + node, change)
        node = node + (node & -node)
        stay = node <= size
        if not stay.all():
            node, base, change = node[stay], base[stay], change[stay]


def _below(tree: np.ndarray, base: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How much of each tree lies below a rank."""
    total, node = np.zeros(len(rank), dtype=np.int64), rank.copy()
    while node.any():
        total += tree[base + node]
        node &= node - 1
    return total


def _descended(tree: np.ndarray, base: np.ndarray, k: np.ndarray, size: int) -> np.ndarray:
    """The rank of the k-th event of each tree, counted from 1."""
    at, k, bit = np.zeros(len(k), dtype=np.int64), k.copy(), size // 2
    while bit:
        held = tree[base + at + bit]
        over = held < k
        at += bit * over
        k -= held * over
        bit //= 2
    return at


def windows(chunk: np.ndarray, at: np.ndarray, cents: np.ndarray, weight: np.ndarray, asked: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, median2, mad4) of the windows that end at the asked events, in their order.

    Events are sorted by chunk and time; ``weight`` says how often one counts, 0 for those without cents. A window
    holds its chunk's events of more than ``at - span`` and at most ``at``. Equal ends are worked out once.

    The ends are dealt in order to lanes, which go on side by side: a lane has a Fenwick tree over the ranks of
    cents, and its two pointers say which events come into the tree and which leave it at the next end. A descent
    finds the middle events; a bisection on the radius, by counts between two ranks, finds the middle deviation.
    """
    first = np.r_[True, chunk[1:] != chunk[:-1]]
    offset = at - at[first][np.cumsum(first) - 1]
    key = (np.cumsum(first) - 1) * (int(offset.max()) + span + 2) + offset
    held = weight > 0
    ends, of_end = np.unique(key[asked], return_inverse=True)
    events, weight = key[held], weight[held]
    n, median2, mad4 = (np.zeros(len(ends), dtype=np.int64) for _ in range(3))
    if len(events):
        values, rank = np.unique(cents[held], return_inverse=True)
        lo, hi = np.searchsorted(events, ends - span, side="right"), np.searchsorted(events, ends, side="right")
        total = np.r_[0, np.cumsum(weight)]
        n = total[hi] - total[lo]
        size = 1 << max(1, int(len(values)).bit_length())  # over the number of values, so that every rank has a node
        lanes = int(np.clip(min(len(ends) // 64, NODES // size), 1, LANES))
        long = -(-len(ends) // lanes)
        lanes = -(-len(ends) // long)
        starts = np.arange(lanes) * long
        tree = _tree(lanes, size, rank, weight, lo[starts], hi[starts])
        for i in range(long):
            q = starts[starts + i < len(ends)] + i
            base = np.arange(len(q)) * (size + 1)
            if i:
                come, go = hi[q] - hi[q - 1], lo[q] - lo[q - 1]
                many, begin = np.r_[come, go], np.r_[hi[q - 1], lo[q - 1]]
                lane = np.repeat(np.r_[base, base], many)
                event = np.arange(len(lane)) + np.repeat(begin - (np.cumsum(many) - many), many)
                sign = np.repeat(np.r_[np.ones(len(q), np.int64), -np.ones(len(q), np.int64)], many)
                _added(tree, lane, rank[event], (sign * weight[event]).astype(tree.dtype), size)
            full = n[q] > 0
            q, base = q[full], base[full]
            if len(q):
                median2[q], mad4[q] = _middles(tree, base, n[q], values, size)
    return n[of_end], median2[of_end], mad4[of_end]


def _middles(tree: np.ndarray, base: np.ndarray, n: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    low, high, one = (n + 1) // 2, n // 2 + 1, np.ones(len(n), dtype=np.int64)
    four = np.concatenate([base, base, base, base])
    a, b, least, most = np.split(values[_descended(tree, four, np.concatenate([low, high, one, n]), size)], 4)
    median2 = a + b
    # each side of the median holds half of the events, so the lower middle deviation is at most that of either end
    small, large = np.zeros(len(n), dtype=np.int64), np.minimum(median2 - 2 * least, 2 * most - median2)
    two = four[: 2 * len(n)]

    def between(radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.searchsorted(values, (median2 - radius + 1) >> 1, side="left")
        right = np.searchsorted(values, (median2 + radius) >> 1, side="right")
        below = _below(tree, two, np.concatenate([left, right]))
        return below[: len(n)], below[len(n) :]

    while (small < large).any():
        radius = (small + large) >> 1
        left, right = between(radius)
        enough = right - left >= low
        large, small = np.where(enough, radius, large), np.where(enough, small, np.minimum(radius + 1, large))
    left, right = between(small)
    # the upper middle deviation is the same, or that of the next event on one side
    k = np.concatenate([np.maximum(left, 1), np.minimum(right + 1, n)])
    before, after = np.split(values[_descended(tree, two, k, size)], 2)
    far = np.iinfo(np.int64).max
    further = np.minimum(np.where(left > 0, median2 - 2 * before, far), np.where(right < n, 2 * after - median2, far))
    return median2, small + np.where(right - left >= high, small, further)


def micros(time: Column, kind) -> Column:
    """Microseconds of a time, by its calendar fields where it has no zone."""
    if not isinstance(kind, TimestampNTZType):
        return F.unix_micros(time.cast("timestamp"))
    seconds = F.unix_date(F.to_date(time)).cast("long") * 86400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("long")


def _events(rows: DataFrame, id_col: str, time_col: str, series_col: str, value_col: str) -> DataFrame:
    """(id, at, series, cents) of rows with a time."""
    value = 100 * F.col(value_col).cast("double") + 0.5
    cents = F.when(F.abs(value) < 2.0**58, F.floor(value).cast("long"))
    return rows.select(F.col(id_col).alias("id"), micros(F.col(time_col), rows.schema[time_col].dataType).alias("at"), F.col(series_col).cast("string").alias("series"), cents.alias("cents")).where("at is not null")


def _chunked(events: DataFrame, raw: DataFrame, span: int, dense: int) -> DataFrame:
    """(series, start, width, share, at, cents, n, id, asked): the events of each chunk, and those of its halo.

    A chunk is ``WINDOWS`` windows of time. Where one window's length of a series has over ``dense`` events, it and
    the next are cut into shorter chunks instead. The halo of a short chunk comes as counts: of what leaves the window
    inside the chunk by time and cents, of all else by cents. If a shortest chunk still has over 4 * ``dense`` events,
    they are dealt to shares which only ask; what they ask is its events as counts.
    """
    slot, wide = F.col("at") - F.pmod("at", F.lit(span)), WINDOWS * span
    counted = raw.groupBy("series", slot.alias("slot")).count().where(F.col("count") > dense)
    level = F.least(F.ceil(F.log2(F.col("count") / dense)), F.lit(FINEST)).cast("int")
    cuts = durable(counted.select("series", "slot", level.alias("level")))
    many = cuts.count()
    held = events.withColumn("slot", slot)
    base = lambda at: at - F.pmod(at, F.lit(wide))
    if not many:
        next_base = base(F.col("at") + span - 1)
        own = F.struct(base(F.col("at")).alias("start"), F.lit(wide).cast("long").alias("width"), F.lit(True).alias("asked"))
        halo = F.when((next_base != base(F.col("at"))) & F.col("cents").isNotNull(), F.struct(next_base.alias("start"), F.lit(wide).cast("long").alias("width"), F.lit(False).alias("asked")))
        placed = held.select("*", F.explode(F.array_compact(F.array(own, halo))).alias("c"))
        return placed.select("series", "c.start", "c.width", F.lit(0).alias("share"), "at", "cents", F.lit(1).cast("long").alias("n"), F.when(F.col("c.asked"), F.col("id")).alias("id"), "c.asked")
    # a dense slot and the one after it have short chunks; each row sees how short they are in its slot and the next
    both = cuts.union(cuts.select("series", F.col("slot") + span, "level")).groupBy("series", "slot").agg(F.max("level").alias("level"))
    width = F.ceil(F.lit(span) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    here = both.select("series", "slot", width.alias("w0"), F.lit(None).cast("long").alias("w1"))
    ahead = both.select("series", F.col("slot") - span, F.lit(None).cast("long"), width)
    known = here.union(ahead).groupBy(F.col("series").alias("s"), F.col("slot").alias("t")).agg(F.max("w0").alias("w0"), F.max("w1").alias("w1"))
    known = F.broadcast(known) if 3 * many <= BROADCAST else known
    held = held.join(known, F.col("series").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("t")), "left").drop("s", "t")
    held = held.withColumn("nth", F.floor((F.col("at") - F.col("slot")) / F.col("w0")).cast("long"))
    start = F.when(F.col("w0").isNull(), base(F.col("at"))).otherwise(F.col("slot") + F.col("nth") * F.col("w0"))
    held = held.withColumn("start", start).withColumn("width", F.coalesce("w0", F.lit(wide).cast("long")))

    cell = lambda at, w: F.struct(at.cast("long").alias("start"), w.cast("long").alias("width"))
    none = F.array().cast("array<struct<start:bigint,width:bigint>>")
    runs = lambda origin, w, a, z: F.when(a <= z, F.transform(F.sequence(a, z), lambda k: cell(origin + k * w, w))).otherwise(none)
    later, last = F.col("slot") + span, F.col("at") + span - 1
    inside = F.when(F.col("w0").isNull(), none).otherwise(runs(F.col("slot"), F.col("w0"), F.col("nth") + 1, F.floor((F.lit(span) - 1) / F.col("w0")).cast("long")))
    short = runs(later, F.col("w1"), F.lit(0).cast("long"), F.floor((last - later) / F.col("w1")).cast("long"))
    plain = F.when(F.col("w0").isNull() & (base(later) == F.col("start")), none).otherwise(F.array(cell(base(later), F.lit(wide))))
    beyond = F.when(last < later, none).when(F.col("w1").isNotNull(), short).otherwise(plain)
    halo = held.where("cents is not null").select("series", "at", "cents", F.explode(F.concat(inside, beyond)).alias("c"))
    leaves = F.when(F.col("at") < F.col("c.start") + F.col("c.width") - span, F.col("at")).otherwise(F.col("c.start") - 1)
    counts = halo.select("series", "c.start", "c.width", leaves.alias("at"), "cents", F.lit(1).cast("long").alias("n"))

    at_cell = ["series", "start", "width"]
    crowded = durable(held.where("w0 is not null").groupBy(*at_cell).count().where(F.col("count") > 4 * dense).select(F.col("series").alias("s"), F.col("start").alias("t"), F.col("width").alias("w"), F.ceil(F.col("count") / (4 * dense)).cast("int").alias("shares")))
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST else crowded
    meet = F.col("series").eqNullSafe(F.col("s")) & (F.col("start") == F.col("t")) & (F.col("width") == F.col("w"))
    held = held.join(crowded, meet, "left")
    counts = counts.unionByName(held.where("shares is not null and cents is not null").select(*at_cell, "at", "cents", F.lit(1).cast("long").alias("n")))
    counts = counts.groupBy(*at_cell, "at", "cents").agg(F.sum("n").alias("n")).join(crowded, meet, "left")
    shares = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
    told = counts.select(*at_cell, shares.alias("share"), "at", "cents", "n", F.lit(None).cast(events.schema["id"].dataType).alias("id"), F.lit(False).alias("asked"))
    share = F.when(F.col("shares").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "at"), F.col("shares")).cast("int"))
    own = held.select(*at_cell, share.alias("share"), "at", "cents", F.when(F.col("shares").isNull(), 1).otherwise(0).cast("long").alias("n"), "id", F.lit(True).alias("asked"))
    return own.unionByName(told)


def _cells(t: pa.Table) -> np.ndarray:
    """A number for each row, other where the chunk is another."""
    parts = [t.column(c).to_numpy() for c in ("start", "width", "share")]
    series = t.column("series").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    change = np.any([p[1:] != p[:-1] for p in (*parts, series)], axis=0)
    return np.r_[0, np.cumsum(change)]


def rolling_medians(rows: DataFrame, span: int = 900_000_000, dense: int = DENSE, id_col: str = "click_id", time_col: str = "ts", series_col: str = "kind", value_col: str = "value") -> DataFrame:
    """(id, series, at, cents, n, median2, mad4, far): for each id its series' window of the last ``span`` microseconds.

    A window holds what is later than its own time minus ``span`` and not later than its own time. ``cents`` is
    floor(100 * value + 0.5); ``n`` how many the window has; ``median2`` and ``mad4`` their doubled median and the
    doubled median of their distances from it, doubled too; ``far`` whether the own cents lie further off than twice
    that. Times without a zone count as they stand.

    Rows without a time are left out. Of rows that share an id the least by time, series and cents counts (nulls
    first), and rows with a null id are one. A null series is a series. A null value, one that is not finite and one
    of 2**58 cents or more has no cents: its row gets the window, and no ``far``. A window without cents has n = 0 and
    nulls. Ties in time see each other; equal cents all count. Other columns are ignored; an empty table gives an empty
    one. Chunks of time go through tasks with the window before them as their halo; see ``_chunked`` for dense ones.
    """
    raw = _events(rows, id_col, time_col, series_col, value_col)
    events = raw.groupBy("id").agg(F.min(F.struct("at", "series", "cents")).alias("e")).select("id", "e.*")
    chunks = _chunked(events, raw, span, dense)
    schema = f"id {rows.schema[id_col].dataType.simpleString()}, series string, at long, cents long, n long, median2 long, mad4 long, far boolean"

    def told(t: pa.Table) -> pa.RecordBatch:
        cents = t.column("cents").combine_chunks()
        null, asked = cents.is_null().to_numpy(zero_copy_only=False), t.column("asked").to_numpy()
        at, c = t.column("at").to_numpy(), cents.fill_null(0).to_numpy()
        n, median2, mad4 = windows(_cells(t), at, c, np.where(null, 0, t.column("n").to_numpy()), asked, span)
        own = t.filter(pa.array(asked)).select(["id", "series", "at", "cents"]).combine_chunks()
        empty, lone = n == 0, null[asked] | (n == 0)
        far = 2 * np.abs(2 * c[asked] - median2) > 2 * mad4
        columns = [pa.array(n), pa.array(median2, mask=empty), pa.array(mad4, mask=empty), pa.array(far, mask=lone)]
        return pa.RecordBatch.from_arrays([*(own.column(x).combine_chunks() for x in own.column_names), *columns], ["id", "series", "at", "cents", "n", "median2", "mad4", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count, enough = [], 0, ROWS
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                count += batch.num_rows
            if count >= enough:
                t = pa.Table.from_batches(waiting)
                cell = _cells(t)
                whole = int(np.searchsorted(cell, cell[-1]))
                if whole:
                    yield told(t.slice(0, whole))
                    waiting, count = t.slice(whole).to_batches(), count - whole
                enough = max(ROWS, 2 * count)
        if waiting:
            yield told(pa.Table.from_batches(waiting))

    keys = ["series", "start", "width", "share"]
    return shipped(chunks).repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(run, schema)
