"""Shards of near equal bytes, by splitters from samples of keys."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..shipping import shipped
from .common import durable

#: Keys that a round samples, on average; ranges that an overfull range is divided into; rounds at most.
SAMPLED, RANGES, ROUNDS = 20_000, 64, 12
#: A cut may miss its place by this part of a shard's bytes before the range around it is divided further.
MISS = 1 / 2000
#: A run of one key up to this part of a shard's bytes is not cut.
WHOLE = 1 / 500

#: The greatest low part of a key.
LAST = (1 << 63) - 1

Key = tuple[int, int]


def places(high: np.ndarray, low: np.ndarray, bounds: list[Key]) -> np.ndarray:
    """For each key how many of the ordered bounds are below it."""
    at = np.searchsorted(np.array([b[0] for b in bounds], dtype=np.int64), high, side="left")
    for first in {b[0] for b in bounds}:  # within a run of one high part the low part decides
        own = high == first
        if own.any():
            at[own] += np.searchsorted(np.array([b[1] for b in bounds if b[0] == first], dtype=np.int64), low[own], side="left")
    return at


def with_places(keyed: DataFrame, bounds: list[Key], name: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column("high").to_numpy(), batch.column("low").to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, name])

    return shipped(keyed).mapInArrow(run, f"{kinds}, `{name}` int")


def quantile_bounds(sample: list[tuple[int, int, float]], parts: int) -> list[Key]:
    """Keys that divide a weighted sample of keys into parts of about equal weight."""
    sample = sorted(sample)
    total = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(total, [total[-1] * k / parts for k in range(1, parts)]) if len(sample) else []
    return sorted({sample[i][:2] for i in at})


def around_runs(keys: list[Key]) -> list[Key]:
    """Bounds before and after the run of each key's high part, so that no run is cut."""
    return sorted({(h - k, LAST) for h, _ in keys for k in (0, 1) if h - k >= -LAST - 1})


def _sampled(keyed: DataFrame, rate: float) -> list[tuple[int, int, float]]:
    """(high, low, weight): keys drawn as likely as their size, by a hash of the row's key and a number of its own."""
    chance = F.least(F.col("size") * F.lit(rate), F.lit(1.0))
    drawn = F.pmod(F.xxhash64("high", "low", F.lit("drawn")), F.lit(1 << 53)) / float(1 << 53)
    rows = keyed.where(drawn < chance).select("high", "low", "size").collect()
    return [(r["high"], r["low"], max(r["size"], 1 / rate)) for r in rows]


def splitters(keyed: DataFrame, shards: int) -> list[Key]:
    """At most ``shards`` - 1 keys that cut rows of (high, low, size) into shards of near equal size, in key order.

    A size-weighted sample of keys gives quantile bounds; rows between two bounds are counted exactly; a range is
    overfull if a shard has to end inside it and it is larger than a cut may miss. Such ranges are divided by
    samples of their own, until none is or none can be. A run of one high part is cut only where it is overfull
    alone. To the driver come samples and a sum for each range.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total or shards < 2:
        return []
    share = total / shards
    bounds = around_runs(quantile_bounds(_sampled(keyed, SAMPLED / total), shards * RANGES))
    for _ in range(ROUNDS):
        sums = dict(with_places(keyed, bounds, "range").groupBy("range").agg(F.sum("size").alias("s")).collect())
        ends = np.cumsum([sums.get(k, 0) for k in range(len(bounds) + 1)])
        # targets that lie inside a range, away from both of its ends
        over = {k for k in range(len(ends)) for n in range(1, shards) if min(n * share - (ends[k] - sums.get(k, 0)), ends[k] - n * share) > share * MISS}
        if not over:
            break
        inside = durable(with_places(keyed, bounds, "range").where(F.col("range").isin(sorted(over))))
        runs = inside.groupBy("range").agg(F.min("high").alias("a"), F.max("high").alias("z"), F.sum("size").alias("s")).collect()
        fresh: set[Key] = set()
        for r in runs:
            one_run = r["a"] == r["z"]
            if not one_run or r["s"] > share * WHOLE:  # else equal texts, few enough to stay together
                drawn = quantile_bounds(_sampled(inside.where(F.col("range") == r["range"]), SAMPLED / r["s"]), RANGES)
                fresh |= set(drawn if one_run else around_runs(drawn))
        if not fresh - set(bounds):
            break
        bounds = sorted(fresh | set(bounds))
    sums = dict(with_places(keyed, bounds, "range").groupBy("range").agg(F.sum("size").alias("s")).collect())
    ends = np.cumsum([sums.get(k, 0) for k in range(len(bounds) + 1)]).tolist()
    cuts = []
    for n in range(1, shards):
        k = bisect_left(ends, n * share)
        k -= int(k > 0 and n * share - ends[k - 1] < ends[k] - n * share)
        if k < len(bounds):
            cuts.append(bounds[k])
    return sorted(cuts)


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, high, low): the text's hash is a key's high part, so that equal texts lie together."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("high"), F.monotonically_increasing_id().alias("number"))
    return told.select("doc_id", "size", "text_crc32", "high", F.xxhash64("doc_id", "number").alias("low"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a row for each row of ``docs``, law ``bytes``.

    Sizes are UTF-8 bytes of the text plus one; those of any two shards differ by about a thousandth of a shard, or by
    what one document has if that is more. Equal texts stay in one shard unless a cut has to divide them, which it does
    only where they have more than a five-hundredth of a shard's bytes. Slots number a shard's rows from 0 in key order.

    A null text is empty. Repeated rows and rows with a null id are placed each. A text of any length is one row; texts
    are read once and not moved. Other columns are ignored. Of an empty table comes an empty one, and with fewer rows
    than shards some shards are empty. To the driver come samples of keys, sums of ranges and, for each of Spark's
    partitions, one number a shard.
    """
    keyed = durable(keyed_rows(docs, id_col, text_col))
    placed = with_places(keyed, splitters(keyed, shards), "shard")
    order = ["shard", "high", "low"]
    ordered = durable(placed.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = ordered.groupBy(F.spark_partition_id().alias("at"), "shard").count().collect()
    before, held = {}, [0] * shards
    for at, shard, n in sorted(tuple(r) for r in counts):
        before[at, shard] = held[shard]
        held[shard] += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        after = np.array([before.get((own, k), 0) for k in range(shards)], dtype=np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            first = np.r_[True, shard[1:] != shard[:-1]] if len(shard) else np.zeros(0, dtype=bool)
            start = np.flatnonzero(first)[np.cumsum(first) - 1]
            slot = after[shard] + np.arange(len(shard)) - start
            after += np.bincount(shard, minlength=shards)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    slots = ordered.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tasks: int = 4) -> list[Key]:
    """Writes the rows of ``docs``, all columns, to ``path``/shard=k as Parquet, and returns the cuts between shards.

    Each row finds its shard by its key alone, so rows move once; ``tasks`` tasks or so write each shard, in key order.
    Rows are treated as by ``shard_documents``. A column of the name ``shard`` must not be among them.
    """
    keyed = durable(keyed_rows(docs, id_col, text_col))
    cuts = splitters(keyed, shards)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("high"), F.xxhash64(F.col(id_col).cast("long"), F.monotonically_increasing_id()).alias("low"))
    placed = with_places(whole, cuts, "shard").repartitionByRange(shards * tasks, "shard", "high", "low")
    placed.select("row.*", "shard").write.partitionBy("shard").parquet(path)
    return cuts
