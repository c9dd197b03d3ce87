"""Answers paired with the latest open request."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..shipping import shipped


def nested_pairs(events: DataFrame, by: list[str], order: str, opens: str, closes: str) -> DataFrame:
    """(by, open, close): each close with the latest open not yet closed, for opens that are all different.

    The depth of open events, lifted where closes found none, names a slot; a close belongs to the last open of
    its slot. Window functions only.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col(opens), 1).when(F.col(closes), -1).otherwise(0)
    depth = events.where(F.col(opens) | F.col(closes)).withColumn("d", F.sum(step).over(w))
    lifted = depth.withColumn("level", F.col("d") - F.least(F.lit(0), F.min("d").over(w)))
    slot = lifted.withColumn("slot", F.when(F.col(opens), F.col("level")).otherwise(F.col("level") + 1))
    inner = Window.partitionBy(*by, "slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = slot.withColumn("before", F.last(F.struct(F.col(order).alias("at"), F.col(opens).alias("open"))).over(inner))
    return seen.where(F.col(closes) & F.col("before.open")).select(*by, F.col("before.at").alias("open"), F.col(order).alias("close"))


def stacked_pairs(events: DataFrame) -> DataFrame:
    """(source_id, line_no, method, url, duration, status): each answer with the request that it takes off the stack.

    From (source_id, line_no, method, url, duration, status), requests with a method and answers with a status.
    A request that is still open opens again in its old place; an answer takes the last off, and with none open
    it is dropped. A source's events stream through in order, and only its open requests are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["source_id"] != now:
                    now, open_ = row["source_id"], {}
                if row["method"] is not None:
                    open_[row["method"], row["url"]] = None
                elif open_:
                    method, url = open_.popitem()[0]
                    out.append(row | {"method": method, "url": url})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    used = events.select("source_id", "line_no", "method", "url", "duration", "status")
    return shipped(used).repartition("source_id").sortWithinPartitions("source_id", "line_no").mapInArrow(run, used.schema)
