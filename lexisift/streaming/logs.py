"""Log summaries kept up to date as log files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.service_logs import log_summary
from ..sources.files import decoded

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_logs(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, raw) of log files as they come to a folder, each whole."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(path)
    return files.select(F.col("path").alias("source_id"), decoded("content").alias("raw"))


def summarise_arriving(logs: DataFrame, target: str, checkpoint: str, errors_only: bool = False, once: bool = True) -> StreamingQuery:
    """Writes the summary of each batch of logs to ``target``, a folder for each batch, so that a batch done again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        log_summary(batch, errors_only).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counted_repeats(events: DataFrame, time: str, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """How often the same entry came in each window of time; windows close when the watermark has passed them."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, within).groupBy(F.window(time, within), *keys).agg(F.count("*").alias("repeat_count"))
