"""Rows that several parts of a plan read, worked out once."""

from __future__ import annotations

import re
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


#: Masters under which driver and executors are one process.
ONE_PROCESS = re.compile(r"local(\[[^\]]*\])?")
#: Frames made while it is set lose their shuffle files when they have been worked out, not when the driver next collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def chosen_folder(master: str, configured: str | None, warehouse: str | None) -> str:
    """Where rows worked out once go: the configured folder; else a temporary one if there is one process; else the warehouse.

    A warehouse of the machine's own file system is none that other machines see, so without a configured folder it
    is refused on a cluster, one of several processes on one machine among them.
    """
    if configured:
        return configured
    if ONE_PROCESS.fullmatch(master):
        return tempfile.mkdtemp(prefix="lexisift-")
    if not warehouse or urlparse(warehouse).scheme in ("", "file"):
        raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse.rstrip('/')}/_checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set as ``chosen_folder`` says where there is none yet."""
    context = spark.sparkContext
    if not (have := context.getCheckpointDir()):
        context.setCheckpointDir(chosen_folder(context.master, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir", None)))
        have = context.getCheckpointDir()
    return have


def once(frame: DataFrame) -> DataFrame:
    """The rows in the shared folder, so that no reader and no lost executor has them worked out again.

    What was shuffled for them goes from the disks at once, as nothing reads it any more.
    """
    spark = frame.sparkSession
    shared_folder(spark)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        own = frame.select("*")
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return own.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Takes a folder away, wherever the session's file systems have it."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    given.getFileSystem(spark._jsc.hadoopConfiguration()).delete(given, True)
