"""Captured command results, and their lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import is_blank, rtrim

SCHEMA = "capture_id string, command array<string>, exit_code int, stdout string, stderr string"


def captures(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Rows (capture_id, command, exit_code, stdout, stderr)."""
    return spark.createDataFrame(list(rows), SCHEMA)


def merged(frame: DataFrame) -> DataFrame:
    """(source_id, exit_code, raw): stdout, then stderr on a line of its own unless it is blank."""
    out, err = F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))
    raw = F.when(is_blank(err), out).otherwise(F.concat(rtrim(out), F.lit("\n"), err))
    return frame.select(F.col("capture_id").alias("source_id"), F.coalesce("exit_code", F.lit(0)).alias("exit_code"), raw.alias("raw"))


def text_lines(frame: DataFrame, id_col: str = "source_id", text_col: str = "raw", final: bool = True) -> DataFrame:
    """(source_id, line_no, line) from 1, split at line feeds, without carriage returns at the end.

    ``final``: whether what follows the last line feed counts though it is empty, as it does when text is
    split; lines of a file do not end in one more.
    """
    parts = F.split(F.col(text_col), "\n", -1)
    if not final:
        parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    numbered = frame.select(F.col(id_col).alias("source_id"), F.posexplode(parts).alias("at", "line"))
    return numbered.select("source_id", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", r"\r+$", "").alias("line"))
