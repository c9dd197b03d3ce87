"""Files as text, and listings of files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import store
from ..functions.text import GENERATED_ENDINGS, HIDDEN_FROM_CODE, IGNORED_DIRECTORIES, basename, is_code, trim
from .captures import text_lines


def read_bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, modificationTime, content) of all files below ``path``; Spark leaves out those of no length."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decoded(content: Column | str) -> Column:
    """UTF-16 in little-endian order where its mark or many zero bytes tell so, else UTF-8. A mark stays in the text."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(content, 1, 200))
    zeros = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(head) / 2, F.lit(1)).cast("int")), lambda i: head.substr(2 * i - 1, F.lit(2)) == "00"))
    wide = head.startswith("FFFE") | ((F.length(content) > 100) & (zeros > 50))
    return F.when(wide, F.decode(content, "UTF-16LE")).otherwise(F.decode(content, "UTF-8"))


def looks_binary(content: Column | str) -> Column:
    """Whether a zero byte is among the first 512."""
    content = F.col(content) if isinstance(content, str) else content
    return F.contains(F.substring(content, 1, 512), F.unhex(F.lit("00")))


def read_logs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source_id, raw) of log files, by name."""
    return read_bytes(spark, path, glob).select(F.col("path").alias("source_id"), decoded("content").alias("raw"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, line_no, line) of UTF-8 logs of any size: files are split, and no task holds one.

    A line's number is how many lines the splits before its own have, and its place in that; so lines are counted
    where they lie and only a row for each split is ordered.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    rows_ = read.select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r+$", "").alias("line"))
    sizes = rows_.groupBy("source_id", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    so_far = Window.partitionBy("source_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source_id", "split", (F.coalesce(F.sum("n").over(so_far), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return rows_.join(starts, ["source_id", "split"]).select("source_id", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source_id, line_no, line) of all text files below ``path``; binary ones are left out before lines are."""
    texts = read_bytes(spark, path, glob).where(~looks_binary("content"))
    return text_lines(texts.select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("raw")), final=False)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, line_no, line) of one log in any encoding and of any size, by byte ranges."""
    if not store.reachable(path):
        return text_lines(read_logs(spark, path))
    return store.range_lines(_alone(spark, path), path, logs=True).select(F.lit(path).alias("source_id"), "line_no", "line")


def folder_log_lines(spark: SparkSession, path: str, size: int = store.RANGE) -> DataFrame:
    """(source_id, line_no, line) of all logs below a folder, by their paths in it, in ranges of ``size`` bytes."""
    files = store.listing(spark, path).where("kind = 'file' and length > 0").select("path", "length")
    return store.range_lines(files, path, True, size).withColumnRenamed("path", "source_id")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, line_no, line) of one file, if it is text, by byte ranges."""
    if not store.reachable(path):
        return read_lines(spark, path)
    return store.range_lines(_alone(spark, path), path).select(F.lit(path).alias("source_id"), "line_no", "line")


def _alone(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of a file that is its own root."""
    system, plain = store.opened(path)
    return spark.createDataFrame([("", system.get_file_info(plain).size)], "path string, length long")


def found_lines(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(file, hit_line, content) of the lines with ``query`` in all files below a folder that a search looks into.

    Folders and files that it does not look into are not opened, and of binary ones only the start is read.
    """
    if store.reachable(path):
        files = store.listing(spark, path, IGNORED_DIRECTORIES).where(F.col("kind") == "file").where(searchable("path") & (F.col("length") > 0))
        hits = store.range_hits(files.select("path", "length"), path, query).select(F.col("path").alias("below"), F.col("line_no").alias("hit_line"), F.col("line").alias("content"))
    else:
        from ..plans.searches import search_lines

        below = F.substring("source_id", len(qualified(spark, path).rstrip("/")) + 2, 1 << 30)
        lines = read_lines(spark, path).withColumn("source_id", below).where(searchable("source_id"))
        hits = search_lines(lines, query).withColumnRenamed("file", "below")
    return hits.select(F.concat(F.lit(path.rstrip("/") + "/"), "below").alias("file"), "hit_line", "content")


def directories(path: Column | str) -> Column:
    """The names of the directories of a relative path."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def included(path: Column | str, ignored: bool = False, code: bool = False) -> Column:
    """Whether a file belongs to a listing: by its directories, and for code by what it is."""
    names = F.transform(directories(path), F.lower)
    barred = ([] if ignored else IGNORED_DIRECTORIES) + (HIDDEN_FROM_CODE if code else [])
    out = ~F.exists(names, lambda n: n.isin(barred)) if barred else F.lit(True)
    return out & is_code(path) if code else out


def searchable(path: Column | str) -> Column:
    """Whether a search looks into a file: not below the directories left out of listings, and not generated by name."""
    low, names = F.lower(basename(path)), F.transform(directories(path), F.lower)
    out = ~F.exists(names, lambda n: n.isin(IGNORED_DIRECTORIES))
    for ending in GENERATED_ENDINGS:
        out = out & ~low.endswith(ending)
    return out


def entries(spark: SparkSession, path: str, skip: Iterable[str] = (), most: int | None = None) -> DataFrame:
    """(path, length) relative to ``path`` of all below it, a directory's path with a slash at its end.

    ``skip`` and ``most`` as in ``store.listing``. Of a store that only Spark reads there are its files of some length.
    """
    if store.reachable(path):
        below = store.listing(spark, path, skip, most)
        return below.select(F.when(F.col("kind") == "directory", F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("path"), "length")
    barred = list(skip)
    files = inventory(spark, path)
    if barred:
        files = files.where(~F.exists(F.transform(directories("path"), F.lower), lambda n: n.isin(barred)))
    return files.withColumn("length", F.lit(1).cast("long"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path) relative to ``path`` of all files below it."""
    if store.reachable(path):
        return store.listing(spark, path).where("kind = 'file'").select("path")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    root = qualified(spark, path)
    return found.select(F.substring("path", len(root.rstrip("/")) + 2, 1 << 30).alias("path"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names it in what it reads: with its scheme, absolute, without a slash at its end."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()


def path_kind(spark: SparkSession, path: str) -> str | None:
    """``file`` or ``directory``, or nothing where there is none."""
    if store.reachable(path):
        return store.kind_at(path)
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = given.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(given):
        return None
    return "directory" if system.getFileStatus(given).isDirectory() else "file"


def changed_files(status_lines: DataFrame, files: DataFrame) -> DataFrame:
    """Of a porcelain status (line_no, line), the paths that ``files`` has, whatever their case once, as first spelt; renames drop out."""
    named = status_lines.where("length(line) >= 4").select("line_no", trim(F.substring("line", 4, 1 << 20)).alias("path"))
    there = named.join(files.select("path").distinct(), "path", "left_semi")
    return there.groupBy(F.lower("path").alias("low")).agg(F.min_by("path", "line_no").alias("path")).select("path")
