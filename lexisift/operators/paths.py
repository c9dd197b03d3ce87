"""Operators over paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import slashes


def _directories(path: Column) -> Column:
    parts = F.split(slashes(path), "/", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def common_depth(paths: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """How many leading directories all paths of a group share, whatever their case; the root alone is none.

    Component by component the least and the greatest path share what all share, so two aggregates suffice.
    """
    names = F.transform(_directories(F.col(path)), F.lower)
    ends = paths.groupBy(*by).agg(F.min(names).alias("a"), F.max(names).alias("b"))
    places = F.sequence(F.lit(1), F.least(F.size("a"), F.size("b")))
    same = F.when(F.least(F.size("a"), F.size("b")) == 0, F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: F.slice("a", 1, i) == F.slice("b", 1, i)))
    depth = F.coalesce(F.array_max(same), F.lit(0))
    return ends.select(*by, F.when((depth == 1) & (F.element_at("a", 1) == ""), 0).otherwise(depth).alias("depth"))


def common_prefix(paths: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """(by, prefix): the shared directories with a slash at the end, or nothing; written as in the least path."""
    depth = common_depth(paths, by, path)
    some = paths.groupBy(*by).agg(F.min(slashes(path)).alias("some"))
    parts = F.slice(F.split("some", "/", -1), 1, F.col("depth"))
    prefix = F.when(F.col("depth") > 0, F.concat(F.array_join(parts, "/"), F.lit("/"))).otherwise("")
    return (depth.join(some, by) if by else depth.crossJoin(some)).select(*by, prefix.alias("prefix"))


def without_directories(path: Column | str, depth: Column | str) -> Column:
    """The path after its first ``depth`` directories."""
    parts = F.split(slashes(path), "/", -1)
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0))), "/")


def ancestors(path: Column | str) -> Column:
    """All directories above a relative path, from the outermost, as paths; the root is the empty text."""
    names = _directories(F.col(path) if isinstance(path, str) else path)
    return F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))


def tree_rollup(files: DataFrame, by: list[str], path: str = "path", max_depth: int | None = None, empty: bool = True) -> DataFrame:
    """(by, directory, depth, n_dirs, n_files) below each directory, the root among them.

    A path that ends in a slash is a directory. Files are counted by their own directory, and these counts are spread
    over the directories above. With ``max_depth``, directories below it are not entered, so neither they nor their
    files count; ``empty`` tells whether directories stay in which no file counts.
    """
    names = _directories(F.col(path))
    is_file = F.substring_index(slashes(F.col(path)), "/", -1) != ""
    own = files.select(*by, names.alias("names"), is_file.alias("is_file")).groupBy(*by, "names").agg(F.count_if("is_file").alias("n"))
    most = F.size("names") if max_depth is None else F.least(F.size("names"), F.lit(max_depth))
    counted = F.when(F.size("names") <= most, F.col("n")).otherwise(0)
    upward = F.transform(F.sequence(F.lit(0), most), lambda k: F.array_join(F.slice("names", 1, k), "/"))
    n_files = own.select(*by, counted.alias("n"), F.explode(upward).alias("directory")).groupBy(*by, "directory").agg(F.sum("n").cast("long").alias("n_files"))
    if not empty:
        n_files = n_files.where((F.col("n_files") > 0) | (F.col("directory") == ""))
    pairs = n_files.where("directory <> ''").select(*by, F.explode(ancestors("directory")).alias("directory"))
    n_dirs = pairs.groupBy(*by, "directory").agg(F.count("*").alias("n_dirs"))
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/", -1)))
    return n_files.join(n_dirs, [*by, "directory"], "left").select(*by, "directory", depth.alias("depth"), F.coalesce("n_dirs", F.lit(0)).cast("long").alias("n_dirs"), "n_files")
