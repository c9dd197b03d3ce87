"""Folders and byte ranges of files, read by Spark's tasks themselves.

Spark's own readers leave out files of no length, folders without files and names that begin with a dot or an
underscore, and take a file that is not UTF-8 as one row. So tasks list folders and read ranges through pyarrow, which
knows local and mounted paths and the usual stores; ``reachable`` tells whether it knows one.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..shipping import shipped
from ..tables import once

#: Bytes of a range; what a task reads at a time; folders that a task lists; tasks at most.
RANGE, PIECE, FOLDERS, TASKS = 8 << 20, 1 << 20, 64, 10_000
#: Bytes at the start that tell how a log is encoded and whether a file is text, and how many zeros make it wide.
HEAD, SNIFFED, ZEROS = 200, 512, 50


def local(path: str) -> str | None:
    """The path without its scheme, if it lies in the file system of the machine."""
    parts = urlparse(path)
    if parts.scheme in ("", "file") or os.path.exists(path):
        return os.path.abspath(unquote(parts.path) if parts.scheme == "file" else path)
    return None


@lru_cache(maxsize=64)
def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    plain = local(root)
    return (pafs.LocalFileSystem(), plain) if plain is not None else pafs.FileSystem.from_uri(root)


def reachable(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


def kind_at(path: str) -> str | None:
    """``file`` or ``directory``, or nothing where there is none."""
    system, plain = opened(path)
    found = system.get_file_info(plain).type
    return {pafs.FileType.NotFound: None, pafs.FileType.Directory: "directory"}.get(found, "file")


def _tasks(n: float) -> int:
    return int(min(max(n, 1), TASKS))


def listing(spark: SparkSession, root: str, skip: Iterable[str] = (), most: int | None = None) -> DataFrame:
    """(path, kind, length) of all that lies below a folder, paths relative to it.

    Folders are a frontier that is listed level by level, many in a task. ``skip``: lower-case names of folders that
    are neither entered nor told; ``most``: folders that lie deeper are told but not entered, 0 for the root alone.
    """
    barred = list(skip)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = opened(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = system.get_file_info(pafs.FileSelector(f"{plain}/{folder}" if folder else plain))
                names = [f"{folder}/{x.base_name}" if folder else x.base_name for x in found]
                kinds = ["directory" if x.type == pafs.FileType.Directory else "file" for x in found]
                sizes = [x.size or 0 if k == "file" else 0 for x, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(sizes, pa.int64())], ["path", "kind", "length"])

    frontier, n, levels = spark.createDataFrame([("",)], "path string"), 1, []
    while n:
        level = shipped(frontier.repartition(_tasks(n / FOLDERS))).mapInArrow(look, "path string, kind string, length long")
        entered = (F.col("kind") == "directory") & F.lower(F.substring_index("path", "/", -1)).isin(barred) if barred else F.lit(False)
        levels.append(once(level.where(~entered)))
        frontier = levels[-1].where("kind = 'directory'").select("path")
        n = frontier.count() if most is None or len(levels) <= most else 0
    return reduce(DataFrame.unionByName, levels)


def wide(head: bytes, length: int) -> bool:
    """Whether a log is UTF-16 in little-endian order: by its mark, or by many zeros near its start."""
    return head[:2] == b"\xff\xfe" or (length > 100 and head[:HEAD].count(0) > ZEROS)


def ranges(files: DataFrame, root: str, size: int = RANGE) -> DataFrame:
    """(path, start, end, wide, binary): the byte ranges of files (path, length), of which nothing but the start is read here."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = opened(root)
        for batch in batches:
            wides, binaries = [], []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with system.open_input_file(f"{plain}/{path}" if path else plain) as f:
                    head = f.read(SNIFFED)
                wides.append(wide(head, length))
                binaries.append(0 in head)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(wides, pa.bool_()), pa.array(binaries, pa.bool_())], ["path", "length", "wide", "binary"])

    n = files.count()
    heads = shipped(files.select("path", "length").repartition(_tasks(n / FOLDERS))).mapInArrow(look, "path string, length long, wide boolean, binary boolean")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    cut = heads.select("path", starts.alias("start"), "length", "wide", "binary")
    return cut.select("path", "start", F.least(F.col("start") + size, "length").alias("end"), "wide", "binary")


def _units(data: bytes, width: int, since: int, at: int) -> int:
    """Where the next line feed begins in ``data``, which starts at byte ``at`` of its file, from ``since`` on; else -1."""
    found = data.find(b"\n" if width == 1 else b"\n\0", since)
    while width == 2 and found >= 0 and (at + found) % 2:
        found = data.find(b"\n\0", found + 1)
    return found


def lines_from(f: pa.NativeFile, start: int, end: int, width: int, piece: int = PIECE) -> Iterator[bytes]:
    """The lines, without their line feeds, that begin at ``start`` or later and before ``end``.

    A line belongs to the range that it begins in, and is read to its end. ``width``: bytes of a unit; a range may
    begin in the middle of one. What follows a last line feed is no line if it is empty.
    """
    begin = -(-start // width) * width
    if begin >= end:
        return
    base = begin - width if begin else 0  # from the unit before, to see whether a line begins
    f.seek(base)
    data, at, look, skipping = b"", 0, 0, begin > 0  # at: where the line at hand begins in data, look: what is not searched yet
    while True:
        cut = _units(data, width, look, base)
        while cut >= 0:
            if not skipping:
                yield data[at:cut]
            at = look = cut + width
            skipping = False
            if base + at >= end:
                return
            cut = _units(data, width, look, base)
        look = max(at, len(data) - width + 1)
        at = look if skipping else at
        more = f.read(max(piece, len(data) - at))  # of a long line more and more
        if not more:
            if at < len(data) and not skipping:
                yield data[at:]
            return
        data, base, look, at = data[at:] + more, base + at, look - at, 0


def decoded_line(line: bytes, width: int) -> str:
    return line.decode("utf-8" if width == 1 else "utf-16-le", "replace").rstrip("\r")


def _read(parts: DataFrame, root: str, work: Callable, schema: str, kinds: list) -> DataFrame:
    """``work(path, start, before, lines, width)`` yields columns of rows for each range of ``parts`` (path, start, end, wide, before)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = opened(root)
        for batch in batches:
            for row in batch.to_pylist():
                width = 2 if row["wide"] else 1
                with system.open_input_file(f"{plain}/{row['path']}" if row["path"] else plain) as f:
                    for columns in work(row["path"], row["start"], row["before"], lines_from(f, row["start"], row["end"], width), width):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    n = parts.count()
    dealt = parts.select("path", "start", "end", "wide", "before").repartition(_tasks(n), F.xxhash64("path", "start"))
    return shipped(dealt).mapInArrow(run, schema)


def _before(counts: DataFrame) -> DataFrame:
    """The counts (path, start, n) with ``before``: the lines of the ranges before."""
    so_far = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))


def range_lines(files: DataFrame, root: str, logs: bool = False, size: int = RANGE) -> DataFrame:
    """(path, line_no, line) of files (path, length) below ``root``, numbered from 1, without carriage returns at the end.

    ``logs``: UTF-16 logs are decoded as such; else binary files are left out. Ranges are read twice: their lines are
    counted, and then read with the number that the first has. No line is shuffled, and no task holds more than a range.
    """
    parts = once(ranges(files, root, size).where(F.lit(logs) | ~F.col("binary")).withColumn("wide", F.col("wide") & F.lit(logs)))

    def count(path: str, start: int, before: int, lines: Iterator[bytes], width: int) -> Iterator[tuple]:
        yield [path], [start], [sum(1 for _ in lines)]

    def read(path: str, start: int, before: int, lines: Iterator[bytes], width: int) -> Iterator[tuple]:
        held: list[str] = []
        for line in lines:
            held.append(decoded_line(line, width))
            if len(held) == 4096:
                yield [path] * len(held), range(before + 1, before + len(held) + 1), held
                before, held = before + len(held), []
        if held:
            yield [path] * len(held), range(before + 1, before + len(held) + 1), held

    counts = once(_read(parts.withColumn("before", F.lit(0).cast("long")), root, count, "path string, start long, n long", [pa.string(), pa.int64(), pa.int64()]))
    numbered = parts.join(_before(counts).drop("n"), ["path", "start"])
    return _read(once(numbered), root, read, "path string, line_no long, line string", [pa.string(), pa.int64(), pa.string()])


def range_hits(files: DataFrame, root: str, query: str, size: int = RANGE) -> DataFrame:
    """(path, line_no, line) of the lines of text files that hold ``query``, whatever its case if it has no capital.

    Each range is read once. Lines are tested as bytes and only those are decoded that hold it or, where letters of
    other cases count, might; to the shuffle go hits and a count for each range.
    """
    any_case = all(not c.isalpha() or c.islower() for c in query)
    sought, plain = query.lower() if any_case else query, query.isascii()
    as_bytes = sought.encode()

    def found(line: bytes) -> str | None:
        if not any_case or plain:
            if as_bytes in (line.lower() if any_case else line):
                return decoded_line(line, 1)
            if not any_case or line.isascii():
                return None
        text = decoded_line(line, 1)
        return text if sought in text.lower() else None

    def search(path: str, start: int, before: int, lines: Iterator[bytes], width: int) -> Iterator[tuple]:
        n, hits = 0, []
        for line in lines:
            n += 1
            if (text := found(line)) is not None:
                hits.append((n, text))
                if len(hits) == 4096:
                    yield [path] * len(hits), [start] * len(hits), *zip(*hits, strict=True), [None] * len(hits)
                    hits = []
        yield [path] * (len(hits) + 1), [start] * (len(hits) + 1), *zip(*hits, (None, None), strict=True), [None] * len(hits) + [n]

    parts = once(ranges(files, root, size).where(~F.col("binary")).withColumn("wide", F.lit(False)).withColumn("before", F.lit(0).cast("long")))
    told = once(_read(parts, root, search, "path string, start long, at long, line string, n long", [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]))
    counts = _before(told.where("n is not null").select("path", "start", "n"))
    return told.where("at is not null").join(counts.select("path", "start", "before"), ["path", "start"]).select("path", (F.col("before") + F.col("at")).alias("line_no"), "line")


def write_files(files: DataFrame, root: str) -> str:
    """Writes files (path, content) below a folder, paths relative to it; a path that ends in a slash is a folder. Returns ``root``.

    What a lost task wrote is written again, the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = opened(root)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system.create_dir(f"{plain}/{path}".rpartition("/")[0], recursive=True)
                if not path.endswith("/"):
                    with system.open_output_stream(f"{plain}/{path}") as f:
                        f.write(content or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    shipped(files.select("path", F.col("content").cast("binary").alias("content"))).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return root
