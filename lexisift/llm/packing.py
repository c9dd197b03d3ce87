"""Packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..shipping import shipped
from .byte_bpe import byte_level
from .common import durable, map_texts

#: Rows of one length are numbered in shares of about ROWS, so that a hot length is dealt over tasks; all lengths
#: together have at most SHARES shares, the bound of what comes to the driver, and one for each length.
ROWS, SHARES = 500, 1 << 16


def cut_documents(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids]) of at most ``most`` ids, each id in one piece.

    A document's ids are its text's and then ``end_id``; a null or empty text has the end id alone. Pieces are
    full but for a document's last. ``ids``: unsigned 32-bit little-endian, as the checksum takes them.
    A text of any length is cut into as many pieces as it needs. Repeated rows are cut each, and rows with a null id
    too, whose pieces have a null id; other columns, whatever their names, are ignored; an empty table gives none.
    """

    def make():
        coder = byte_level(tokenizer)

        def work(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            rows: list[tuple] = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = coder.ids(text)
                ids.append(end_id)
                data = memoryview(np.asarray(ids, dtype="<u4").tobytes())
                for start in range(0, len(ids), most):
                    piece = data[4 * start : 4 * (start + most)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids), *([bytes(piece)] if with_ids else [])))
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return work

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return map_texts(docs, make, schema, id_col, text_col)


def shortest_pack_first(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, how many, first sequence, offset) of a histogram of lengths.

    Lengths go longest first. Those of one length go to the patterns with the least in them so far that still
    have room, one to each sequence of the pattern, and to new sequences when no pattern is left. A pattern is
    a run of equal sequences with its count; placing fewer than its count splits it. A pattern is held as the
    range of its sequence numbers, so its make-up need not be copied.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    patterns: list[tuple[int, int, int]] = []  # tokens in each, first sequence, how many; kept in order
    fresh = 0
    for length in sorted(counts, reverse=True):
        left, rank, moved = counts[length], 0, []
        while left:
            if patterns and patterns[0][0] + length <= most:
                held, first, n = patterns.pop(0)
                take = min(n, left)
                if take < n:
                    insort(patterns, (held, first + take, n - take))
            else:
                held, first, take = 0, fresh, left
                fresh += take
            placed.append((length, rank, take, first, held))
            moved.append((held + length, first, take))
            rank, left = rank + take, left - take
            if not patterns or patterns[0][0] + length > most:  # those just filled may take more of this length
                for x in moved:
                    insort(patterns, x)
                moved = []
        for x in moved:
            patterns.insert(bisect_left(patterns, x), x)
    return placed


def pack(pieces: DataFrame, most: int = 2048) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: sequences of at most ``most`` ids, filled from 0 without gaps.

    Only the histogram of lengths, by share, comes to the driver. Rows are numbered within a length and share, and a
    row's number leads to its placement. Which of the pieces of one length goes where hangs on how they are stored.
    Repeated pieces and those with a null id are placed like others; an empty table gives an empty one.
    """
    pieces = durable(pieces)
    totals = np.zeros(most + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        totals[row["length"]] = row["count"]
    shares = -(-totals // max(ROWS, -(-int(totals.sum()) // SHARES)))
    first = np.cumsum(shares) - shares
    # by place in the written pieces, not by id, so that no id and no null puts its rows into one share
    used = np.flatnonzero(totals)
    of_length = pieces.sparkSession.createDataFrame(list(zip(used.tolist(), shares[used].tolist(), first[used].tolist(), strict=True)), "length long, _shares long, _first long")
    dealt = pieces.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(of_length), "length")  # a row for each length at most
    keyed = dealt.select(*pieces.columns, (F.col("_first") + F.pmod("_at", "_shares")).cast("int").alias("share"))
    held = np.zeros(int(shares.sum()), dtype=np.int64)
    for row in keyed.groupBy("share").count().collect():
        held[row["share"]] = row["count"]
    before = np.cumsum(held) - held
    before -= np.repeat(before[first[shares > 0]], shares[shares > 0])
    placed = np.array(shortest_pack_first({int(n): int(totals[n]) for n in np.nonzero(totals)[0]}, most), dtype=np.int64).reshape(-1, 5)
    order = np.lexsort((placed[:, 1], placed[:, 0]))
    placed = placed[order]
    starts = placed[:, 0] << 44 | placed[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, share, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "share", "rank"))
            rank = rank - 1 + before[share]
            at = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            kept = [c for c in batch.schema.names if c not in ("share", "rank")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(placed[at, 3] + rank - placed[at, 1]), pa.array(placed[at, 4])],
                [*kept, "sequence_id", "offset"],
            )

    numbered = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("share").orderBy("doc_id", "start")).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return shipped(numbered).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1) -> DataFrame:
    """All documents cut and packed; see ``cut_documents`` and ``pack``, also for odd rows."""
    return pack(cut_documents(docs, tokenizer, most, end_id), most)
