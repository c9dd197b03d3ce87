"""Token counts of texts under a given tokenizer file."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..shipping import shipped
from .byte_bpe import byte_level
from .common import count_terms, durable, most_frequent, slices, texts_of

#: Pre-tokens of more bytes are not broadcast, so that the table of frequent ones has a bounded size.
LONGEST = 64


def pre_token_sizes(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(term, c, n): each distinct pre-token of ``texts``, how often it stands there, and its pieces, counted once."""

    def make():
        return byte_level(tokenizer).pre_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_level(tokenizer)
        for batch in batches:
            for part in slices(batch, "term"):
                n = coder.sizes(part.column("term").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("term"), part.column("c"), pa.array(n, pa.int32())], ["term", "c", "n"])

    return shipped(count_terms(texts, make)).mapInArrow(run, "term string, c long, n int")


def _by_document(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) by the library, text by text, where a vocabulary has no pre-tokens of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".model"):
            from .piece_codec import piece_codec

            sizes = lambda texts: list(map(len, piece_codec(tokenizer).encode(texts)))
        else:
            sizes = byte_level(tokenizer).sizes
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(sizes(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return shipped(texts).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _by_pre_token(texts: DataFrame, tokenizer: str, known: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) by frequencies of pre-tokens."""
    sizes = durable(pre_token_sizes(texts, tokenizer))
    frequent = most_frequent(sizes.where(F.octet_length("term") <= LONGEST), known).select("term", "n").collect()
    shared = texts.sparkSession.sparkContext.broadcast({r["term"]: r["n"] for r in frequent})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = byte_level(tokenizer), shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column("doc_id"), part.column("text").to_pylist()
                counted, rest, times, of = [], [], [], []
                for k, text in enumerate(texts):
                    frequencies: Counter = Counter()
                    for own in coder.pre_tokens(text):
                        frequencies.update(own)
                    n = 0
                    for term, c in frequencies.items():
                        size = table.get(term)
                        if size is None:
                            rest.append(term)
                            times.append(c)
                            of.append(k)
                        else:
                            n += c * size
                    counted.append(n)
                rows, at = row + np.arange(len(texts)), np.array(of, dtype=np.int64)
                row += len(texts)
                none = np.zeros(len(rest), dtype=np.int64)
                join = lambda a, b, kind: pa.concat_arrays([pa.array(a, kind), pa.array(b, kind)])
                columns = {
                    "row": join(rows, rows[at], pa.int64()),
                    "doc_id": pa.concat_arrays([ids, ids.take(pa.array(at))]),
                    "term": join([f"\n{r}" for r in rows.tolist()], rest, pa.string()),  # a row of its own: no pre-token looks so
                    "times": join(np.zeros(len(texts), dtype=np.int64), times, pa.int64()),
                    "n_bytes": join([len(t.encode()) for t in texts], none, pa.int64()),
                    "counted": join(counted, none, pa.int64()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = shipped(texts).mapInArrow(run, "row long, doc_id long, term string, times long, n_bytes long, counted long")
    told = rows.join(sizes.select("term", "n"), "term", "left")
    n = F.sum(F.col("counted") + F.col("times") * F.coalesce("n", F.lit(0)))
    return told.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), n.alias("n_tokens")).drop("row")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, known: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``.

    The pieces of each distinct pre-token of the corpus are counted once. A document is then the frequencies of
    its pre-tokens: those of the ``known`` most frequent ones, which are broadcast, are summed where it is read, all
    others are joined to their counts by pre-token and summed. No ids of a document are ever made.

    ``tokenizer``: a tokenizers .json or a sentencepiece .model. A vocabulary that is not byte-level has no
    pre-tokens with pieces of their own, and its texts go to the library one by one. Special strings inside texts
    count as that library does by default; no begin, end or padding is counted. A null text is empty and has 0
    tokens; a null id stays null; repeated rows are counted each; a text of any length is counted in parts; other
    columns are ignored; an empty table gives an empty one.
    """
    texts = texts_of(docs, id_col, text_col)
    by_pre_token = not tokenizer.endswith(".model") and byte_level(tokenizer).parts_alone
    out = _by_pre_token(texts, tokenizer, known) if by_pre_token else _by_document(texts, tokenizer)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
