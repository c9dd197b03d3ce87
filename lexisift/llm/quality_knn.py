"""Quality scores by a vote of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, map_texts, remainder, texts_of
from .quality_rules import label_sample

#: Terms are hashed to so many columns.
COLUMNS = 1 << 15
#: How much more a text's form says of its quality than its words.
FORM = 40.0
#: Characters of a word that have a shape of their own; a longer word has several.
PIECE = 64
#: Rows of a matrix that are multiplied at once on the driver.
SLAB = 256
_RUN = re.compile(r"(.)\1+", re.S)


def _shape(word: str) -> str:
    """Letters and digits by kind, other characters as they are, runs of the same as one: ``Ab12!!`` is ``Aa0!``."""
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "l" if c.isalpha() else c for c in word)
    return _RUN.sub(r"\1", kinds)


class Terms:
    """Hashed terms of texts: each word, its shape, and a mark for a word that equals one of the two before it."""

    def __init__(self, most: int = 200_000):
        self.most, self.table = most, {}
        self.again = self._hash("again")

    @staticmethod
    def _hash(term: str) -> int:
        return zlib.crc32(term.encode("utf-8", "surrogatepass")) % COLUMNS

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(columns, weights) of one text, columns once each in order.

        A word weighs 1 + ln of how often it stands there, a shape or the mark FORM times the root of its share.
        A word of more than PIECE characters has a shape for each piece of so many.
        """
        table = self.table
        if len(table) > self.most:
            table.clear()
        words = text.split()
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0)
        for w in set(words).difference(table):
            table[w] = self._hash("w" + w.lower()) | self._hash("s" + _shape(w[:PIECE])) << 16 | (len(w) > PIECE) << 32
        codes = np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words))
        counts, shapes = np.bincount(codes & 0xFFFF, minlength=COLUMNS), np.bincount(codes >> 16 & 0xFFFF, minlength=COLUMNS)
        shapes[self.again] += int((codes[1:] == codes[:-1]).sum()) + int((codes[2:] == codes[:-2]).sum())
        long = [words[k] for k in np.flatnonzero(codes >> 32)]
        more = [self._hash("s" + _shape(w[i : i + PIECE])) for w in long for i in range(PIECE, len(w), PIECE)]
        if more:
            shapes += np.bincount(more, minlength=COLUMNS)
        weights = np.log(np.maximum(counts, 1)) + (counts > 0) + FORM * np.sqrt(shapes / (len(words) + len(more)))
        at = np.flatnonzero(weights)
        return at, weights[at]


@dataclass
class Neighbours:
    """Weights and directions of terms, and the labelled documents as unit vectors with their labels."""

    directions: np.ndarray  # COLUMNS x d; a row is 0 for a term that says nothing
    vectors: np.ndarray  # n x d
    labels: np.ndarray  # n
    prior: float
    nearest: int = 25

    def place(self, terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(terms), self.directions.shape[1]))
        for i, (at, weight) in enumerate(terms):
            if len(at):
                v = weight @ self.directions[at]
                out[i] = v / (np.linalg.norm(v) or 1.0)
        return out

    def score(self, placed: np.ndarray, block: int = 512) -> np.ndarray:
        """The mean label of the nearest, weighted by similarity; the prior where nothing is similar."""
        out = np.full(len(placed), self.prior)
        k = min(self.nearest, len(self.labels))
        for i in range(0, len(placed) if k else 0, block):
            cosine = placed[i : i + block] @ self.vectors.T
            top = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, top, axis=1), 0) ** 2
            total = weight.sum(axis=1)
            found = total > 1e-9
            out[i : i + block][found] = (weight * self.labels[top]).sum(axis=1)[found] / total[found]
        return np.clip(out, 0.0, 1.0)


def leading(matrix: np.ndarray, k: int, guard: int = 16, depth: int = 6, rounds: int = 60, close: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, greatest first, and their vectors as columns.

    Block Krylov steps from the best vectors so far, until none misses by more than ``close`` of the greatest value,
    so that nothing of the matrix's size is held beside it, where taking it apart whole holds four more. A small
    matrix is taken apart whole, and so is one of which the steps have not come as close after ``rounds``.
    """
    n, width = len(matrix), k + guard
    draw = np.random.default_rng(7)
    begin = np.linalg.qr(draw.normal(size=(n, width)))[0] if n > 2 * width * depth else None
    for _ in range(rounds if begin is not None else 0):
        basis, image = begin, matrix @ begin
        for _ in range(depth - 1):
            more = image[:, -width:]
            for _ in range(3):
                more = np.linalg.qr(more - basis @ (basis.T @ more))[0]
            basis, image = np.hstack([basis, more]), np.hstack([image, matrix @ more])
        values, own = np.linalg.eigh(basis.T @ image)
        values, own = values[: -k - 1 : -1], own[:, : -width - 1 : -1]
        begin = basis @ own
        vectors = begin[:, :k]
        missed = np.linalg.norm(image @ own[:, :k] - vectors * values, axis=0).max()
        if missed <= close * abs(values[0]) and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9:
            return values, vectors
        begin = np.linalg.qr(begin)[0]
    values, vectors = np.linalg.eigh(matrix)
    return values[: -k - 1 : -1], vectors[:, : -k - 1 : -1]


def fit_neighbours(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = 2000, dimensions: int = 48, nearest: int = 25) -> Neighbours:
    """Latent-semantic vectors of at most ``most`` labelled documents, chosen by a hash of the id.

    ``learn``: which labels may be learned from, over their doc_id. What comes to the driver is bounded by
    ``most`` rows of at most COLUMNS terms; they are weighted by how few documents have them, and the vectors are the
    leading directions of that matrix. Without usable labels there are none and the prior is one half.
    """
    allowed = labels if learn is None else labels.where(learn)
    chosen = F.broadcast(durable(label_sample(allowed, most, "neighbours")))

    def make():
        terms = Terms()

        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = [terms.of(t) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a.astype("<u2").tobytes() for a, _ in found]), pa.array([w.astype("<f4").tobytes() for _, w in found])], ["doc_id", "at", "weight"])

        return work

    sample = map_texts(texts_of(docs).join(chosen, "doc_id", "left_semi"), make, "doc_id long, at binary, weight binary")
    rows = sample.join(chosen, "doc_id").select("doc_id", "quality", "at", "weight").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["at"], r["weight"]))
    n = len(rows)
    if not n:
        return Neighbours(np.zeros((COLUMNS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5, nearest)
    quality = np.array([r["quality"] for r in rows], dtype=np.float64)
    terms = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["weight"], "<f4")) for r in rows]
    del rows
    df = sum((np.bincount(at, minlength=COLUMNS) for at, _ in terms), np.zeros(COLUMNS, dtype=np.int64))
    useful = (df >= min(3, n)) & (df < n) | (df == n) & (n < 3)
    idf = np.where(useful, np.log((1 + n) / (1 + df)) + 0.1, 0.0)
    norm = np.array([max(float(np.linalg.norm(w * idf[at])), 1e-9) for at, w in terms])
    edges = range(0, COLUMNS + 1, 1024)
    ends = [np.searchsorted(at, edges).tolist() for at, _ in terms]

    def part(k: int) -> np.ndarray:
        """Some columns of the weighted matrix of unit rows, of which never more is held."""
        out = np.zeros((n, edges[k + 1] - edges[k]))
        for i, (at, w) in enumerate(terms):
            own = slice(ends[i][k], ends[i][k + 1])
            out[i, at[own] - edges[k]] = w[own] * idf[at[own]] / norm[i]
        return out

    gram = np.zeros((n, n))
    for k in range(len(edges) - 1):
        columns = part(k)
        for i in range(0, n, SLAB):
            gram[i : i + SLAB, : i + SLAB] += columns[i : i + SLAB] @ columns[: i + SLAB].T
    columns = None
    for i in range(SLAB, n, SLAB):
        gram[:i, i : i + SLAB] = gram[i : i + SLAB, :i].T
    values, left = leading(gram, min(dimensions, n))
    del gram
    values, left = values[values > 1e-9], left[:, values > 1e-9]
    directions = np.zeros((COLUMNS, max(1, len(values))))
    if len(values):
        for k in range(len(edges) - 1):
            directions[edges[k] : edges[k + 1]] = (part(k).T @ left) / np.sqrt(values) * idf[edges[k] : edges[k + 1], None]
    out = Neighbours(directions, np.zeros((0, directions.shape[1])), quality, 0.5, nearest)
    out.prior = float(out.labels.mean())
    out.vectors = out.place(terms)
    return out


def score_quality(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` by exact cosines to all labelled vectors, in blocks.

    The vectors are broadcast; their number and width are parameters of the fit, not of the data. A null or
    empty text has no terms and gets the prior; a null id stays null; repeated rows are scored each; other
    columns are ignored, or with ``keep`` come along in the struct ``row``; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        terms, known = Terms(), shared.value

        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            score = known.score(known.place([terms.of(t) for t in texts]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

        return work

    return map_texts(docs, make, "doc_id long, score double, predicted int", id_col, text_col, keep)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id modulo 3 is 1; not so for a null id."""
    return F.coalesce(remainder(id_col, 3) == 1, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = 2000) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from labels of documents that are not held out."""
    model = fit_neighbours(docs, labels, ~held_out(), most)
    return score_quality(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
