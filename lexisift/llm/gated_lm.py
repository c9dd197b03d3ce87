"""Log-likelihoods of whole documents by a gated recurrent language model, and by counts alone."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import InitVar, dataclass
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import shipped
from .common import count_terms, durable, most_frequent, remainder, slices, texts_of
from .word_table import LOWER, Words, WordTable

END = ""  # no word is empty
LOG10E = float(np.log10(np.e))
#: Text that a copy of the model learns from at once: documents of many lengths go through it side by side.
HELD = 12 << 20
#: Tokens that are scored at once: the longest documents are alone at the end, so the more there are beside them the
#: fewer steps are nearly empty.
SCORED = 1 << 22


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of anything but the six ASCII blanks; the end is not among them."""
    return text.encode().translate(LOWER).split()


#: Tokens that a copy of the model learns from in a round.
EACH = 1 << 20


@dataclass
class Vocabulary:
    """Bounded tables about words: counts of frequent ones, and which of them the model knows one by one.

    The most frequent words, and the end, are symbols in classes of like frequency. All others, seen or not,
    are in classes by their last two characters; within those a word's share is that of its count.
    """

    known: InitVar[dict[bytes, int]]  # counts of frequent words, the end among them
    symbols: dict[bytes, int]  # in order of frequency
    symbol_counts: np.ndarray
    width: int  # symbols in a class
    endings: int
    ending_mass: np.ndarray  # sum of count + 0.1 of each class by ending, with 0.1 for a word not seen
    train_tokens: int
    distinct: int

    def __post_init__(self, known: dict[bytes, int]):
        end = END.encode()
        self.counts = np.fromiter(known.values(), dtype=np.float64, count=len(known))
        self.at_end, self.end_code = list(known).index(end), self.symbols[end]
        place = {w: i for i, w in enumerate(known)}
        words = [w for w in place.keys() | self.symbols.keys() if w != end]
        code = lambda w: self.symbols.get(w, len(self.symbols) + self.ending(w))
        self.table = WordTable(words, np.array([code(w) | place.get(w, -1) + 1 << 20 for w in words], dtype=np.int64))
        two = lambda b: zlib.crc32(bytes([b >> 8, b & 255])) % self.endings
        self.two = np.array([two(b) for b in range(1 << 15)], dtype=np.int64)  # of two ASCII characters
        self.one = np.array([zlib.crc32(bytes([b])) % self.endings for b in range(128)], dtype=np.int64)

    def ending(self, word: bytes) -> int:
        """The class of a word by its last two characters."""
        return zlib.crc32(word[-2:] if word.isascii() else word.decode()[-2:].encode()) % self.endings

    def _endings(self, words: Words, at: np.ndarray) -> np.ndarray:
        """The same of some of the words of many texts."""
        stops = words.stops[at]
        last, before = words.bytes[stops - 1].astype(np.int64), words.bytes[stops - 2].astype(np.int64)
        single = stops - words.starts[at] == 1
        out = np.where(single, self.one[last & 127], self.two[(before & 127) << 8 | last & 127])
        odd = np.flatnonzero((last > 127) | (before > 127) & ~single)
        out[odd] = [self.ending(w) for w in words.spelt(at[odd])]
        return out

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
        """Codes of the words of each text and then its end, one text after the other; their places among the known
        counts, or -1; where in both each text begins; and the words themselves.

        A code is a word's own symbol, or past the symbols the class of its ending.
        """
        words = Words(texts)
        both = self.table.find(words)
        other = np.flatnonzero(both < 0)
        both[other] = len(self.symbols) + self._endings(words, other)
        n, text = len(both), np.arange(len(texts))
        ends = np.cumsum(words.counts) + text
        own = np.arange(n) + np.repeat(text, words.counts)
        codes, places = np.full(n + len(texts), self.end_code, dtype=np.int32), np.full(n + len(texts), self.at_end)
        codes[own], places[own] = both & 0xFFFFF, (both >> 20) - 1
        return codes, places, ends - words.counts, words


def _sigmoid(x: np.ndarray) -> None:
    """In place; where the exponential overflows the result is 0, as it should be."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _chosen(scores: np.ndarray, of: np.ndarray, bounded: bool, slopes: bool) -> np.ndarray:
    """Log-probabilities of choices ``of`` under a softmax of each row; with ``slopes``, the loss's slope in ``scores`` takes their place.

    ``bounded``: no score can be so large or all so small that its exponential is lost.
    """
    if not bounded:
        scores -= scores.max(axis=1, keepdims=True)
    at = np.arange(0, scores.size, scores.shape[1]) + of
    flat = scores.reshape(-1)
    out = flat.take(at)
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], dtype=scores.dtype)
    out -= np.log(total)
    if slopes:
        scores *= (1 / total)[:, None]
        flat[at] -= 1
    return out


class GatedModel:
    """A gated recurrent unit under a softmax over classes and one over the symbols of a class.

    ``X``: what each code adds to the gates; ``U``, ``N``: what the state adds to gates and candidate; ``C``, ``c``:
    class scores; ``W``, ``w``: scores of the codes of each class. Symbols fill classes of ``width`` in order, then
    endings fill others. It starts as the unigram of ``counts`` and of the masses of ``endings``.
    """

    NAMES = ("X", "U", "N", "C", "c", "W", "w")

    def __init__(self, counts: np.ndarray, endings: np.ndarray, width: int, state: int = 16, seed: int = 5):
        draw = np.random.default_rng(seed)
        n, self.width, self.state = len(counts), width, state
        self.symbols, self.gap = n, -n % width  # places left empty in the last class of symbols
        self.classes = -(-n // width) - (-len(endings) // width)
        spread = np.arange(n + len(endings))
        spread[n:] += self.gap
        self.class_of, self.place_of = (spread // width).astype(np.int16), spread % width
        small = lambda *shape: (draw.normal(size=shape) * 0.3 / np.sqrt(state)).astype(np.float32)
        self.X, self.U, self.N = small(n + len(endings), 3 * state) * 4, small(state, 2 * state), small(state, state)
        self.X[:, :state] -= 1  # gates start half shut, so that the state lasts
        padded = np.zeros(self.classes * width)
        padded[:n], padded[n + self.gap : n + self.gap + len(endings)] = counts + 0.1, endings
        padded = padded.reshape(-1, width)
        self.C, self.c = small(state, self.classes) * 0.1, np.log(padded.sum(axis=1) / padded.sum()).astype(np.float32)
        self.W = small(self.classes, state, width) * 0.1
        with np.errstate(divide="ignore"):
            self.w = np.maximum(np.log(padded), -1e4).astype(np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES])

    def set_weights(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next states, units x lanes, from the last ones and what symbols add; and what the way back needs."""
        k = self.state
        zr = self.U.T @ h
        zr += x[: 2 * k]
        _sigmoid(zr)
        rh = zr[k:] * h
        m = self.N.T @ rh
        m += x[2 * k :]
        np.tanh(m, out=m)
        after = m - h
        after *= zr[:k]
        after += h
        return after, zr, m, rh

    def _added(self, block: np.ndarray) -> np.ndarray:
        """What the symbols of a window add to gates and candidates: places x units x lanes."""
        return np.ascontiguousarray(self.X.take(block, axis=0).transpose(0, 2, 1))

    @staticmethod
    def _bounded(weights: np.ndarray, biases: np.ndarray) -> bool:
        """Whether the greatest score of each softmax is near enough to 0 for single precision; states lie between -1 and 1."""
        return bool(np.abs(weights).sum(axis=-2).max() + np.abs(biases.max(axis=-1)).max() < 80)

    def logs(self, h: np.ndarray, codes: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of ``codes`` after states ``h``; adds to ``grads`` and returns the loss's slope in ``h``."""
        of = self.class_of.take(codes)
        order = np.argsort(of, kind="stable")  # by class, so that each class is one slice
        of, inner = of.take(order), self.place_of.take(codes.take(order))
        ends = np.searchsorted(of, np.arange(self.classes + 1)).tolist()
        bounded = [self._bounded(self.C, self.c[None]), self._bounded(self.W, self.w)]
        weights, inner_weights = np.concatenate([self.C, self.c[None]]), np.concatenate([self.W, self.w[:, None]], axis=1)
        h = np.concatenate([h.take(order, axis=0), np.ones((len(order), 1), dtype=weights.dtype)], axis=1)  # biases go with the ones
        scores, slopes = h @ weights, grads is not None
        logs, dh = _chosen(scores, of, bounded[0], slopes), None
        if slopes:
            told, dh = h.T @ scores, scores @ self.C.T
            grads["C"] += told[:-1]
            grads["c"] += told[-1]
        parts = [(k, slice(i, j)) for k, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
        scores = np.empty((len(order), self.width), dtype=weights.dtype)
        for k, part in parts:
            np.matmul(h[part], inner_weights[k], out=scores[part])
        logs += _chosen(scores, inner, bounded[1], slopes)
        if slopes:
            told = np.zeros_like(inner_weights)
            for k, part in parts:
                np.matmul(h[part].T, scores[part], out=told[k])
                dh[part] += scores[part] @ self.W[k].T
            grads["W"] += told[:, :-1]
            grads["w"] += told[:, -1]
        out = np.empty_like(logs)
        out[order] = logs
        if grads is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    @np.errstate(over="ignore")
    def score(self, texts: list[np.ndarray], window: int = 64, side: int = 256) -> np.ndarray:
        """Natural log-likelihoods of sequences of codes, each whole: the state goes on from window to window."""
        out = np.zeros(len(texts))
        codes, whose, loads = _lanes(texts, side)
        h = np.zeros((self.state, len(loads)), dtype=np.float32)
        held: list[tuple[np.ndarray, ...]] = []  # states, codes and texts of windows whose logs are still to be found
        rows, longest = 0, int(loads[0]) if len(loads) else 0
        for start in range(0, longest, window):
            n = int((loads > start).sum())
            block, of, begins = _window(codes, whose, n, start, window)
            h, x, anew = np.ascontiguousarray(h[:, :n]), self._added(block), begins.any(axis=1).tolist()
            states = np.empty((len(block), self.state, n), dtype=np.float32)
            for t in range(len(block)):
                if anew[t]:
                    h[:, begins[t]] = 0
                states[t] = h
                h = self.step(h, x[t])[0]
            of, live = of.reshape(-1), np.flatnonzero(of.reshape(-1) >= 0)
            held.append((_some(_rows(states), live), _some(block.reshape(-1), live), _some(of, live)))
            rows += len(live)
            if rows >= window * side or start + window >= longest:  # where few lanes are left, of many windows at once
                states, block, of = (np.concatenate(x) for x in zip(*held))
                out += np.bincount(of, self.logs(states, block)[0], minlength=len(texts))
                held, rows = [], 0
        return out

    @np.errstate(over="ignore")
    def train(self, texts: list[np.ndarray], rate: float = 0.02, window: int = 32, side: int = 256, part: int = 1024) -> None:
        """One pass of truncated backpropagation: slopes go back to the start of a window, the state goes on through it.

        A text of more than ``part`` codes is learned from in parts, so that few long texts do not leave lanes empty.
        """
        means = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        squares = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        times, k = 0, self.state
        parts = [t[i : i + part] for t in texts for i in range(0, len(t), part)]
        codes, whose, loads = _lanes(parts, side, np.random.default_rng(len(texts)))
        h = np.zeros((k, len(loads)), dtype=np.float32)
        for start in range(0, int(loads[0]) if len(loads) else 0, window):
            n = int((loads > start).sum())
            block, of, begins = _window(codes, whose, n, start, window)
            steps, h, x = len(block), np.ascontiguousarray(h[:, :n]), self._added(block)
            live, flat_codes, anew = np.flatnonzero(of.reshape(-1) >= 0), block.reshape(-1), begins.any(axis=1).tolist()
            states = np.empty((steps, k, n), dtype=self.X.dtype)
            kept = []
            for t in range(steps):
                if anew[t]:
                    h[:, begins[t]] = 0
                states[t] = h
                h, *more = self.step(h, x[t])
                kept.append(more)
            grads = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
            slopes = self.logs(_some(_rows(states), live), _some(flat_codes, live), grads)[1]
            if len(live) < steps * n:
                every = np.zeros((steps * n, k), dtype=np.float32)
                every[live] = slopes
                slopes = every
            slopes = np.ascontiguousarray(slopes.reshape(steps, n, k).transpose(0, 2, 1))
            dx = np.empty((steps, 3 * k, n), dtype=np.float32)
            reset = np.empty((steps, k, n), dtype=np.float32)
            dh = np.zeros((k, n), dtype=np.float32)
            for t in range(steps - 1, -1, -1):
                zr, m, reset[t] = kept[t]
                before, gates, dm = states[t], dx[t, : 2 * k], dx[t, 2 * k :]
                passed = dh * zr[:k]
                np.multiply(m, m, out=dm)
                np.subtract(1, dm, out=dm)
                dm *= passed
                drh = self.N @ dm
                m -= before
                np.multiply(passed, m, out=gates[:k])
                drh *= zr[k:]
                np.multiply(drh, before, out=gates[k:])
                np.subtract(1, zr, out=zr)
                gates *= zr
                dh -= passed
                dh += drh
                dh += self.U @ gates
                dh += slopes[t]
                if anew[t]:
                    dh[:, begins[t]] = 0
            by_unit = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)
            by_x, of_code = by_unit(dx), flat_codes.astype(np.intp)
            grads["N"] += by_unit(reset) @ by_x[2 * k :].T
            grads["U"] += by_unit(states) @ by_x[: 2 * k].T
            for unit in range(3 * k):
                grads["X"][:, unit] = np.bincount(of_code, by_x[unit], minlength=len(self.X))
            times += 1
            tokens = len(live)
            own_rate = rate * tokens / (window * side)  # a step as long as its tokens are many, so that the last windows do not lead
            for name, g in grads.items():
                g /= max(1, tokens)
                mean, square = means[name], squares[name]
                mean += 0.1 * (g - mean)
                g *= g
                square += 0.01 * (g - square)
                getattr(self, name).__isub__(own_rate / (1 - 0.9**times) * mean / (np.sqrt(square / (1 - 0.99**times)) + 1e-6))


def _lanes(texts: list[np.ndarray], side: int, draw: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts dealt to at most ``side`` lanes, the longest first and each to the lane with the least; there they stand in the order of ``draw``.

    Codes and numbers of texts, lanes x places, -1 behind the end; and how much each lane holds, the fullest first.
    """
    held = [(0, i) for i in range(min(side, len(texts)))]
    dealt: list[list[int]] = [[] for _ in held]
    for j in sorted(range(len(texts)), key=lambda j: -len(texts[j])):
        load, lane = held[0]
        dealt[lane].append(j)
        heapreplace(held, (load + len(texts[j]), lane))
    held.sort(reverse=True)
    loads = np.array([load for load, _ in held], dtype=np.int64)
    codes = np.zeros((len(held), int(loads[0]) if len(held) else 0), dtype=np.int32)
    whose = np.full(codes.shape, -1, dtype=np.int32)
    for row, (load, lane) in enumerate(held):
        if load:
            if draw is not None:
                draw.shuffle(dealt[lane])
            codes[row, :load] = np.concatenate([texts[j] for j in dealt[lane]])
            whose[row, :load] = np.repeat(dealt[lane], [len(texts[j]) for j in dealt[lane]])
    return codes, whose, loads


def _some(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Some rows in order, without a copy where it is all of them."""
    return rows if len(which) == len(rows) else rows.take(which, axis=0)


def _rows(a: np.ndarray) -> np.ndarray:
    """Places x units x lanes as a row of units for each place and lane."""
    return a.transpose(0, 2, 1).reshape(-1, a.shape[1])


def _window(codes: np.ndarray, whose: np.ndarray, n: int, start: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first ``n`` lanes, places x lanes: codes, whose they are, and whether a text begins there."""
    of = whose[:n, max(0, start - 1) : start + window].T
    begins = np.concatenate([np.ones((1, n), dtype=bool), of[1:] != of[:-1]])
    if start:
        of, begins = of[1:], begins[1:]
    return np.ascontiguousarray(codes[:n, start : start + window].T), np.ascontiguousarray(of), begins


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of all tokens of ``texts``, the end among them as the empty word."""
    return count_terms(texts, lambda: lambda text: (words_of(text), [END.encode()])).withColumnRenamed("term", "word")


def make_vocabulary(counts: DataFrame, known: int = 1 << 18, symbols: int = 1024, width: int = 32, endings: int = 32) -> Vocabulary:
    """From (word, c): at most ``known`` words come to the driver, the most frequent ones, and sums."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    frequent = sorted(((r["word"].encode(), r["c"]) for r in most_frequent(counts, known).collect()), key=lambda x: (-x[1], x[0]))
    end = END.encode()
    one_by_one = dict([(w, c) for w, c in frequent if w != end][: symbols - 1])
    one_by_one[end] = dict(frequent).get(end, 0) or int((counts.where(F.col("word") == END).agg(F.sum("c")).first()[0]) or 0)
    ranked = sorted(one_by_one.items(), key=lambda x: (-x[1], x[0]))
    made = Vocabulary(dict(frequent) | {end: one_by_one[end]}, {w: i for i, (w, _) in enumerate(ranked)}, np.array([c for _, c in ranked], dtype=np.float64), width, endings, np.full(endings, 0.1), int(total["n"] or 0), int(total["v"]))
    ending = F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(endings)).cast("int")
    for r in counts.groupBy(ending.alias("k")).agg((F.sum("c") + 0.1 * F.count("*")).alias("mass")).collect():
        made.ending_mass[r["k"]] += r["mass"]
    for w, c in ranked:
        if c:
            made.ending_mass[made.ending(w)] -= c + 0.1
    made.ending_mass = np.maximum(made.ending_mass, 0.1)
    return made


def _train_round(texts: DataFrame, model: GatedModel, vocabulary: Vocabulary, rate: float, copies: int) -> None:
    """``copies`` copies learn from a share of the texts each; their mean, weighted by tokens, is the model from then on.

    Texts are dealt to copies and put in order by a hash, so what a copy learns does not depend on how the table is
    partitioned; a task may train several, one after the other. The weights are summed by place before they come to
    the driver, which sees one set of them.
    """
    drawn = F.xxhash64("doc_id", "text").alias("drawn")
    keyed = texts.select("text", drawn).withColumn("copy", F.pmod("drawn", F.lit(copies)))
    dealt = keyed.repartition(copies, "copy").sortWithinPartitions("copy", "drawn").select("text", "copy")
    shared = texts.sparkSession.sparkContext.broadcast((model, vocabulary))

    def told(own: GatedModel, tokens: int) -> Iterator[pa.RecordBatch]:
        flat = own.weights().astype(np.float64) * tokens
        for i in range(0, len(flat), 1000):
            piece = flat[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(piece))), pa.array(piece), pa.array(np.full(len(piece), tokens))], ["place", "total", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens, now = None, 0, None
        for batch in batches:
            copy = batch.column("copy").to_numpy()
            cuts = [0, *(np.flatnonzero(copy[1:] != copy[:-1]) + 1).tolist(), len(copy)]
            for i, j in zip(cuts, cuts[1:]):
                for part in slices(batch.slice(i, j - i), most_bytes=HELD):
                    if own is None or copy[i] != now:
                        if own is not None:
                            yield from told(own, tokens)
                        begun, words = shared.value
                        own, tokens, now = GatedModel(words.symbol_counts, words.ending_mass, words.width, begun.state), 0, copy[i]
                        own.set_weights(begun.weights())
                    learned: list[np.ndarray] = []
                    for piece in slices(part):
                        codes, _, begins, _ = words.read(piece.column("text").to_pylist())
                        learned += np.split(codes, begins[1:])
                        tokens += len(codes)
                    own.train(learned, rate)
        if own is not None:
            yield from told(own, tokens)

    rows = shipped(dealt).mapInArrow(run, "place long, total double, tokens long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("tokens").alias("tokens")).collect()
    if rows:
        flat = model.weights()
        for r in rows:
            flat[r["place"]] = r["total"] / r["tokens"]
        model.set_weights(flat)


def fit(texts: DataFrame, rounds: int = 3, state: int = 16, rate: float = 0.02) -> tuple[DataFrame, Vocabulary, GatedModel]:
    """Word counts of all ``texts``, the bounded tables, and the model.

    Counts cover every text, and so do the recurrent weights: they learn in ``rounds``, each from another of as many
    parts of the texts by a hash of the id, so that every text is learned from once. In a round a copy of the model
    learns from about EACH tokens, and the copies are averaged by what they saw; there are as many as the tokens ask
    for, however the table is partitioned. Training begins anew after 1,024 codes of a text, scoring carries the state
    through all of it.
    """
    counts = durable(count_words(texts))
    vocabulary = make_vocabulary(counts)
    model = GatedModel(vocabulary.symbol_counts, vocabulary.ending_mass, vocabulary.width, state)
    part = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds))
    copies = max(1, -(-vocabulary.train_tokens // (rounds * EACH)))
    for i in range(rounds):
        _train_round(texts.where(part == i), model, vocabulary, rate / (1 + i), copies)
    return counts, vocabulary, model


#: Rows that are summed by document.
KINDS = {"row": pa.int64(), "doc_id": pa.int64(), "word": pa.string(), "times": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_part": pa.float64(), "model_part": pa.float64()}


def _score_rows(vocabulary: Vocabulary) -> Callable[[list, list[str], int], tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A row for each document with all that is known of it without the model, and one for each of its words whose count
    is not in the tables; and the codes of each document."""
    logs_of = np.append(np.log10(vocabulary.counts + 0.1), 0.0)  # the last is for a word of another count
    known_of = np.append(vocabulary.counts > 0, False)
    n_symbols = len(vocabulary.symbols)
    share = np.concatenate([np.zeros(n_symbols), np.log10(vocabulary.ending_mass)])

    def work(ids: list, texts: list[str], first_row: int) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        codes, places, begins, words = vocabulary.read(texts)
        by_text = lambda x: np.add.reduceat(x, begins)
        n, known, logs = words.counts + 1, by_text(known_of[places].astype(np.int64)), logs_of[places]
        base, model_part = by_text(logs), by_text(np.where(codes >= n_symbols, logs, 0.0) - share[codes])
        at = np.flatnonzero(places < 0)
        whose = np.searchsorted(begins, at, side="right") - 1
        spelt, cuts = words.spelt(at - whose), np.searchsorted(whose, np.arange(len(texts) + 1)).tolist()
        rest, of, times = [], [], []
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                found = Counter(spelt[i:j])
                rest += found
                times += found.values()
                of += [k] * len(found)
        rows = first_row + np.arange(len(texts))
        every = np.array(of, dtype=np.int64)
        doc_ids = pa.array(ids, pa.int64())
        none, zero = np.zeros(len(of), dtype=np.int64), np.zeros(len(of))
        join = lambda a, b, kind: pa.concat_arrays([pa.array(a, kind), pa.array(b, kind)])
        columns = [
            (rows, rows[every]), (doc_ids, doc_ids.take(pa.array(every))), ([f" {r}" for r in rows.tolist()], pa.array(rest, pa.binary()).cast(pa.string())),
            (np.zeros(len(rows), dtype=np.int64), np.array(times, dtype=np.int64)), (n, none), (known, none), (base, zero), (model_part, zero),
        ]
        return pa.RecordBatch.from_arrays([join(a, b, kind) for (a, b), kind in zip(columns, KINDS.values(), strict=True)], list(KINDS)), np.split(codes, begins[1:])

    return work


def _model_rows(model: GatedModel, rows: list[int], ids: list, codes: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each document with what the model adds to its score."""
    none, zero = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    columns = [rows, ids, [f" {r}" for r in rows], none, none, none, zero, model.score(codes) * LOG10E]
    return pa.RecordBatch.from_arrays([pa.array(a, kind) for a, kind in zip(columns, KINDS.values(), strict=True)], list(KINDS))


def _score_batches(batches: Iterator[pa.RecordBatch], tables: Callable[[], tuple[Vocabulary, GatedModel | None]], row: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task's documents, numbered from ``row`` on; texts are read slice by slice, the model scores many slices at once."""
    work, model = None, None
    rows, ids, codes, tokens = [], [], [], 0  # of documents that the model has still to score
    for batch in batches:
        for part in slices(batch):
            if work is None:
                vocabulary, model = tables()
                work = _score_rows(vocabulary)
            own = part.column("doc_id").to_pylist()
            out, more = work(own, part.column("text").to_pylist(), row)
            yield out
            if model:
                rows += range(row, row + len(own))
                ids += own
                codes += more
                tokens += sum(map(len, more))
                if tokens >= SCORED:
                    yield _model_rows(model, rows, ids, codes)
                    rows, ids, codes, tokens = [], [], [], 0
            row += len(own)
    if rows:
        yield _model_rows(model, rows, ids, codes)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Learns from documents whose id's crc32 modulo 10 is not 0, those with a null id among them. ``base_score`` is
    the log10-likelihood by smoothed counts, ``score`` that by the model: of each token the class after the
    state that the document so far has left, and its share in the class. Counts of frequent words are broadcast,
    in tables of a fixed size; those of all others are joined by word. A null text is empty: the end alone.
    Repeated rows are scored each; other columns are ignored; an empty table gives an empty one.
    """
    texts = texts_of(docs, id_col, text_col)
    return _scored(texts, *fit(texts.where(~_held()), **settings))


def count_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``score_documents`` tells without a model: all of its columns but ``score``, of the same rows."""
    texts = texts_of(docs, id_col, text_col)
    counts = durable(count_words(texts.where(~_held())))
    return _scored(texts, counts, make_vocabulary(counts), None).drop("score")


def _held() -> Column:
    return F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))


def _scored(texts: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: GatedModel | None) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score_batches(batches, lambda: shared.value, TaskContext.get().partitionId() << 40)

    schema = "row long, doc_id long, word string, times long, n_tokens long, n_known long, base_part double, model_part double"
    rows = shipped(texts).mapInArrow(run, schema).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rest = F.col("times") * F.log10(c + 0.1)
    sums = rows.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_part") + rest).alias("base"),
        F.sum(F.col("model_part") + rest).alias("score"),
    )
    each = float(np.log10(vocabulary.train_tokens + 0.1 * (vocabulary.distinct + 1)))
    return sums.select(
        "doc_id",
        _held().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocabulary.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.lit(each) * F.col("n_tokens")).alias("base_score"),
        "score",
    )
