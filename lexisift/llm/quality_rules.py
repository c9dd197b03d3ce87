"""Quality rules: statistics of texts, and an ordered list of threshold conjunctions learned from labels."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, map_texts, texts_of

# White space between words, and the characters counted as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_exclaim", "n_lines", "n_echoes"]


def _statistics(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            end = 0  # one past the last word counted
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    upper = sum(map(data.count, _UPPER))
    lower = sum(map(data.count, _LOWER))
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        upper,
        upper + lower,
        data.count(b"!"),
        len(lines),
        sum(map(eq, words, words[1:])),
    )


_UPPER = [bytes([c]) for c in range(65, 91)]
_LOWER = [bytes([c]) for c in range(97, 123)]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id and the counts named in COUNTS, a row for each row of ``docs``, over whole texts.

    Words are runs of anything but the six ASCII blanks; ``n_upper`` and ``n_alpha`` count ASCII letters,
    ``n_echoes`` words that equal the one before. None of the ratios made of these drifts with the length of a
    text, as the share of distinct words would, so that long clean texts are judged as short ones.
    A null text is empty: all counts 0.
    """

    def make():
        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            rows = np.array([_statistics(t) for t in texts], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])

        return work

    return map_texts(docs, make, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS), id_col, text_col, keep)


#: What rules test, as a numerator and a denominator of counts.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "upper_letters": ("n_upper", "n_alpha"),
    "exclaims_per_word": ("n_exclaim", "n_words"),
    "echoes_per_word": ("n_echoes", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def ratio(name: str) -> Column:
    """One of RATIOS over the columns of ``text_statistics``; 0 where its denominator is."""
    top, bottom = (F.col(c) for c in RATIOS[name])
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Test:
    """A threshold on one ratio."""

    name: str
    above: bool
    value: float

    def column(self) -> Column:
        return ratio(self.name) >= self.value if self.above else ratio(self.name) < self.value

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.value if self.above else table[self.name] < self.value

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    """All tests together reject a document."""

    tests: tuple[Test, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.holds(table) for t in self.tests])

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gained on the documents to be rejected, as in first-order rule growing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> list[Test]:
    alive, tests = np.ones(len(bad), dtype=bool), []
    while len(tests) < most_tests and bad[alive].any() and not bad[alive].all():
        best: tuple[float, Test] | None = None
        p0, n0 = int(bad[alive].sum()), int((~bad[alive]).sum())
        for name, values in table.items():
            order = np.argsort(values[alive], kind="stable")
            v, b = values[alive][order], bad[alive][order]
            at = np.flatnonzero(np.diff(v) > 0) + 1  # places between different values
            if not len(at):
                continue
            p, n = np.cumsum(b)[at - 1], np.cumsum(~b)[at - 1]
            for above, gains in ((False, _gain(p0, n0, p, n)), (True, _gain(p0, n0, p0 - p, n0 - n))):
                i = int(np.argmax(gains))
                if best is None or gains[i] > best[0]:
                    best = (float(gains[i]), Test(name, above, float((v[at[i] - 1] + v[at[i]]) / 2)))
        if best is None or best[0] <= 0:
            break
        tests.append(best[1])
        alive &= best[1].holds(table)
    return tests


def _pruned(tests: list[Test], table: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, open_: np.ndarray, precision: float) -> list[list[Test]]:
    """The first tests of the list, those that do best on documents which did not grow it first.

    Only such that are right on ``precision`` of all documents that they cover and no rule has covered.
    """
    found, alive = [], open_
    for i, t in enumerate(tests):
        alive = alive & t.holds(table)
        p, n = int((bad & alive & held).sum()), int((~bad & alive & held).sum())
        if alive.any() and bad[alive].mean() >= precision:
            found.append(((p - n) / (p + n) if p + n else -1.0, -i))
    return [tests[: 1 - i] for _, i in sorted(found, reverse=True)]


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.98, least: int = 3, most_rules: int = 16, most_tests: int = 4, tries: int = 5, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds, prune it on the rest, drop what it covers, and again.

    A rule is right on ``precision`` of what it covers at least and covers ``least`` documents; when none such
    comes of ``tries`` draws of the thirds, the list ends. With no document to reject, or none to keep, there is
    no rule.
    """
    rules: list[Rule] = []
    draw = np.random.default_rng(seed)
    open_ = np.ones(len(bad), dtype=bool)
    failed = 0
    while len(rules) < most_rules and failed < tries and bad[open_].any() and not bad[open_].all():
        held = draw.random(len(bad)) < 1 / 3
        grown = open_ & ~held
        tests = _grow({k: v[grown] for k, v in table.items()}, bad[grown], most_tests)
        best = next(iter(_pruned(tests, table, bad, held, open_, precision)), [])
        alive = np.logical_and.reduce([t.holds(table) for t in best]) & open_ if best else np.zeros(len(bad), dtype=bool)
        if alive.sum() < least:
            failed += 1
            continue
        rules.append(Rule(tuple(best), float(bad[alive].mean()), int(alive.sum())))
        open_ &= ~alive
        failed = 0
    return rules


def label_sample(labels: DataFrame, most: int, seed: str = "labels") -> DataFrame:
    """(doc_id, quality) of up to ``most`` labelled documents, chosen by a hash of the id; small enough to broadcast.

    Labels that are null or neither 0 nor 1 are left out; of several for an id the least is taken. A cut of the
    hash that leaves a fifth more than asked for goes before the sort, which so sees as many rows at every size.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = F.xxhash64(F.col("doc_id"), F.lit(seed))
    if (n := usable.count()) > 2 * most:
        usable = usable.where(F.pmod(drawn, F.lit(1 << 30)) < int((1 << 30) * 1.2 * most / n))
    return usable.orderBy(F.pmod(drawn, F.lit(1 << 30)), "doc_id").limit(most)


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = 20_000, **settings) -> list[Rule]:
    """Rules from a sample of at most ``most`` labelled documents, the bound of what comes to the driver."""
    chosen = F.broadcast(durable(label_sample(labels, most)))
    stats = text_statistics(texts_of(docs).join(chosen, "doc_id", "left_semi")).join(chosen, "doc_id")
    rows = stats.select("quality", *(ratio(n).alias(n) for n in RATIOS)).collect()
    rows.sort(key=tuple)  # what is learned does not hang on the order in which tasks end
    table = {n: np.array([r[n] for r in rows], dtype=np.float64) for n in RATIOS}
    return learn_rules(table, np.array([r["quality"] == 0 for r in rows], dtype=bool), **settings) if rows else []


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with the number of the first rule that holds, null if none, and ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in windows that repeat. ``kept``: false if
    base_failed or a rule holds.
    """
    first = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        first = F.when(rule.column(), F.lit(i)).otherwise(first)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.withColumn("rule", first).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge_quality(docs: DataFrame, labels: DataFrame, most: int = 20_000, keep: bool = False) -> DataFrame:
    """Statistics, base verdict and verdict of every row of ``docs`` by rules learned from ``labels``.

    Without usable labels only the base rule judges. A null id stays null and a null text is empty, which the
    base rule rejects; repeated rows are judged each; other columns are ignored, or with ``keep`` come along in the
    struct ``row``; an empty table gives an empty one.
    """
    return apply_rules(text_statistics(docs, keep=keep), fit_rules(docs, labels, most))
