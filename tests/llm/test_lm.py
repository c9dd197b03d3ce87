import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexisift.llm.gated_lm import GatedModel, score_documents
from lexisift.llm.queries import QUERIES


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def brute(texts):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    counts = Counter(w for i, t in texts if not held[i] for w in tokens(t))
    n = sum(counts.values())
    out = {}
    for i, t in texts:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in own)
        out[i] = (held[i], len(own), sum(counts[w] > 0 for w in own), n, base)
    return out


def check(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, row int")
    got = {r.doc_id: r for r in score_documents(docs, **settings).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * (1 + abs(w[4]))
        assert -1e9 < r.score < 0
    return got


def test_base_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = check(spark, rows, rounds=1)
    assert sum(r.score for r in got.values()) > 1.01 * sum(r.base_score for r in got.values())  # so few texts teach next to nothing


def test_rare_words_are_joined(spark, monkeypatch):
    from lexisift.llm import gated_lm

    plain = gated_lm.make_vocabulary
    monkeypatch.setattr(gated_lm, "make_vocabulary", lambda counts: plain(counts, known=20, symbols=8, width=4, endings=4))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    check(spark, rows, rounds=1)


def test_odd_rows(spark):
    check(spark, [(i, t) for i, t in enumerate(["", None, "a", "A a\tb", "É é \x1c x\x85y", "new words", "b " * 3000])] + [(None, "a z")])
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    unlearned = score_documents(spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in unlearned)


def small():
    draw = np.random.default_rng(1)
    model = GatedModel(np.array([9.0, 7, 5, 3, 2, 1]), np.array([2.0, 3.0]), 3, state=4)
    for name in model.NAMES:
        getattr(model, name).__iadd__(draw.normal(size=getattr(model, name).shape).astype(np.float32) * 0.3)
    return model


def test_shares_of_the_next_symbol_add_up_to_one():
    model = small()
    h = np.random.default_rng(2).normal(size=(1, 4)).astype(np.float32)
    logs = [model.logs(h, np.array([c]))[0][0] for c in range(8)]
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_whole_texts_whatever_the_windows():
    model = small()
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 8, n).astype(np.int32) for n in (1, 2, 150, 64, 65, 7, 129, 1)]

    def alone(t):
        h, total = np.zeros((1, 4), dtype=np.float32), 0.0
        for c in t:
            total += model.logs(h, np.array([c]))[0][0]
            h = model.step(h.T, model.X[[c]].T)[0].T
        return total

    want = [alone(t) for t in texts]
    assert np.allclose(model.score(texts), want, rtol=1e-5) and np.allclose(model.score(texts, window=5, side=2), want, rtol=1e-5)
    assert np.allclose(model.score(texts, window=1, side=3), want, rtol=1e-5) and model.score([]).shape == (0,)


def test_windows_with_few_texts_left_are_looked_up_together(monkeypatch):
    """One long text beside short ones: scores of symbols are made of as many places as a full window has, not of 64."""
    model, draw = small(), np.random.default_rng(6)
    texts = [draw.integers(0, 8, n).astype(np.int32) for n in (6400, 70, 1, 30)]
    calls, plain = [], GatedModel.logs
    monkeypatch.setattr(GatedModel, "logs", lambda self, h, *rest: calls.append(len(h)) or plain(self, h, *rest))
    got = model.score(texts)
    assert calls == [sum(map(len, texts))]
    assert np.allclose(got, model.score(texts, window=7, side=2), rtol=1e-5) and len(calls) > 100


def test_a_task_scores_its_slices_together(monkeypatch):
    import pyarrow as pa

    from lexisift.llm import gated_lm

    counts = {b"a": 3, b"": 2, b"b": 1}
    voc = gated_lm.Vocabulary(counts, {b"a": 0, b"": 1}, np.array([3.0, 2.0]), 2, 4, np.ones(4), 6, 3)
    model = GatedModel(voc.symbol_counts, voc.ending_mass, 2, state=4)
    texts = ["A b c", "", "a a " * 50, "b", "c b a", "a"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(i, i + 2)), "text": texts[i : i + 2]}) for i in (0, 2, 4)]
    calls, plain = [], GatedModel.score
    monkeypatch.setattr(GatedModel, "score", lambda self, of: calls.append(len(of)) or plain(self, of))

    def sums():
        out = {}
        for r in pa.Table.from_batches(gated_lm._score_batches(iter(batches), lambda: (voc, model), 100)).to_pylist():
            key = (r["row"], r["doc_id"], r["word"] if r["times"] else None)
            out[key] = out.get(key, 0) + np.array([r[c] for c in ("times", "n_tokens", "n_known", "base_part", "model_part")])
        return out

    whole = sums()
    assert calls == [6] and {k[:2] for k in whole} == {(100 + i, i) for i in range(6)} and (100, 0, "c") in whole
    monkeypatch.setattr(gated_lm, "SCORED", 1)
    parts = sums()
    assert calls[1:] == [2, 2, 2] and whole.keys() == parts.keys() and all(np.allclose(whole[k], parts[k], rtol=1e-5) for k in whole)


@pytest.mark.parametrize("name", GatedModel.NAMES)
def test_slopes(name):
    """Training on one window moves each weight against the slope that small steps of the loss show."""
    draw = np.random.default_rng(4)
    texts = [draw.integers(0, 8, n).astype(np.int32) for n in (12, 9, 5)]  # two of them in one lane
    model = small()
    for n in model.NAMES:
        setattr(model, n, getattr(model, n).astype(np.float64))
    before = getattr(model, name).copy()
    slope = np.zeros_like(before)
    for i in np.ndindex(before.shape):
        both = []
        for s in (1e-4, -1e-4):
            getattr(model, name)[i] = before[i] + s
            both.append(-model.score(texts).sum())
            getattr(model, name)[i] = before[i]
        slope[i] = (both[0] - both[1]) / 2e-4
    model.train(texts, rate=1e-3, window=20, side=2)
    moved = getattr(model, name) - before
    big = np.abs(slope) > 0.02
    assert big.any() and (np.sign(moved[big]) == -np.sign(slope[big])).mean() > 0.99


def test_a_very_long_text_and_tables_that_are_handed_on(spark):
    import pickle

    from lexisift.llm.gated_lm import Vocabulary

    got = check(spark, [(3, "one Two three " * 60_000), (4, "one two"), (5, "x" * 300_000)], rounds=1)
    assert got[3].n_tokens == 180_001 and got[3].score > got[3].base_score
    voc = Vocabulary({b"a": 3, b"": 2, b"b": 1}, {b"a": 0, b"": 1}, np.array([3.0, 2.0]), 2, 4, np.ones(4), 6, 3)
    again = pickle.loads(pickle.dumps(voc))
    for v in (voc, again):
        codes, places, begins, words = v.read(["A b c é", "", " a\tyz "])
        assert begins.tolist() == [0, 5, 6] and words.counts.tolist() == [4, 0, 2]
        assert codes[[0, 4, 5, 6, 8]].tolist() == [0, 1, 1, 0, 1] and places.tolist() == [0, 2, -1, -1, 1, 1, 0, -1, 1]
        assert codes[[1, 2, 3, 7]].tolist() == [2 + v.ending(w) for w in (b"b", b"c", "é".encode(), b"yz")]


def test_words_of_many_texts_at_once():
    from lexisift.llm.word_table import CHUNK, Words, WordTable

    draw = np.random.default_rng(8)
    long = "ab" * CHUNK
    texts = ["", "É a\x85b\x1cC \t\n\x0b\x0c\r d", long, f"x {long}c y", *("".join(chr(c) for c in draw.choice([9, 32, 65, 66, 97, 0xE9, 0x4E2D, 0x1F600], n)) for n in draw.integers(0, 60, 3000))]
    words = Words(texts)
    want = [w for t in texts for w in [x.encode() for x in tokens(t)[:-1]]]
    assert words.spelt(np.arange(len(want))) == want and words.counts.tolist() == [len(tokens(t)) - 1 for t in texts]
    distinct = sorted(set(want))
    assert len(np.unique(words.hashes)) == len(distinct)
    table = WordTable(distinct[::2], np.arange(len(distinct[::2])))
    place = {w: i for i, w in enumerate(distinct[::2])}
    assert table.find(words).tolist() == [place.get(w, -1) for w in want]
    assert WordTable([], np.empty(0, dtype=np.int64)).find(words).max() == -1


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of 2**n letters whose hashes by any polynomial modulo 2**64 are the same from n = 10 on."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [3, 10, 11, 12])
def test_words_of_one_hash_are_told_apart(n):
    from lexisift.llm.word_table import Words, WordTable

    a, b = thue_morse(n)
    words = Words([f"{a} {b} x {a}{b}"])
    assert (words.hashes[0] == words.hashes[1]) == (n > 9)
    assert WordTable([a.encode()], np.array([5])).find(words).tolist() == [5, -1, -1, -1]
    assert WordTable([a.encode(), b"x", b.encode()], np.array([5, 6, 7])).find(words).tolist() == [5, 7, 6, -1]


def test_words_of_one_front_are_told_apart():
    from lexisift.llm.word_table import Words, WordTable

    known = [b"a", b"a\0", b"12345678", b"123456789", b"1234567890abcdefg"]
    words = Words(["a a\0 a\0\0 1234567 12345678 123456789 12345678\0 1234567890abcdefg 1234567890abcdefh 1234567890abcdef"])
    assert WordTable(known, np.arange(5)).find(words).tolist() == [0, 1, -1, -1, 2, 3, -1, 4, -1, -1]


@pytest.mark.parametrize("other", [94, 41])  # the one held out, the other learned from
def test_scores_of_words_of_one_hash(spark, other):
    a, b = thue_morse(10)
    docs = [(i, f"{a} w{i % 3}") for i in range(40)] + [(other, f"{b} {b} w1 {a}")]
    counts = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert rows[i].n_known == sum(counts[w] > 0 for w in tokens(t))
        assert rows[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t)))
    assert (rows[other].n_known == 3) == (other == 94)


def test_every_training_text_is_learned_from_once(spark, monkeypatch):
    from lexisift.llm import gated_lm

    seen = []
    monkeypatch.setattr(gated_lm, "_train_round", lambda texts, *rest: seen.extend(r.doc_id for r in texts.collect()))
    texts = spark.createDataFrame([(i, f"a b{i}") for i in range(200)], "doc_id long, text string")
    gated_lm.fit(texts)
    assert sorted(seen) == list(range(200))


def test_scores_do_not_move_with_partitions(spark, monkeypatch):
    from lexisift.llm import gated_lm

    monkeypatch.setattr(gated_lm, "EACH", 400)  # several copies a round
    rows = [(i, f"w{i % 7} w{i % 5} and so w{i % 3} " * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in score_documents(docs.repartition(n, "doc_id")).collect()} for n in (1, 13))
    assert len(a) == 300 and all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a)


def test_learning_helps_held_out_texts(spark):
    rows = QUERIES["op2_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.96 * sum(r.base_score for r in rows)
