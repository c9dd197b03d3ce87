import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

from lexisift.llm import quality_knn, quality_rules as qr
from lexisift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = ["", None, " ", "\n\n", "a", "a b c a b c", "x\ny\nx\n \n", "w " * 200, "THE!! END!! é", "a\x1cb c\x85d"]


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in earlier
            earlier.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_statistics_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in qr.judge_quality(frame, labels).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
            assert r.kept == (not r.base_failed)


def test_rules_by_hand():
    draw = np.random.default_rng(0)
    table = {"symbols_per_word": draw.random(600), "upper_letters": draw.random(600)}
    bad = (table["symbols_per_word"] > 0.7) & (table["upper_letters"] > 0.5)
    rules = qr.learn_rules(table, bad)
    caught = np.logical_or.reduce([r.holds(table) for r in rules])
    assert (caught == bad).mean() > 0.97 and all(r.precision >= 0.9 for r in rules)
    assert qr.learn_rules(table, np.zeros(600, bool)) == [] == qr.learn_rules(table, np.ones(600, bool))


def test_rules_on_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op6_quality_rules"](spark, SF).join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) / len(bad) > 0.95 and sum(r.kept for r in good) / len(good) > 0.98
    assert all(not r.kept for r in rows if r.base_failed)


def test_votes_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op7_quality_classifier"](spark, SF).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97


def test_votes_equal_brute_force():
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(40, 5))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality_knn.Neighbours(np.zeros((4, 5)), vectors, draw.integers(0, 2, 40).astype(float), 0.3, 7)
    placed = draw.normal(size=(30, 5))
    placed /= np.linalg.norm(placed, axis=1, keepdims=True)
    got = model.score(placed, block=4)
    for p, g in zip(placed, got, strict=True):
        cosine = vectors @ p
        top = np.argsort(-cosine)[:7]
        w = np.maximum(cosine[top], 0) ** 2
        assert abs(g - (w * model.labels[top]).sum() / w.sum()) < 1e-12


def test_votes_on_odd_rows(spark):
    docs = spark.createDataFrame([(i if i else None, t, 0.1) for i, t in enumerate(ODD)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 1, 0), (4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality_knn.classify_quality(docs, labels).collect()
    assert len(rows) == len(ODD) and all(r.held_out is not None and 0 <= r.score <= 1 for r in rows)
    none = quality_knn.classify_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_knn.classify_quality(docs.limit(0), labels).collect() == []


def test_long_words_are_read_whole():
    from lexisift.llm.quality_knn import Terms

    marked = lambda text: set(Terms().of(text)[0].tolist())
    shape = Terms._hash("s!0")
    assert shape not in marked("a" * 128) and shape in marked("a" * 128 + "!!12")


def test_verdicts_of_learned_rules_by_hand(spark):
    """The first rule that holds on ratios of counts taken by hand, on all documents."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = qr.fit_rules(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op6_quality_rules"](spark, SF).collect()}
    assert rules and set(got) == {r.doc_id for r in docs.collect()}

    def ratios(text):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        n, chars, symbols, dup, repeat, _ = brute(text)
        share = lambda a, b: a / b if b else 0.0
        return {
            "symbols_per_word": share(symbols, n), "repeated_words": share(repeat, n), "repeated_lines": share(dup, len(lines)), "upper_letters": share(len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))),
            "exclaims_per_word": share(text.count("!"), n), "echoes_per_word": share(sum(a == b for a, b in zip(words, words[1:])), n), "chars_per_word": share(chars, n), "words_per_line": share(n, len(lines)),
        }

    for r in docs.collect():
        own = ratios(r.text or "")
        first = next((i for i, rule in enumerate(rules) if all((own[t.name] >= t.value) == t.above for t in rule.tests)), None)
        assert got[r.doc_id].rule == first and got[r.doc_id].kept == (first is None and not brute(r.text)[5])


def test_scores_equal_those_of_the_whole_matrix(spark):
    """Terms by hand, a dense matrix, its singular vectors, and a vote over all cosines."""
    few = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{few}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{few}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs}
    code = lambda term: zlib.crc32(term.encode()) % quality_knn.COLUMNS

    def weights(text):
        words, out = text.split(), np.zeros(quality_knn.COLUMNS)
        shapes = Counter()
        for i, w in enumerate(words):
            for k in range(0, len(w), 64):
                kinds = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "l" if c.isalpha() else c for c in w[k : k + 64])
                shapes[code("s" + re.sub(r"(?s)(.)\1+", r"\1", kinds))] += 1
        pieces = sum(shapes.values())
        alike = lambda a, b: (code("w" + a.lower()), quality_knn._shape(a[:64])) == (code("w" + b.lower()), quality_knn._shape(b[:64]))
        shapes[code("again")] += sum(alike(a, b) for a, b in zip(words, words[1:])) + sum(alike(a, b) for a, b in zip(words, words[2:]))
        for c, n in Counter(code("w" + w.lower()) for w in words).items():
            out[c] += 1 + np.log(n)
        for c, n in shapes.items():
            out[c] += 40 * np.sqrt(n / pieces) if n else 0
        return out

    every = {i: weights(t) for i, t in docs.items()}
    ids = sorted(labels)
    matrix = np.stack([every[i] for i in ids]).astype(np.float32).astype(np.float64)
    n, df = len(ids), (matrix > 0).sum(axis=0)
    idf = np.where((df >= 3) & (df < n), np.log((1 + n) / (1 + df)) + 0.1, 0.0)
    rows = matrix * idf / np.linalg.norm(matrix * idf, axis=1, keepdims=True)
    _, values, right = np.linalg.svd(rows, full_matrices=False)
    axes = right[: min(48, int((values > 1e-5).sum()))].T
    place = lambda w: (w * idf) @ axes / (np.linalg.norm((w * idf) @ axes) or 1.0)
    known, quality = np.stack([place(w) for w in matrix]), np.array([labels[i] for i in ids], dtype=float)
    for r in QUERIES["op7_quality_classifier"](spark, few).collect():
        cosine = known @ place(every[r.doc_id])
        top = np.argsort(-cosine)[:25]
        vote = np.maximum(cosine[top], 0) ** 2
        want = (vote * quality[top]).sum() / vote.sum() if vote.sum() > 1e-9 else quality.mean()
        assert abs(r.score - want) < 1e-6, r.doc_id


def test_leading_vectors_are_those_of_the_whole_matrix(monkeypatch):
    draw = np.random.default_rng(3)
    for rows in (draw.normal(size=(900, 1200)) * np.linspace(1, 0.05, 1200), np.repeat(draw.random((300, 500)), 3, axis=0), draw.normal(size=(900, 20)) @ draw.normal(size=(20, 60)), draw.normal(size=(30, 40))):
        matrix = rows @ rows.T
        k = min(48, len(matrix))
        want, vectors = np.linalg.eigh(matrix)
        want, vectors = want[: -k - 1 : -1], vectors[:, : -k - 1 : -1]
        for rounds in (60, 0):  # by steps, and whole
            got, own = quality_knn.leading(matrix, k, rounds=rounds)
            assert np.abs(got - want).max() < 1e-9 * want[0] and np.abs(own.T @ own - np.eye(k)).max() < 1e-9
            real = want > 1e-9 * want[0]
            assert np.abs(own[:, real] @ own[:, real].T - vectors[:, real] @ vectors[:, real].T).max() < 1e-7


def test_the_driver_holds_one_matrix_while_it_fits(spark):
    """Of 2,000 labelled documents: their matrix of 32 MB and no four more beside it."""
    words = [f"w{i}" for i in range(4000)]
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(words[j] for j in np.minimum(draw.zipf(1.3, 120), 4000) - 1)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    mb = lambda what: int(re.search(rf"{what}:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    docs.count()
    before = mb("VmRSS")
    Path("/proc/self/clear_refs").write_text("5")
    model = quality_knn.fit_neighbours(docs, labels)
    assert model.vectors.shape == (2000, 48) and mb("VmHWM") - before < 130
