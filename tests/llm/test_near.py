from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.llm.common import components
from lexisift.llm.dart_minhash import near_duplicates, sketch


def brute(texts, threshold=0.8, weighted=True):
    """The least id of each class, by all pairs that share a shingle."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items()}
    if not weighted:
        sets = {i: dict.fromkeys(s, 1) for i, s in sets.items()}
    sizes = {i: sum(s.values()) for i, s in sets.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for x, own in where.items():
        for a in range(len(own)):
            for b in range(a):
                common[own[b], own[a]] += min(sets[own[b]][x], sets[own[a]][x])
    for (a, b), n in common.items():
        if n >= threshold * (sizes[a] + sizes[b] - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("weighted", [False, True])
def test_classes_equal_brute_force(spark, weighted):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 700")
    want = brute({r.doc_id: r.text for r in docs.collect()}, weighted=weighted)
    rows = near_duplicates(docs, weighted=weighted).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, long), (7, long + " end"), (7, long + " end"), (8, "x y z"), (None, long), (None, None), (9, "b a")]
    docs = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, n int, component_id string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(0, None, True)] * 2 + [(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (7, 6, False), (8, 8, True), (9, 9, True)], key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, "d e f"), (3, "a b c"), (4, "q"), (4, "q")], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert sorted(r.doc_id for r in rows if r.kept) == [1, 4]


def test_weights_tell_how_often_a_shingle_stands_in_a_text(spark):
    """One text says the same eight times over: the sets of the two are alike, the multisets are not."""
    once = " ".join(f"w{i}" for i in range(60))
    rows = [(1, once), (2, f"{once} {once} {once} {once}"), (3, f"{once} {once} {once} {once} {once[:-4]}"), (4, " ".join(["z"] * 50_000)), (5, " ".join(["z"] * 45_000)), (6, " ".join(["z"] * 30_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == brute(dict(rows)) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}
    sets = {r.doc_id: r.component_id for r in near_duplicates(docs, weighted=False).collect()}
    assert sets == brute(dict(rows), weighted=False) and sets[6] == 4


def words(name, n):
    return [f"{name}_{i}" for i in range(n)]


@pytest.mark.parametrize("weighted", [False, True])
def test_pairs_within_a_large_group_just_below_the_threshold(spark, weighted):
    """All share a template and are 0.785 alike, but each two that share a passage 0.818: like each other, like no head."""
    rows = [(i, " ".join(words("t", 880) + words(f"p{i // 2}", 20) + words(f"o{i}", 100))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, weighted=weighted).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_single_documents_like_members_of_a_large_class_but_not_like_its_heads(spark):
    """Leaves are 0.85 like each other; each single document is 0.81 like one leaf and 0.69 like all others."""
    leaf = lambda i: words("t", 920) + words(f"l{i}", 80)
    rows = [(i, " ".join(leaf(i))) for i in range(150)] + [(1000 + i, " ".join(words(f"s{i}", 98) + leaf(i)[98:])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize("weighted", [False, True])
def test_places_agree_as_often_as_sets_are_alike(weighted):
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[250:]
    wa, wb = draw.integers(1, 5, 1500).astype(float), None
    wb = wa * 0.75
    owner = np.repeat([0, 1], [1000, 1250])
    elements = np.concatenate([a, b])
    weights = np.concatenate([wa[:1000], wb[250:]]) if weighted else None
    s = sketch(owner, elements, weights, 2, 4000)
    full_a, full_b = np.r_[wa[:1000], np.zeros(500)], np.r_[np.zeros(250), wb[250:]]
    want = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum() if weighted else 750 / 1500
    assert (s > 0).all() and abs((s[0] == s[1]).mean() - want) < 0.035
    tiny = sketch(np.array([0, 2]), np.array([5, 5], dtype=np.uint64), None, 3, 150)
    assert (tiny[0] == tiny[2]).all() and (tiny[1] == 0).all()


def test_components(spark):
    draw = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_rows_of_two_classes_meet_once_and_large_classes_make_few_copies(spark):
    from lexisift.llm.lattice import _in_parts_of_classes

    draw = np.random.default_rng(6)
    rows = [(k, 1000 * k + i, int(c)) for k in range(4) for i, c in enumerate(draw.choice([0, 1, 2, 3, 40, 41, 42], 200, p=[0.5, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05]))]
    rows += [(9, 9000 + i, 5) for i in range(50)]  # of one class alone
    dealt = _in_parts_of_classes(spark.createDataFrame(rows, "key long, doc long, class long"), "key", "doc", 30).collect()
    groups: dict[tuple, list] = {}
    for r in dealt:
        groups.setdefault((r["key"], r["g"], r["h"]), []).append(r)
    met = Counter()
    for (_, g, h), members in groups.items():
        left, right = [m for m in members if m["side"] == 0], [m for m in members if m["side"] == 1] or [m for m in members if m["side"] == 0]
        assert (g == h) == all(m["side"] == 0 for m in members) or g != h
        pairs = {(min(a["doc"], b["doc"]), max(a["doc"], b["doc"])) for a in left for b in right if a["class"] != b["class"]}
        met.update(pairs)
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}
    assert met == Counter(want)


def test_a_bucket_of_one_class_with_one_outsider_stays_linear(spark):
    from lexisift.llm.lattice import _in_parts_of_classes

    rows = spark.range(100_001).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("doc"), F.when(F.col("id") == 3, 3).otherwise(0).cast("long").alias("class"))
    assert _in_parts_of_classes(rows, "key", "doc").count() == 100_000 + 50  # the outsider beside each part of the others, and alone


def test_large_classes_that_share_a_bucket(spark, monkeypatch):
    """Two templates a little under the threshold alike, with copies of each between them; parts of few rows."""
    monkeypatch.setattr("lexisift.llm.lattice.PART", 16)
    base = words("t", 300)
    page = lambda kind, i: base[: 300 - kind] + words(f"k{kind}", kind) + words(f"o{kind}_{i}", 12)
    rows = [(i, " ".join(page(20, i))) for i in range(60)] + [(100 + i, " ".join(page(34, i))) for i in range(40)] + [(300, " ".join(page(27, 0)))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(dict(rows))


def test_stars_are_told_without_a_round_and_few_links_take_few_tasks(spark, monkeypatch):
    from lexisift.llm import common

    rounds, durable = [], common.durable
    monkeypatch.setattr(common, "durable", lambda frame: (rounds.append(frame), durable(frame))[1])
    stars = spark.createDataFrame([(5000, i) for i in range(5001, 5040)] + [(1, 2), (3, 1)], "x long, y long").repartition(40)
    assert {r.node: r.component for r in components(stars, "x", "y").collect()} == {i: 5000 for i in range(5000, 5040)} | {1: 1, 2: 1, 3: 1}
    assert len(rounds) == 1
    chain = spark.createDataFrame([(1, 2), (2, 3), (9, 9)], "x long, y long")
    assert {r.node: r.component for r in components(chain, "x", "y").collect()} == {1: 1, 2: 1, 3: 1}
    assert components(chain.where("x > 9"), "x", "y").count() == 0
