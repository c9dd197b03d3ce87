import duckdb
import numpy as np
import pytest

from lexisift.llm import lattice
from lexisift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def brute(vectors, threshold=0.95):
    u = np.array(vectors, dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(u))
    for _ in range(len(u)):
        new = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(u))])
        if (new == label).all():
            break
        label = new
    return link.sum(axis=1), label


def test_nearest_points():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 8)) * 2
    own = lattice.decode(x)
    doubled = np.rint(2 * own).astype(int)
    assert (2 * own == doubled).all() and (((doubled & 1).sum(axis=1) % 8) == 0).all() and (own.sum(axis=1) % 2 == 0).all()
    assert lattice.shortest().shape == (240, 8) and np.allclose((lattice.shortest() ** 2).sum(axis=1), 2)
    around = own[:, None] + lattice.shortest()
    assert (((x - own) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - around) ** 2).sum(axis=2) + 1e-9).all()


@pytest.mark.parametrize(("threshold", "n"), [(0.95, 100), (0.95, 50_000), (0.95, 10**9), (0.8, 10**6)])
def test_tables_are_enough(threshold, n):
    """Pairs at the threshold meet in one table as often as the number of tables takes for granted."""
    width = lattice.cell_width(n)
    tables = lattice.tables_for(threshold, 4, width)
    draw = np.random.default_rng(5)
    a, o = draw.normal(size=(2, 3000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    x, y = (lattice.cells(v, 3, 4, width) for v in (a, b))
    met = ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).mean()
    assert (1 - met) ** tables < 1e-5 and 1 <= tables <= 200


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = c.execute(ORACLES["op10_lattice_duplicates"]).fetchall()
    names = [d[0] for d in c.description]
    got = [tuple(r[n] for n in names) for r in QUERIES["op10_lattice_duplicates"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("named", [0, 3, 1 << 30])
def test_pairs_at_the_threshold_and_groups_in_parts(spark, monkeypatch, named):
    """Whether cells name all their pairs, none, or some do."""
    for name, value in (("PART", 40), ("DENSE_PART", 30), ("NAMED", named)):
        monkeypatch.setattr(lattice, name, value)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(300, 24))
    off = draw.normal(size=(300, 24))
    off -= (off * base).sum(axis=1, keepdims=True) / (base**2).sum(axis=1, keepdims=True) * base
    scale = np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(off, axis=1, keepdims=True)
    cosine = draw.uniform(0.94, 0.97, (300, 1))
    near = base + off * scale * np.sqrt(1 / cosine**2 - 1)
    group = base[:1] + draw.normal(size=(150, 24)) * 0.06
    vectors = np.concatenate([base, near, group, base[:50], base[:20] * 3]).tolist()
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, id string")
    rows = sorted(lattice.similar_vectors(frame).collect())
    n, label = brute(vectors)
    assert [r.n_links for r in rows] == n.tolist() and [r.component_id for r in rows] == label.tolist()


def test_recall_of_many_vectors(spark):
    """12,000 vectors, of which 4,000 lie near others, some just at the threshold, and one dense group is 1,500."""
    draw = np.random.default_rng(9)
    base = draw.normal(size=(6_500, 32))
    near = base[:4_000] + draw.normal(size=(4_000, 32)) * draw.uniform(0.2, 0.4, (4_000, 1))
    group = base[:1] + draw.normal(size=(1_500, 32)) * 0.2
    vectors = np.concatenate([base, near, group])
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.array([int((u @ v >= 0.95).sum()) - 1 for v in u])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in sorted(lattice.similar_vectors(frame).collect())])
    assert (got <= want).all() and got.sum() >= 0.9999 * want.sum() and (want > 0).sum() > 3_000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-200, 0.0]), (11, [1e300, 1e299])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.similar_vectors(frame).collect()}
    want = {i: (0, i, True) for i in (2, 3, 4, 5, 6, 7, 9)} | {1: (3, 1, True), 8: (3, 1, False), 10: (3, 1, False), 11: (3, 1, False), None: (0, None, True)}
    assert got == want
    assert lattice.similar_vectors(frame.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.similar_vectors(twice).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
