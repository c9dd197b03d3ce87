"""Near-duplicate vectors by hashing to cells of the E8 lattice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..shipping import shipped
from .common import components, durable, with_values
from .dart_minhash import mix

#: Rows that are compared with each other at once; a group of more is parted and its parts are compared in pairs.
PART, DENSE_PART = 2048, 512
#: Sign bits of random projections, in words of 64, and by how many deviations more than the mean of them may differ.
SIGN_WORDS, DEVIATIONS = 4, 5.8
#: Pairs that a group of a cell may name for each of its rows; of more, they are told by what they reach.
NAMED = 8


def _even_integers(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(x[odd] - near[odd]).argmax(axis=1)
    near[odd, worst] += np.where(x[odd, worst] >= near[odd, worst], 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of eight: of the even integer points and those half a step off."""
    a, b = _even_integers(x), _even_integers(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(1)
def shortest() -> np.ndarray:
    """The 240 shortest E8 vectors: from a cell to those that touch it."""
    whole = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1.0, -1.0), repeat=2)]
    half = [list(s) for s in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.array(whole + half)


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(points.shape[:-1], salt, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(8):
            out = mix(out + np.rint(2 * points[..., i]).astype(np.int64).view(np.uint64), i)
    return out.view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, width: float, seed: int = 11) -> np.ndarray:
    """Keys of rows of unit vectors: n x tables x (1 + probes), the own cell and the nearest of those around it."""
    draw = np.random.default_rng([seed, unit.shape[1]])
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        x = unit @ draw.normal(size=(unit.shape[1], 8)) / width + draw.random(8)
        own = decode(x)
        nearness = (x - own) @ shortest().T
        around = np.argpartition(-nearness, probes, axis=1)[:, :probes]
        out[:, t, 0] = _key(own, t * 65537 + unit.shape[1])
        out[:, t, 1:] = _key(own[:, None] + shortest()[around], t * 65537 + unit.shape[1])
    return out


def cell_width(n: int) -> float:
    """How wide cells are for ``n`` vectors: a cell's share of all falls with the root of their number."""
    return float(np.clip(2.0 * (max(n, 1) / 50_000) ** (-1 / 16), 0.4, 2.5))


@lru_cache(64)
def tables_for(threshold: float, probes: int, width: float, miss: float = 1e-6, draws: int = 20_000) -> int:
    """How many tables leave a pair at the threshold without a cell in common no more often than ``miss``.

    Projections of two unit vectors depend on their cosine alone, so pairs are drawn for it and decoded.
    """
    draw = np.random.default_rng(13)
    g, offset = draw.normal(size=(2, draws, 8)), draw.random((draws, 8))
    x = np.stack([g[0], threshold * g[0] + np.sqrt(max(0.0, 1 - threshold**2)) * g[1]]) / width + offset
    own = np.stack([decode(x[0]), decode(x[1])])
    away = (own[1] - own[0])[:, None]
    met = (away[:, 0] == 0).all(axis=1)
    for side in (0, 1):
        around = np.argpartition(-((x[side] - own[side]) @ shortest().T), probes, axis=1)[:, :probes]
        met |= (shortest()[around] == (away if side == 0 else -away)).all(axis=2).any(axis=1)
    if not met.any():
        raise ValueError(f"at a cosine of {threshold} and cells of width {width:.3g} none of {draws} drawn pairs meets: no number of tables is known to be enough")
    return int(np.ceil(np.log(miss) / np.log1p(-min(met.mean(), 1 - 1e-9))))


def signs(unit: np.ndarray, seed: int = 12) -> np.ndarray:
    """n x SIGN_WORDS words of sign bits of random projections."""
    draw = np.random.default_rng([seed, unit.shape[1]])
    bits = unit @ draw.normal(size=(unit.shape[1], 64 * SIGN_WORDS)) > 0
    return np.packbits(bits, axis=1).view(np.uint64)


def signs_apart(threshold: float) -> int:
    """How many signs may differ of a pair at the threshold; a pair above it differs in more about once in a hundred million."""
    share, n = np.arccos(np.clip(threshold, -1, 1)) / np.pi, 64 * SIGN_WORDS
    return int(np.ceil(n * share + DEVIATIONS * np.sqrt(n * share * (1 - share))))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the least node that links (a, b) reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _in_parts(rows: DataFrame, key: str, id_col: str, weight: str | None = None, most: int | None = None) -> DataFrame:
    """``rows`` in groups (key, g, h) of two parts of a key's rows at most, ``side`` telling which; alone in a key: left out.

    A key's rows are dealt over parts of about ``most`` (PART without it), in rows or in the sum of ``weight``, by a
    hash of the id, and every two parts, or a part with itself, are a group.
    """
    sizes = durable(rows.groupBy(key).agg(F.count("*").alias("rows"), F.sum(weight or F.lit(1)).alias("size")).where("rows > 1"))
    parts = F.ceil(F.col("size") / F.lit(most or PART)).cast("int")
    dealt = with_values(rows, sizes, key).withColumn("parts", parts).withColumn("q", F.pmod(F.xxhash64(id_col, F.lit(5)), F.col("parts")).cast("int"))
    return _paired(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("size", "parts")


def _paired(dealt: DataFrame) -> DataFrame:
    """Rows of part ``q`` in the group that it makes with part ``other``."""
    both = dealt.withColumn("g", F.least("q", "other")).withColumn("h", F.greatest("q", "other"))
    return both.withColumn("side", F.when(F.col("q") == F.col("g"), 0).otherwise(1)).drop("q", "other")


def _in_parts_of_classes(rows: DataFrame, key: str, id_col: str, most: int | None = None) -> DataFrame:
    """The same of rows with a ``class``, where only rows of two classes need to meet.

    A class with ``most`` rows of a key or more has parts of its own, which make no group with each other; all smaller
    ones of a key share parts. So where one class fills a key its rows are copied once for each part of the others.
    """
    most = most or PART
    counts = durable(rows.groupBy(key, "class").agg(F.count("*").alias("rows")))
    own = F.when(F.col("rows") >= most, F.ceil(F.col("rows") / F.lit(most))).otherwise(0).cast("int")
    large = counts.withColumn("own", own).where("own > 0")
    before = F.sum("own").over(Window.partitionBy(key).orderBy("class").rowsBetween(Window.unboundedPreceding, -1))
    begins = large.select(key, "class", "own", F.coalesce(before, F.lit(0)).cast("int").alias("begin"))
    small = F.ceil(F.sum(F.when(F.col("rows") < most, F.col("rows")).otherwise(0)) / F.lit(most)).cast("int")
    keys = counts.groupBy(key).agg(small.alias("small"), F.sum(own).cast("int").alias("large"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    facts = durable(counts.join(keys, key).join(begins, [key, "class"], "left"))
    drawn = lambda n: F.pmod(F.xxhash64(id_col, F.lit(5)), n).cast("int")
    first = F.col("small") + F.col("begin")
    dealt = with_values(rows, facts, [key, "class"]).withColumn("q", F.when(F.col("own").isNull(), drawn(F.col("small"))).otherwise(first + drawn(F.col("own"))))
    others = F.sequence(F.lit(0), F.col("small") + F.col("large") - 1)
    apart = F.filter(others, lambda k: F.col("own").isNull() | (k < first) | (k >= first + F.col("own")))
    return _paired(dealt.withColumn("other", F.explode(apart))).drop("small", "large", "own", "begin")


def _grouped(rows: DataFrame, key: str, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` once for each group (key, g, h), each held whole: of two parts at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if held and (out := work(pa.Table.from_batches(held))) is not None:
                yield out

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (key, "g", "h")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    if (mark := tuple(marks[i].tolist())) != now:
                        yield from close()
                        held, now = [], mark
                    held.append(batch.slice(i, j - i))
        yield from close()

    return shipped(rows).repartition(key, "g", "h").sortWithinPartitions(key, "g", "h").mapInArrow(run, schema)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of each side, and whether the group is a part with itself."""
    side = group.column("side").to_numpy()
    alone = group.column("g")[0].as_py() == group.column("h")[0].as_py()
    left = np.flatnonzero(side == 0)
    return left, left if alone else np.flatnonzero(side == 1), alone


def _sketch_links(threshold: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Pairs (x, y) of a cell whose signs are alike; where they are many, each row that has one with the least that it reaches."""
    most = signs_apart(threshold)

    def work(group: pa.Table) -> pa.RecordBatch | None:
        ids, home = group.column("id").to_numpy(), group.column("home").to_numpy(zero_copy_only=False)
        s = np.stack([group.column(f"s{k}").to_numpy().view(np.uint64) for k in range(SIGN_WORDS)], axis=1)
        left, right, alone = _sides(group)
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        x, y, reach, pairs = [], [], np.arange(len(ids)), 0
        for i in range(0, len(left), 512):
            own = left[i : i + 512]
            apart = sum(np.bitwise_count(s[own, None, k] ^ s[None, right, k]).astype(np.int16) for k in range(SIGN_WORDS))
            a, b = np.nonzero((apart <= most) & (home[own][:, None] | home[right][None]))
            a, b = place[own[a]], place[right[b]]
            keep = a < b if alone else a != b
            a, b = a[keep], b[keep]
            reach = _least_labels(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, reach]))
            pairs += len(a)
            if pairs <= NAMED * len(ids):
                x.append(a)
                y.append(b)
        if not pairs:
            return None
        named = pairs <= NAMED * len(ids)
        if named:
            a, b = np.concatenate(x), np.concatenate(y)
        else:
            a = np.flatnonzero(reach != np.arange(len(ids)))
            b = reach[a]
        a, b = ids[order][a], ids[order][b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), named))], ["x", "y", "named"])

    return work


def _exact_links(threshold: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    def work(group: pa.Table) -> pa.RecordBatch | None:
        ids, times = group.column("id").to_numpy(), group.column("times").to_numpy()
        unit = _unit(np.stack(_vectors(group.column("v").combine_chunks())))
        left, right, alone = _sides(group)
        n = np.zeros(len(ids), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        label = np.arange(len(ids))
        for i in range(0, len(left), 512):
            own = left[i : i + 512]
            link = unit[own] @ unit[right].T >= threshold
            if alone:
                link[np.arange(len(own)), i + np.arange(len(own))] = False
            n[own] += link @ times[right]
            if not alone:
                n[right] += times[own] @ link
            a, b = np.nonzero(link)
            joined = np.concatenate([place[own[a]], np.arange(len(ids))]), np.concatenate([place[right[b]], label])
            label = _least_labels(len(ids), *joined)
        linked = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(n[linked]), pa.array(ids[order][label[place[linked]]])], ["id", "n", "least"])

    return work


def _verified(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (x, y, x_times, y_times, x_v, y_v) those whose vectors link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["x", "y", "x_times", "y_times"]
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                xs, ys = _vectors(part.column("x_v")), _vectors(part.column("y_v"))
                link = np.zeros(part.num_rows, dtype=bool)
                lengths = np.array([len(x) for x in xs])
                for n in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == n)
                    a, b = (_unit(np.stack([v[k] for k in at])) for v in (xs, ys))
                    link[at] = (a * b).sum(axis=1) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(link)) for c in kept], kept)

    return run


def similar_vectors(vectors: DataFrame, threshold: float = 0.95, probes: int = 4, miss: float = 1e-6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``; labels and other columns are ignored.

    Vectors link at a cosine of ``threshold`` or more, in double precision. Equal vectors are one with a count.
    Each of the rest is put in its cell of the lattice, and in those around it that are nearest, once for each
    table of random projections. Those that meet in a cell, at least one of them at home there, and whose signs
    of more random projections mostly agree, are candidates, whose cosine is taken exactly. A cell with few names
    its pairs, at most NAMED for each of its rows. One with more tells which rows they connect; in the classes
    that these make all cosines are taken in blocks and counted, and no pair is a row. Each link counts once: a
    pair that is named counts only if it is not of one such class. The width of cells follows from how many vectors
    there are, and the number of tables from width and threshold, so that at every size a pair at the threshold is
    missed no more often than ``miss``.

    Null and zero vectors and those with null or non-finite components link with nothing, and so do rows with
    a null id, whose component is null and which stay. Rows that share an id count as vectors each. Vectors of
    different lengths never link. An empty table gives an empty one.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    distinct = durable(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")))
    if not distinct.groupBy("id").count().where("count > 1").isEmpty():
        return _with_shared_ids(rows, distinct, threshold, probes, miss)
    counted, member = _links(distinct, threshold, probes, miss)
    found = distinct.join(counted, "id", "left").join(member, distinct["id"] == member["node"], "left")
    each = found.select("v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return _told(rows, each)


def _told(rows: DataFrame, each: DataFrame) -> DataFrame:
    told = rows.where("v is not null").join(each, "v").select("vec_id", "n_links", "component_id").union(rows.where("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return told.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))


def _with_shared_ids(rows: DataFrame, distinct: DataFrame, threshold: float, probes: int, miss: float) -> DataFrame:
    """The same where a vector's least id is another's too: nodes get numbers, then components get least ids."""
    numbered = durable(distinct.withColumn("own", F.col("id")).withColumn("id", F.monotonically_increasing_id()))
    counted, member = _links(numbered, threshold, probes, miss)
    found = durable(numbered.join(counted, "id", "left").join(member, numbered["id"] == member["node"], "left").select("v", "own", "id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("class")))
    least = found.groupBy("class").agg(F.min("own").alias("component_id"))
    return _told(rows, found.join(least, "class").select("v", "n_links", "component_id"))


def _links(distinct: DataFrame, threshold: float, probes: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """(id, n) and (node, component) of vectors that link, from (id, v, times)."""
    width = cell_width(distinct.count())
    tables = tables_for(threshold, probes, width, miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids, lists = part.column("id").to_numpy(), _vectors(part.column("v"))
                lengths = np.array([len(x) for x in lists])
                for n in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == n)
                    unit = _unit(np.stack([lists[k] for k in at]))
                    flat = cells(unit, tables, probes, width).reshape(len(at), -1)
                    home = np.zeros(flat.shape, dtype=bool)
                    home[:, :: 1 + probes] = True
                    yield pa.RecordBatch.from_arrays([pa.array(flat.reshape(-1)), pa.array(np.repeat(ids[at], flat.shape[1])), pa.array(home.reshape(-1))], ["key", "id", "home"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids, lists = part.column("id").to_numpy(), _vectors(part.column("v"))
                lengths = np.array([len(x) for x in lists])
                for n in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == n)
                    s = signs(_unit(np.stack([lists[k] for k in at]))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), *(pa.array(s[:, k]) for k in range(SIGN_WORDS))], ["id", *sign_columns])

    # signs are written once a vector and come to the rows of cells that have several
    sign_columns = [f"s{k}" for k in range(SIGN_WORDS)]
    rows = durable(shipped(distinct).select("id", "v").mapInArrow(hashed, "key long, id long, home boolean"))
    marks = durable(shipped(distinct).select("id", "v").mapInArrow(signed, "id long, " + ", ".join(f"{c} long" for c in sign_columns)))
    like = durable(_grouped(_in_parts(rows, "key", "id").join(marks, "id"), "key", _sketch_links(threshold), "x long, y long, named boolean").distinct())
    classes = durable(components(like.where("not named"), "x", "y"))
    near = distinct.join(classes, distinct["id"] == classes["node"]).select(F.col("component").alias("class"), "id", "times", "v")
    dense = durable(_grouped(_in_parts(near, "class", "id", most=DENSE_PART), "class", _exact_links(threshold), "id long, n long, least long"))
    of = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    apart = F.col("x_class").isNull() | F.col("y_class").isNull() | (F.col("x_class") != F.col("y_class"))
    named = like.where("named").select("x", "y").join(of("x"), "x", "left").join(of("y"), "y", "left").where(apart).select("x", "y")
    side = lambda c: distinct.select(F.col("id").alias(c), F.col("times").alias(f"{c}_times"), F.col("v").alias(f"{c}_v"))
    pairs = named.join(side("x"), "x").join(side("y"), "y").where(F.size("x_v") == F.size("y_v"))
    linked = durable(shipped(pairs).mapInArrow(_verified(threshold), "x long, y long, x_times long, y_times long"))
    ends = F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("y_times").alias("n"), F.col("x").alias("least")), F.struct(F.col("y").alias("id"), F.col("x_times").alias("n"), F.col("x").alias("least"))))
    exact = durable(dense.unionByName(linked.select(ends.alias("e")).select("e.*")))
    counted = exact.groupBy("id").agg(F.sum("n").alias("n"))
    return counted, durable(components(exact, "id", "least"))
