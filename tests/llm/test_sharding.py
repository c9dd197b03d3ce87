import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexisift.llm import sharding
from lexisift.llm.queries import QUERIES
from lexisift.llm.sharding import places, quantile_bounds, shard_documents, write_shards

SF = "/root/testdata/sf0.01"


def check(rows, given, shards=8, within=0.003):
    """Every row once, sizes and checksums right, slots gapless, bytes near equal. Returns the bytes of shards."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    held = np.zeros(shards, dtype=np.int64)
    slots: dict[int, list] = {}
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        held[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max((r["size"] for r in rows), default=0)
    assert not rows or held.max() - held.min() <= max(within * held.sum() / shards, 2 * largest)
    return held


def test_query(spark):
    rows = QUERIES["op13_sharding"](spark, SF).collect()
    check(rows, duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize(("n", "seed"), [(6000, 0), (20_000, 1)])
def test_bytes_are_near_equal_and_equal_texts_stay_together(spark, n, seed):
    draw = random.Random(seed)
    given = [(i, draw.choice([None, "", "x" * draw.randrange(60), f"{i % 977} " * draw.randrange(1, 9)])) for i in range(n)]
    rows = shard_documents(spark.createDataFrame(given, "doc_id long, text string")).collect()
    held = check(rows, given)
    of: dict[int, set] = {}
    many = Counter()
    for r in rows:
        of.setdefault(r["text_crc32"], set()).add(r["shard"])
        many[r["text_crc32"]] += r["size"]
    assert all(len(of[c]) == 1 for c in of if many[c] <= held.sum() / 8 * sharding.WHOLE)


def test_a_group_of_a_third_of_all_rows_is_divided(spark):
    given = [(i, "the same text" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(9000)]
    check(shard_documents(spark.createDataFrame(given, "doc_id long, text string")).collect(), given)
    same = [(7, "one text")] * 4000  # repeated rows, of one id too
    held = check(shard_documents(spark.createDataFrame(same, "doc_id long, text string")).collect(), same)
    assert held.min() > 0


def test_samples_need_not_hold_all_keys(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLED", 200)
    draw = random.Random(4)
    given = [(i, "y" * int(draw.paretovariate(1.1))) for i in range(8000)]
    check(shard_documents(spark.createDataFrame(given, "doc_id long, text string")).collect(), given)


@pytest.mark.parametrize("given", [[], [(None, None)], [(1, "a"), (1, "a"), (None, "b")], [(i, None) for i in range(20)], [(1, "z" * 3_000_000), *((i, "z") for i in range(50))]])
def test_odd_rows(spark, given):
    check(shard_documents(spark.createDataFrame(given, "doc_id long, text string")).collect(), given)


def test_clashing_names_and_written_shards(spark, tmp_path):
    given = [(i, f"t{i % 50} " * (i % 11), i, "q") for i in range(3000)]
    frame = spark.createDataFrame(given, "doc_id long, text string, high int, size string")
    rows = shard_documents(frame).collect()
    check(rows, [x[:2] for x in given])
    cuts = write_shards(frame, str(tmp_path / "out"), tasks=2)
    assert len(cuts) == 7 and cuts == sorted(cuts)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r)[:4] for r in got.select("doc_id", "text", "high", "size").collect()) == sorted(given)
    held = {r["shard"]: r["n"] for r in got.selectExpr("shard", "octet_length(text) + 1 as n").groupBy("shard").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert max(held.values()) - min(held.values()) < 0.02 * sum(held.values()) / 8


def test_places_and_bounds():
    draw = np.random.default_rng(2)
    high, low = draw.integers(-4, 4, 500), draw.integers(-9, 9, 500)
    bounds = sorted({(int(a), int(b)) for a, b in zip(draw.integers(-4, 4, 20), draw.integers(-9, 9, 20), strict=True)})
    assert places(high, low, bounds).tolist() == [sum(b < (h, k) for b in bounds) for h, k in zip(high, low, strict=True)]
    assert quantile_bounds([], 4) == [] and quantile_bounds([(5, 1, 2.0)], 4) == [(5, 1)]
    assert quantile_bounds([(i, 0, 1.0) for i in range(100)], 4) == [(24, 0), (49, 0), (74, 0)]
