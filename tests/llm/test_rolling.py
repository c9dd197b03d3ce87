import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from lexisift.llm import rolling_median
from lexisift.llm.rolling_median import rolling_medians

SPAN = 900_000_000
BEGIN = datetime(2024, 1, 1)
KINDS = "click_id long, ts timestamp_ntz, kind string, value double"


def brute(rows, span=SPAN):
    least = {}
    for click_id, ts, kind, value in rows:
        if ts is None:
            continue
        cents = None
        if value is not None and math.isfinite(value) and abs(100 * value + 0.5) < 2**58:
            cents = math.floor(100 * value + 0.5)
        at = round((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        order = (at, kind is not None, kind or "", cents is not None, cents or 0)
        if click_id not in least or order < least[click_id][0]:
            least[click_id] = (order, at, kind, cents)
    out = []
    for click_id, (_, at, kind, cents) in least.items():
        w = sorted(c for _, a, k, c in least.values() if k == kind and at - span < a <= at and c is not None)
        n = len(w)
        if not n:
            out.append((click_id, kind, 0, None, None, None))
            continue
        median2 = w[(n - 1) // 2] + w[n // 2]
        d = sorted(abs(2 * c - median2) for c in w)
        mad4 = d[(n - 1) // 2] + d[n // 2]
        out.append((click_id, kind, n, median2, mad4, None if cents is None else 2 * abs(2 * cents - median2) > 2 * mad4))
    return sorted(out, key=repr)


def found(spark, rows, **given):
    frame = spark.createDataFrame(rows, KINDS)
    got = rolling_medians(frame, **given).collect()
    return sorted(((r["id"], r["series"], r["n"], r["median2"], r["mad4"], r["far"]) for r in got), key=repr)


def drawn(n, seed, minutes):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = BEGIN + timedelta(microseconds=draw.choice([0, 17, 15 * 60 * 10**6, draw.randrange(minutes * 60 * 10**6)]))
        value = draw.choice([None, 0.0, 1.5, -2.25, draw.uniform(-50, 500), draw.lognormvariate(3, 2)])
        rows.append((i, at, draw.choice(["a", "b", None, ""]), value))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_brute_force(spark, seed):
    rows = drawn(900, seed, 600)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("dense", [1, 4, 20, 150])
def test_dense_slots_are_cut_into_short_chunks_and_shares(spark, dense):
    """A slot of many events, half of them at one time, beside slots of few."""
    rows = drawn(400, 5, 400)
    draw = random.Random(9)
    for i in range(300):
        rows.append((1000 + i, BEGIN + timedelta(minutes=50, microseconds=draw.choice([0, draw.randrange(20 * 60 * 10**6)])), "a", draw.choice([None, draw.uniform(0, 9)])))
    assert found(spark, rows, dense=dense) == brute(rows)


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_cuts_come_by_broadcast_or_shuffle(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rolling_median, "BROADCAST", broadcast)
    rows = drawn(200, 1, 40)
    assert found(spark, rows, dense=8) == brute(rows)


def test_tasks_take_rows_in_parts(spark, monkeypatch):
    chunk = np.repeat(np.arange(40), 25)
    draw = np.random.default_rng(3)
    at = np.concatenate([np.sort(draw.integers(0, 50, 25)) for _ in range(40)])
    cents, weight, asked = draw.integers(-30, 30, 1000), draw.integers(0, 3, 1000), draw.random(1000) < 0.8
    got = rolling_median.windows(chunk, at, cents, weight, asked, 10)
    for lanes, nodes in ((1, 1 << 24), (7, 1 << 24), (1000, 600)):
        monkeypatch.setattr(rolling_median, "LANES", lanes)
        monkeypatch.setattr(rolling_median, "NODES", nodes)
        assert all((a == b).all() for a, b in zip(got, rolling_median.windows(chunk, at, cents, weight, asked, 10), strict=True))
    for i, (n, m, d) in zip(np.nonzero(asked)[0], zip(*got, strict=True), strict=True):
        inside = (chunk == chunk[i]) & (at > at[i] - 10) & (at <= at[i])
        w = np.sort(np.repeat(cents[inside], weight[inside]))
        assert n == len(w)
        if n:
            assert m == w[(n - 1) // 2] + w[n // 2]
            e = np.sort(abs(2 * w - m))
            assert d == e[(n - 1) // 2] + e[n // 2]


def test_odd_rows(spark):
    t = BEGIN
    rows = [
        (1, t, "a", 1.0), (1, t, "a", 1.0), (1, None, "a", 2.0), (2, t, "a", float("nan")), (3, t, "a", float("inf")), (4, t, "a", 1e300),
        (5, t + timedelta(minutes=15), "a", 3.0), (6, t + timedelta(minutes=15, microseconds=-1), "a", 5.0), (None, t, None, 1.0), (None, t, None, 1.0),
        (7, datetime(1969, 12, 31, 23, 59, 59, 999999), "a", -0.005), (8, None, None, None), (9, t, "", None), (10, t, "a", -1e15),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, dense=1) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    frame = spark.createDataFrame([], KINDS)
    assert rolling_medians(frame).count() == 0
    clash = spark.createDataFrame([(1, BEGIN, "a", 1.0, 5, "x", True)], KINDS + ", at int, series string, asked boolean")
    assert [tuple(r) for r in rolling_medians(clash).collect()] == [(1, "a", 1704067200000000, 100, 1, 200, 0, False)]


def test_times_stand_as_they_are_in_any_zone(spark):
    """The hour that a change of clocks leaves out is an hour like others."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [(i, datetime(2024, 3, 10, 1, 50) + timedelta(minutes=7 * i), "a", float(i)) for i in range(12)]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
