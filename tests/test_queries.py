"""Every query against its SQL, rows and values."""

from collections import Counter

import duckdb
import pytest

from lexisift import command_queries, report_queries  # noqa: F401
from lexisift.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations vendors".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
    assert sorted(got.columns) == names
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=str)
    assert len(rows) == len(want) and rows == want


def test_logs_with_a_mark_keep_their_first_entry(spark, tmp_path):
    # of each log a request that failed, first of all; every other log is UTF-16
    rows = [(500 * k + i, 3, "view") for k in range(8) for i in (0, 1)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["log_files"](spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(duck.sql(ORACLES["log_files"]).fetchall())
    assert sum("GET /api/" in r[3] for r in got) == 8
