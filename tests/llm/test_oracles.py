"""Queries that SQL can express, against it."""

import duckdb
import pytest

from lexisift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "clicks"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in QUERIES[name](spark, SF).collect()), key=repr) == want
