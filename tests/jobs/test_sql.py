"""The registered job queries against their SQL counterparts."""

import os

import duckdb
import pytest

from jobs import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    got = queries.QUERIES[name](spark, sf)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(str, map(tuple, got.select(*want.columns).collect())))
    assert rows == sorted(map(str, want.fetchall())) and rows
