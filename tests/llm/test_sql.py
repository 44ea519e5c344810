"""Queries against their SQL counterparts."""

import pytest

from palimpsest.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got) and got
