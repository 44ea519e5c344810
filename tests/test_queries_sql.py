"""Every registered query against its SQL counterpart on the same tables."""

import os

import duckdb
import pytest

from palimpsest import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def cells(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == cols
    assert cells(df.select(*cols).collect()) == cells(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_without_sql_there_are_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
