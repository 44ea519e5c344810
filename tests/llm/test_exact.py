import hashlib
import re

from palimpsest.llm import exact, queries


def brute(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "") for r in rows]
    groups = {}
    for r, t in zip(rows, texts):
        groups.setdefault(t, []).append(r)
    out = []
    for r, t in zip(rows, texts):
        best = min(groups[t], key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        out.append((r[0], best[0], len(groups[t]), best[0] == r[0], hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = exact.exact_groups(odd).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_same_length_and_prefix(make):
    rows = [(i, "p" * 70 + chr(97 + i % 3)) for i in range(9)] + [(20, "q"), (21, "r")]
    got = exact.exact_groups(make(rows), prefix=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_settled_rows_have_no_full_hash(make):
    got = {r.doc_id: r.text_sha256 for r in exact.exact_duplicates(make([(1, "abc"), (2, "abcd"), (3, "ab cd")])).collect()}
    assert got[1] is None and got[2] == got[3] is not None


def test_plain_join_path(odd, monkeypatch):
    monkeypatch.setattr(exact, "small_or_plain", lambda df: df)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in exact.exact_groups(odd).collect()), key=str) == brute(rows)


def test_drop_keeps_columns_and_clean_rows(odd):
    left = exact.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["10", "11", "5", "6", "7", "9"]


def test_empty_table(make):
    assert exact.exact_groups(make([])).count() == 0 and exact.drop_exact_duplicates(make([])).count() == 0


def test_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLES["op4_exact_dedup"]).fetchall()
    got = queries.op4_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(want) == sorted(map(tuple, got))
