"""Runs over a document table that grows, changes and shrinks, held against an index made anew."""

import shutil

from jobs import index_documents as J
from palimpsest.operators import index

DOCS = "doc_id long, text string, source string"
CONFIG = J.read_config() | {"index": {"keywords": 8, "parts": 5}}


def entries(spark, at):
    cols = ["key", "indexed", "own", "block_id", "block_seq", "size"]
    rows = list(map(tuple, index.live(spark, at, "postings").select(*cols).collect()))
    assert len(rows) == len(set(rows))
    return set(rows)


def rebuilt(spark, docs, at):
    docs.write.mode("overwrite").parquet(f"{at}-docs")
    J.run(spark, f"{at}-docs", at, CONFIG)
    return entries(spark, at)


def test_growing_changing_and_shrinking(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, "no id", "s"), (90_001, None, "s"), (90_002, "", "s"), (90_003, "same words same", "s"), (90_003, "other words", "s"), (90_004, "long " * 100_000, "s")], DOCS)
    path, at = f"{tmp_path}/documents.parquet", f"{tmp_path}/index"
    versions = [
        docs.filter("doc_id % 3 = 0"),
        docs.filter("doc_id % 3 < 2").unionByName(odd),
        docs.selectExpr("doc_id", "CASE WHEN doc_id % 7 = 0 THEN concat('changed ', text) ELSE text END AS text", "source"),
        docs.selectExpr("doc_id", "text", "source").filter("doc_id % 2 = 0"),
    ]
    for k, v in enumerate(versions):
        v.write.mode("overwrite").parquet(path)
        counts = J.run(spark, path, at, CONFIG)
        assert counts["read"] == v.count() and counts["left_out"] == (1 if k == 1 else 0)
        assert entries(spark, at) == rebuilt(spark, v, f"{tmp_path}/again{k}")
        assert J.run(spark, path, at, CONFIG) == counts | {"new": 0, "changed": 0, "gone": 0}
    n = docs.count()
    assert counts["gone"] == n - versions[3].count() and counts["changed"] == docs.filter("doc_id % 14 = 0").count()
    batches = {r.batch for r in index.read(spark, at, "members").select("batch").distinct().collect()}
    assert batches == {1, 2, 3, 4}


def test_a_batch_holds_its_own_documents_only(spark, tmp_path):
    rows = [(i, f"alpha beta{i} gamma", "s") for i in range(40)]
    path, at = f"{tmp_path}/d", f"{tmp_path}/i"
    spark.createDataFrame(rows[:30], DOCS).write.parquet(path)
    J.run(spark, path, at, CONFIG)
    spark.createDataFrame(rows[30:], DOCS).write.mode("append").parquet(path)
    assert J.run(spark, path, at, CONFIG)["new"] == 10
    got = index.read(spark, at, "postings").groupBy("batch").agg({"block_id": "count"}).collect()
    assert {r[0]: r[1] for r in got} == {1: 90, 2: 30}


def test_a_batch_that_failed_before_its_end_is_done_again(spark, tmp_path):
    rows = [(i, f"alpha beta{i} gamma", "s") for i in range(40)]
    path, at = f"{tmp_path}/d", f"{tmp_path}/i"
    spark.createDataFrame(rows, DOCS).write.parquet(path)
    J.run(spark, path, at, CONFIG)
    first = entries(spark, at)
    fewer = [(i, t.replace("alpha", "omega") if i % 2 else t, s) for i, t, s in rows if i % 5]
    spark.createDataFrame(fewer, DOCS).write.mode("overwrite").parquet(path)
    counts = J.run(spark, path, at, CONFIG)
    want = entries(spark, at)
    shutil.rmtree(f"{at}/batches/batch=2")
    assert entries(spark, at) == first and want != first  # half a batch does not count
    assert J.run(spark, path, at, CONFIG) == counts and entries(spark, at) == want


def test_a_batch_of_removals_only(spark, tmp_path):
    path, at = f"{tmp_path}/d", f"{tmp_path}/i"
    spark.createDataFrame([(1, "alpha", "s"), (2, "beta", "s")], DOCS).write.parquet(path)
    J.run(spark, path, at, CONFIG)
    spark.createDataFrame([(2, "beta", "s")], DOCS).write.mode("overwrite").parquet(path)
    assert J.run(spark, path, at, CONFIG)["gone"] == 1
    spark.createDataFrame([(1, "alpha", "s"), (2, "beta", "s")], DOCS).write.mode("overwrite").parquet(path)
    assert J.run(spark, path, at, CONFIG)["new"] == 1
    assert [e[0] for e in sorted(entries(spark, at))] == ["alpha", "beta"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/d")
    assert J.run(spark, f"{tmp_path}/d", f"{tmp_path}/i", CONFIG) == {"read": 0, "left_out": 0, "new": 0, "changed": 0, "gone": 0}
    assert entries(spark, f"{tmp_path}/i") == set()


def test_command_line(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    J.main(["--documents", f"{sf}/documents.parquet", "--index", f"{tmp_path}/i"])
    assert entries(spark, f"{tmp_path}/i")
