"""Tables that grow: keyed upserts rewrite the touched folders only, and appending equals building all at once."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import base
from palimpsest.plans.engine import Engine
from palimpsest.sources import tables
from palimpsest.sources.config import load

EDGES = "src string, dst string, type string, ts_ms bigint, confidence double"


def files(at):
    return {os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}


def edges(spark, at):
    return sorted(map(tuple, tables.load_kept(spark, at, "relations").drop("bucket").collect()))


def test_one_row_rewrites_one_folder(spark, tmp_path):
    at = str(tmp_path)
    rows = [(f"a{i}", f"b{i}", "FOLLOWS", i, 0.5) for i in range(200)]
    touched = tables.upsert_kept(spark, at, "relations", spark.createDataFrame(rows, EDGES))
    assert len(touched) > 50 and edges(spark, at) == sorted(rows)
    before = files(at)
    one = [("a7", "b7", "FOLLOWS", 999, 0.9)]
    touched = tables.upsert_kept(spark, at, "relations", spark.createDataFrame(one, EDGES))
    after = files(at)
    assert len(touched) == 1 and {f"bucket={touched[0]}" in f for f in before ^ after} == {True}
    want = sorted([r for r in rows if r[0] != "a7"] + one)
    assert edges(spark, at) == want
    tables.upsert_kept(spark, at, "relations", spark.createDataFrame(one, EDGES))  # again
    assert edges(spark, at) == want
    tables.upsert_kept(spark, at, "relations", spark.createDataFrame(one, EDGES).limit(0), gone=spark.createDataFrame(rows, EDGES))
    assert edges(spark, at) == []
    assert tables.upsert_kept(spark, at, "relations", spark.createDataFrame(one, EDGES).limit(0)) == []


def test_empty_ends_and_null_values(spark, tmp_path):
    rows = [("", "b", "T", 1, None), ("a", "", "T", None, 0.1), ("", "b", "U", 2, 0.2)]
    tables.upsert_kept(spark, str(tmp_path), "relations", spark.createDataFrame(rows, EDGES), buckets=3)
    assert edges(spark, str(tmp_path)) == sorted(rows, key=str) or set(edges(spark, str(tmp_path))) == set(rows)


CFG = load(env={}, max_tokens_per_block=120, min_tokens_per_block=40)
COLUMNS = {"blocks": ["block_id", "token_count", "summary", "keywords", "tags", "retention_mode", "match_score", "conflict"], "relations": ["src", "dst", "type", "ts_ms", "confidence"], "raw_events": ["block_id", "events"]}


def contents(t):
    return {name: sorted(map(str, df.select(*COLUMNS[name]).collect())) for name, df in (("blocks", t.blocks), ("relations", t.edges), ("raw_events", t.raw))}


@pytest.fixture(scope="module")
def events(spark, sf):
    return base.events(spark, sf).cache()


def test_appending_equals_building_at_once(spark, events, tmp_path):
    at, engine = str(tmp_path), Engine(spark, CFG)
    n = events.select("session_id").distinct().count()
    half = F.col("session_id") % 2 == 0
    assert engine.append(events.filter(half), at) + engine.append(events.filter(~half & (F.col("seq") < 2)), at) == n
    engine.append(events.filter(~half & (F.col("seq") >= 2)), at)  # conversations go on
    assert contents(engine.kept(at)) == contents(engine.build(events))
    assert sorted(map(tuple, engine.kept(at).events.collect())) == sorted(map(tuple, events.collect()))
    engine.append(events.filter("session_id = 1"), at)  # what is there already
    assert contents(engine.kept(at)) == contents(engine.build(events))


def test_a_renewed_session_loses_what_it_had(spark, events, tmp_path):
    at, engine = str(tmp_path), Engine(spark, CFG)
    engine.append(events, at, seal_every=1)
    short = events.filter("session_id = 2 and seq = 0")
    before = files(f"{at}/blocks")
    engine.append(short, at, seal_every=1, renew=True)
    want = engine.build(events.filter("session_id <> 2").unionByName(short), seal_every=1)
    assert contents(engine.kept(at)) == contents(want)
    assert len({f.split("bucket=")[1].split("/")[0] for f in before ^ files(f"{at}/blocks")}) == 1


def test_two_ingests_keep_both_files(spark, tmp_path, capsys):
    from palimpsest.__main__ import main

    for name, words in (("one", "alpha database"), ("two", "beta harbour")):
        (tmp_path / f"{name}.txt").write_text(f"{words} first\n\n{words} second")
    for name in ("one", "two", "one"):
        main(["ingest", str(tmp_path / f"{name}.txt"), str(tmp_path / "t"), "--seal-every", "1"], spark)
    t = Engine(spark).kept(str(tmp_path / "t"))
    assert t.events.select("session_id").distinct().count() == 2 and t.events.count() == 4 and t.blocks.count() == 4
