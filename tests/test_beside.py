"""Searches in which no pair of blocks is a row: what tasks read, and results at the edge of what float32 and bounds tell apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieve, tiles

DOUBLES = "array<double>"


def small(monkeypatch, limit=1 << 20):
    for module, name, value in ((retrieve, "QUERIES", 7), (retrieve, "BLOCKS", 30), (tiles, "BROADCAST_BYTES", limit), (tiles, "ROW_BYTES", 8), (tiles, "TASKS", 1)):
        monkeypatch.setattr(module, name, value, raising=False)


def test_no_pair_of_blocks_goes_through_the_jvm(spark, monkeypatch):
    """Each pair was a row of a join, with both blocks in it: bytes that grew with the square."""
    small(monkeypatch)
    b = spark.range(90).select(F.format_string("b%05d", "id").alias("block_id"), F.col("id").alias("block_seq"), F.array(F.lit("common"), F.format_string("w%d", "id")).alias("keywords"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    q = b.select(F.col("block_seq").alias("query_id"), "keywords", "embedding")
    plans, real = [], tiles.durable
    monkeypatch.setattr(tiles, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    there = retrieve.packed_blocks(b)
    assert retrieve.vector_topk(q, b, 2).count() == retrieve.keyword_topk(q, b, 2).count() == 180
    assert retrieve.keyword_scores_over(q, there, 0.2).count() == 90 * 90
    assert len(plans) == 3 and not any("Join" in p for p in plans)


@pytest.mark.parametrize("limit", [1 << 20, 2500])
@pytest.mark.parametrize("copies", [1, 20])
def test_cosines_that_float32_does_not_tell_apart(spark, monkeypatch, limit, copies):
    small(monkeypatch, limit)
    r = np.random.default_rng(6)
    m = r.normal(size=(60 // copies, 16))
    m = np.repeat(m, 6 * copies, axis=0) + 1e-7 * r.normal(size=(360, 16)) * (np.arange(360) % 3 > 0)[:, None]  # copies, and others by 1e-7 beside them
    rows = [(f"b{i * 37 % 360:04d}", x.tolist()) for i, x in enumerate(m)] + [("zero", [0.0] * 16), ("short", [1.0, 2.0]), ("nan", [float("nan")] * 16), ("none", None)]
    b = spark.createDataFrame(rows, f"block_id string, embedding {DOUBLES}").repartition(5)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 360, 7)] + [(1000, [1.0, 1.0])], f"query_id long, embedding {DOUBLES}")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for x in retrieve.vector_topk(q, b, 5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.block_id, x.score))
    assert [name for name, _ in got.pop(1000)] == ["short"]
    assert len(got) == 52
    for i, found in got.items():
        score = dict(zip((name for name, _ in rows), u @ u[i], strict=False)) | {"zero": 0.0}
        assert [s for _, s in found] == pytest.approx(sorted(score.values(), reverse=True)[:5], abs=2e-9)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(score[name] == pytest.approx(s, abs=2e-9) for name, s in found)


@pytest.mark.parametrize("limit", [1 << 20, 400])
def test_bounds_of_keyword_scores_lose_nothing(spark, monkeypatch, limit):
    small(monkeypatch, limit)
    r = np.random.default_rng(5)
    some = lambda n: [["日本語", "本語"][w % 2] if w == 3 else f"k{w}" for w in np.minimum(r.zipf(1.4, r.integers(0, n)), 60).tolist()]
    b = spark.createDataFrame([(f"b{i * 7 % 400:04d}", i % 3, some(10)) for i in range(400)], "block_id string, block_seq long, keywords array<string>").repartition(4)
    q = spark.createDataFrame([(i, some(10)) for i in range(60)], "query_id long, keywords array<string>")
    want = retrieve.ranked(retrieve.keyword_scores(q, b), 6, F.desc("score"), "first", "block_seq", "block_id").select("query_id", "block_id", "score", "rank")
    assert sorted(map(tuple, retrieve.keyword_topk(q, b, 6).collect())) == sorted(map(tuple, want.collect())) != []
