"""What the search by sign hashes passes on: vectors once to each bucket, as narrow as they are, and the k best of each query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vectors
from palimpsest.operators import retrieve, tiles
from palimpsest.storage import setting

SCHEMA = "block_id string, embedding array<double>"


def frames(spark, m):
    b = spark.createDataFrame([(f"b{i:04d}", r.tolist()) for i, r in enumerate(m)] + [("none", None), ("short", [1.0]), ("nan", [float("nan")] * m.shape[1])], SCHEMA).repartition(3)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, len(m), 20)], "query_id bigint, embedding array<double>")
    return q, b


@pytest.mark.parametrize("narrow", [True, False])
@pytest.mark.parametrize("small", [False, True])
def test_buckets_hold_every_vector_once_a_table(spark, monkeypatch, narrow, small):
    if small:
        monkeypatch.setattr(retrieve, "CHUNK", 50)
    m = np.random.default_rng(2).normal(size=(300, 16))
    m = m.astype(np.float32).astype(float) if narrow else m
    rows = retrieve.buckets(frames(spark, m)[1], "block_id", 16, 4, 3, 7 if small else 4000, probes=(0, 1)).collect()
    assert sum(len(r.m) for r in rows) == 300 * 4 * 2 * 16 * (4 if narrow else 8)
    assert all(len(r.id) <= (7 if small else 4000) and r.id == sorted(r.id) for r in rows)
    keys = vectors.sign_keys(m, 4, 3).astype(int)
    assert sorted((r.table, r.key, i) for r in rows for i in r.id) == sorted((t, keys[i, t] ^ p, f"b{i:04d}") for i in range(300) for t in range(4) for p in (0, 1))
    for r in rows:
        assert np.array_equal(np.frombuffer(r.m, np.float32 if narrow else np.float64).reshape(-1, 16), m[[int(i[1:]) for i in r.id]])


def test_only_the_k_best_of_a_query_are_saved(spark, monkeypatch):
    """lsh_topk saved its queries in all their buckets, and what every bucket found of them."""
    monkeypatch.setattr(retrieve, "CHUNK", 200)
    m = np.random.default_rng(3).normal(size=(400, 16))
    m[200:] = m[:200]  # ties
    q, b = frames(spark, m)
    saved = []
    for module in (retrieve, tiles):
        real = module.durable
        monkeypatch.setattr(module, "durable", lambda df, real=real: saved.append(real(df)) or saved[-1])
    got = {(r.query_id, r["rank"]): (r.block_id, r.score) for r in retrieve.lsh_topk(q, b, 3, 16, tables=8, bits=4).collect()}
    assert [(x.columns, x.count()) for x in saved] == [(["query_id", "block_id", "score", "rank"], 20 * 3)]
    keys = vectors.sign_keys(m, 8, 4).astype(int)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 400, 20):
        near = [j for j in range(400) if any(bin(a ^ c).count("1") <= 1 for a, c in zip(keys[i], keys[j], strict=True))]
        want = sorted((-round(float(u[i] @ u[j]), 9), f"b{j:04d}") for j in near)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [(name, pytest.approx(-s, abs=2e-9)) for s, name in want]


def test_buckets_are_never_broadcast(spark):
    """The copies of the queries went through the driver, as their size was guessed from the queries before they were copied."""
    q, b = frames(spark, np.random.default_rng(4).normal(size=(400, 16)))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "10m"):
        pairs = retrieve.bucket_pairs(q, b, 16, 8, 4, 1)
        assert len(pairs.collect()) > 0
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_a_query_without_enough_candidates_still_gets_the_exact_answer(spark):
    m = np.eye(16)[:12]
    q, b = frames(spark, m)
    got = retrieve.lsh_topk(q, b, 12, 16, tables=1, bits=12)
    assert got.orderBy("rank").select("block_id").collect() == retrieve.vector_topk(q, b, 12).orderBy("rank").select("block_id").collect()
    assert got.filter(F.col("rank") == 1).first().block_id == "b0000"
