"""History match and nearest blocks by stretches against plain loops over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import words
from palimpsest.operators import history, relations, tiles
from palimpsest.storage import durable

BLOCK = "session_id bigint, block_seq bigint, block_id string, start_ms bigint, end_ms bigint, token_count bigint, summary string, keywords array<string>, embedding array<double>, raw_events array<struct<event_id: string, role: string, text: string, ts_ms: bigint>>"
HOUR = 3_600_000


def made(n=60, sessions=3, seed=1):
    """Few vectors, keywords and gaps, so that many scores tie; some rows lack something."""
    r = np.random.default_rng(seed)
    vectors = r.normal(size=(5, 6))
    rows = []
    for s in range(sessions):
        t = 0
        for i in range(n if s else 2 * n):
            t += int(r.choice([0, HOUR // 2, 3 * HOUR, 30 * HOUR]))
            keys = [["a", "b", "c", "d"][j] for j in r.integers(0, 4, r.integers(0, 4))]
            v = None if i % 17 == 5 else [] if i % 17 == 6 else vectors[r.integers(0, 5)].tolist()[: 6 - (i % 11 == 3)]
            text = f"{words.TRANSITION[0]} to something" if i % 5 == 0 else "plain"
            rows.append((s, i, f"s{s}b{i:04d}", t, t + 1000, 10, text, keys, v, []))
    return rows


def step(gap, steps, rest):
    return next((v for most, v in steps if gap <= most), rest)


NEAR = ((HOUR, 1.0), (6 * HOUR, 0.6), (24 * HOUR, 0.3))
AROUND = ((HOUR, 1.0), (6 * HOUR, 0.75), (24 * HOUR, 0.45), (72 * HOUR, 0.2))


def overlap(a, b):
    return sum(x in b for x in a) / max(len(a), len(b)) if a and b else 0.0


def best_of(rows, boosts=None):
    out = {}
    for s, i, name, start, end, _, text, keys, v, _ in rows:
        best = None
        for s2, j, other, _, end2, _, _, keys2, v2, _ in rows:
            if s2 != s or j >= i:
                continue
            cos = 0.0
            if v and v2 and len(v) == len(v2):
                a, b = np.array(v), np.array(v2)
                cos = float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b))
            new = 1 - sum(x in keys2 for x in keys) / len(keys) if keys else 0.0
            moves = (0.45 * any(h in text for h in words.TRANSITION) + new * 0.35 + step(abs(start - end2), NEAR, 0.0) * 0.2) * (1 if end2 <= start else 0.45)
            boost = (boosts or {}).get((other, name), 0.0)
            score = min(1.0, (cos * 0.63 + overlap(keys, keys2) * 0.27 + step(abs(end - end2), NEAR, 0.0) * 0.1) * (1 - min(1, max(0, moves)) * 0.22) + boost)
            if round(score, 9) > 0 and (best is None or round(score, 9) > best[0]):
                best = (round(score, 9), other, round(new, 9), round(min(1, max(0, moves)), 9))
        out[name] = best or (0.0, None, 0.0, 0.0)
    return out


def found(df):
    return {r.block_id: (round(r.match_score, 9), r.best_id, round(r.novelty, 9), round(r.affinity, 9)) for r in df.collect()}


@pytest.mark.parametrize("stretch, limit", [(2000, 48 << 20), (7, 48 << 20), (7, 3000)])
def test_best_earlier_block(spark, monkeypatch, stretch, limit):
    monkeypatch.setattr(history, "STRETCH", stretch)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", limit)
    rows = made()
    assert found(history.match(spark.createDataFrame(rows, BLOCK).repartition(4))) == best_of(rows)


def test_edges_add_to_their_pairs(spark):
    rows = made(20, 2)
    edges = [("s0b0001", "s0b0030", "CAUSES"), ("s0b0030", "s0b0009", "FOLLOWS"), ("s1b0003", "s0b0020", "CAUSES"), ("s1b0004", "s1b0010", "UNKNOWN")]
    edges += [(f"s0b{i:04d}", f"s0b{i + 4:04d}", "FOLLOWS") for i in range(30)]
    boosts = {}
    for a, b, kind in edges:
        w = words.TYPE_WEIGHT.get(kind, words.OTHER_WEIGHT)
        boosts[a, b], boosts[b, a] = max(w, boosts.get((a, b), 0)), max(w * 0.6, boosts.get((b, a), 0))
    got = found(history.match(spark.createDataFrame(rows, BLOCK), spark.createDataFrame(edges, "src string, dst string, type string")))
    assert got == best_of(rows, boosts) and got != best_of(rows)


@pytest.mark.parametrize("stretch", [2000, 5])
def test_nearest_blocks(spark, monkeypatch, stretch):
    monkeypatch.setattr(history, "STRETCH", stretch)
    rows = made(40, 2)
    want = set()
    for s, i, name, _, end, _, _, keys, _, _ in rows:
        near = sorted((-(overlap(keys, k2) * 0.7 + step(abs(end - e2), AROUND, 0.08) * 0.3), j, o) for s2, j, o, _, e2, _, _, k2, _, _ in rows if s2 == s and j < i)[:4]
        want |= {(name, o, round(-x, 12), n) for n, (x, _, o) in enumerate(near, 1)}
    got = {(r.block_id, r.other, round(r.score, 12), r["rank"]) for r in relations.neighbors(spark.createDataFrame(rows, BLOCK).repartition(3), 4).collect()}
    assert got == want


def test_a_long_session_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(history, "STRETCH", 100)
    x = spark.range(3000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("block_seq"), F.format_string("b%06d", "id").alias("block_id"), F.array().cast("array<double>").alias("v"), F.array(F.xxhash64(F.col("id") % 50)).alias("keys"), (F.col("id") * 1000).alias("end_ms"))
    got = history.nearest(x.withColumn("keywords", F.array(F.concat(F.lit("k"), (F.col("block_seq") % 50).cast("string")))), 1)
    # All with the same keyword lie within an hour or two; the nearest of them in time comes first, and of these the earliest.
    assert got.count() == 2999 and all(int(r.other[1:]) % 50 == int(r.block_id[1:]) % 50 for r in got.filter("block_id > 'b000050'").collect())
    (pairs,) = tiles.paired(durable(history.stretches(x)), history.stretches(x), ("session_id",))
    assert pairs.count() == 900 and pairs.select(F.spark_partition_id()).distinct().count() > 3


def test_no_blocks(spark):
    none = spark.createDataFrame([], BLOCK)
    assert history.match(none).count() == 0 == relations.neighbors(none, 3).count()
