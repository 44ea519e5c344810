"""Blocked products against plain loops: every pair once, by one broadcast and by several; ties; states passed on early."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import tiles
from palimpsest.storage import durable


def test_best_keeps_ties_by_id_whatever_the_order():
    r = np.random.default_rng(1)
    for k in (1, 3, 7):
        scores, ids = r.integers(0, 4, (5, 400)).astype(float), np.arange(400) * 3
        ok = r.random((5, 400)) < 0.8
        want = [sorted((-s, i) for s, i, o in zip(scores[j], ids, ok[j], strict=True) if o)[:k] for j in range(5)]
        best = tiles.Best(5, k)
        for part in np.array_split(r.permutation(400), 3):
            part = np.sort(part)
            best.add(np.arange(5), scores[:, part], ok[:, part], ids[part])
        assert [list(zip(-best.score[j], best.id[j], strict=True)) for j in range(5)] == want


def test_best_with_fewer_than_k():
    best = tiles.Best(2, 4)
    best.add(np.array([1]), np.array([[2.0, 3.0]]), np.array([[True, True]]), np.array([5, 6]))
    assert best.score.tolist() == [[-np.inf] * 4, [3, 2, -np.inf, -np.inf]] and best.id[1, :2].tolist() == [6, 5]


@pytest.mark.parametrize("limit", [1 << 20, 600])
def test_every_pair_once(spark, monkeypatch, limit):
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(tiles, "ROW_BYTES", 1)
    rows = spark.range(90).select(F.col("id"), F.expr("array(id, id % 7, 1)").cast("array<double>").alias("v")).repartition(5)
    left = durable(tiles.packed(rows.filter("id % 3 = 0"), "v", 8))
    pairs = tiles.paired(left, tiles.packed(rows, "v", 16))
    assert (len(pairs) > 1) == (limit == 600)

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                a, c = tiles.values(b, i, "l_id"), tiles.values(b, i, "id")
                s = tiles.product(tiles.matrix(b, i, "l_"), tiles.matrix(b, i))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, len(c))), pa.array(np.tile(c, len(a))), pa.array(s.ravel())], ["a", "c", "s"])

    got = sorted(tuple(r) for x in pairs for r in x.mapInArrow(run, "a long, c long, s double").collect())
    assert got == [(a, c, float(a * c + a % 7 * (c % 7) + 1)) for a in range(0, 90, 3) for c in range(90)]


def test_unlike_lengths_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, [4.0])], "id long, v array<double>").coalesce(1)
    block = tiles.packed(rows, "v", 10).first()
    assert block.width == 2 and np.frombuffer(block.m).tolist() == [1, 2, 0, 0, 4, 0] and block.id == [1, 2, 3]
    none = durable(tiles.packed(rows.limit(0), "v", 10))
    assert [x.count() for x in tiles.paired(none, tiles.packed(rows, "v", 10))] == [0]
    assert tiles.product(np.ones((1, 3)), np.ones((1, 2))).tolist() == [[2.0]]


def test_entries_keep_their_types_without_rows():
    for kind, keys in ((object, np.array(["a", "b"], object)), (np.int64, np.array([1, 2]))):
        best = tiles.Best(2, 3, kind)
        none = tiles.entries(["k", "id", "score"])(best, keys)
        best.add(np.array([0]), np.array([[1.0]]), np.array([[True]]), np.array(["x"], object) if kind is object else np.array([7]))
        assert len(none) == 0 and tiles.entries(["k", "id", "score"])(best, keys).schema == none.schema


def test_pairs_of_a_key_are_a_join_where_left_is_large(spark, monkeypatch):
    """However many slices left would have, right is read once."""
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 500)
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("key"), F.array(F.col("id").cast("double")).alias("v"))
    blocks = durable(tiles.packed(rows.repartition(4, "key").sortWithinPartitions("key"), "v", 6, by=("key",)))
    (pairs,) = tiles.paired(blocks, blocks, ("key",))
    got = pairs.select(F.explode("l_id").alias("a"), "id").select("a", F.explode("id").alias("b")).collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(200) for b in range(a % 7, 200, 7)]
