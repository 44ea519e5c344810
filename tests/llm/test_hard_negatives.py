"""Mined negatives against plain loops."""

import math

import pytest

from palimpsest.llm import hard_negatives as H
from palimpsest.operators import tiles


def brute(rows):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, x, label in kept:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), b, other) for b, y, other in kept]
        positives = sorted((s, b) for s, b, other in scored if other == label and b != a)[:5]
        for s, b in positives:
            fits = sorted((n, c) for n, c, other in scored if other != label and 80 * -s <= 100 * -n <= 100 * -s)[:5]
            out += [(a, b, rank, c, -s, -n) for rank, (n, c) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(partitions)
    df = df.selectExpr("*", "1 AS id", "2 AS anchor", "3 AS v", "4 AS place")
    got = H.hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["negative_score"] == "bigint"
    return sorted(map(tuple, got.collect()))


def grid(n, step=1):
    """Few distinct vectors, so that scores tie often."""
    return [(i, [((i * 5) % 7) / 8, ((i * 3) % 5) / 8 - 0.2, 0.5], i % 4) for i in range(0, n * step, step)]


def test_ties_and_labels(spark):
    rows = grid(420, 5)
    want = brute(rows)
    assert len(want) > 300 and mined(spark, rows) == want == mined(spark, rows, 1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = grid(230) + [
        (300, [0.9, 0.1, 0.5], None), (400, None, 1), (500, [nan, 0.1, 0.2], 1), (600, [0.1, -inf, 0.2], 1), (700, [None, 0.1, 0.2], 0),
        (None, [0.9, 0.9, 0.9], 1), (800, [], 1), (900, [0.5], 2), (1000, [0.5, 0.25, 0.5, 0.75], -3), (100, [0.5, 0.1, 0.5], 0),
        (1100, [0.0, 0.0, 0.0], 2), (1200, [-0.5, -0.5, -0.5], 3), (7, [0.5, 0.5, 0.5], 3), (1300, [3e30, 1.0, 1.0], 77),
    ]
    rows = [r for r in rows if r[0] != 1300] + [(7, [0.5, 0.5, 0.5], 3)] * 8 + [(200, [0.5, 0.5, 0.5], 3)] * 2
    assert mined(spark, rows) == brute(rows)


def test_huge_components_do_not_stop_it(spark):
    mined(spark, grid(210) + [(300, [3e38] * 3, 1), (301, [3e38, -3e38, 1.0], 1), (302, [3e38] * 3, 2)])


def test_one_hot_label_and_one_vector(spark):
    rows = [(i, [0.5, 0.25], 1 if i % 3 else 2) for i in range(500)]
    assert mined(spark, rows, 7) == brute(rows)


def test_empty_and_single(spark):
    assert mined(spark, []) == [] == mined(spark, [(100, [1.0], 1)]) == mined(spark, [(100, [1.0], 1), (101, [1.0], 1)])


@pytest.mark.parametrize("small", ["BROADCAST_BYTES", "ANCHORS", "CANDIDATES", "TASK_CELLS"])
def test_blocks_and_grids_change_nothing(spark, monkeypatch, small):
    rows = grid(600, 2)
    want = mined(spark, rows)
    monkeypatch.setattr(tiles if small == "BROADCAST_BYTES" else H, small, {"BROADCAST_BYTES": 1500, "TASK_CELLS": 100}.get(small, 3))
    assert mined(spark, rows) == want == brute(rows)


def test_states_passed_on_early_change_nothing(spark, monkeypatch):
    rows = grid(600, 2)
    monkeypatch.setattr(H, "ANCHORS", 2)
    monkeypatch.setattr(H, "best_pairs", lambda *a: tiles.best_pairs(*a, most=60))
    assert mined(spark, rows) == brute(rows)
