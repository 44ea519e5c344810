import re

import numpy as np
import pytest

from palimpsest.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by sharing the excess out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    for _ in range(1000):
        if rest < 1e-9 or not open_:
            break
        unit = rest / sum(w[s] for s in open_)
        rest = 0.0
        for s in sorted(open_, key=str):
            target[s] += unit * w[s]
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(df):
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((d, size(t)) for d, t, _ in rows if d is not None)
    total, docs = {}, {}
    for d, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
        docs.setdefault(d, (size(t), s))
    want, taken = water(total), dict.fromkeys(total, 0)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        if r.doc_id is not None:
            s = docs[r.doc_id][1]
            assert r.source_size == total[s] and r.target == pytest.approx(want[s], rel=1e-9)
            taken[s] += r.taken
    return want, taken, {s: max(size(t) for _, t, x in rows if x == s) for s in total}


def test_whole_table(spark, sf):
    want, taken, most = check(spark.read.parquet(f"{sf}/documents.parquet"))
    for s in want:
        assert abs(taken[s] - want[s]) <= 1.1 * most[s]


def test_odd_rows_and_reruns(odd):
    check(odd)
    a, b = (sorted(map(str, mixing.mix(odd.repartition(n)).collect())) for n in (1, 5))
    assert a == b


def test_many_blocks(spark):
    """A hot source over several levels of flights stays near its target, in words and in documents."""
    df = spark.range(30_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + pmod(xxhash64(id), 50) as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    x = mixing.mix(df).groupBy("source_size", "target").agg({"taken": "sum", "copies": "sum", "*": "count"}).collect()
    for r in x:
        assert abs(r["sum(taken)"] - r["target"]) <= 100
        assert abs(r["sum(copies)"] - r["count(1)"] * r["target"] / r["source_size"]) <= 4


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 90, 200).astype(float)
    p = np.full(200, 0.37)
    words, docs = (p * size).sum(), p.sum()
    mixing.fly(p, size, rng)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert (p * size).sum() == pytest.approx(words) and p.sum() == pytest.approx(docs)


def test_probabilities_hold():
    hits = np.zeros(6)
    for seed in range(3000):
        p = np.array([0.3, 0.3, 0.3, 0.5, 0.5, 0.5])
        size = np.array([1.0, 5, 9, 2, 2, 7])
        mixing.fly(p, size, np.random.default_rng(seed))
        hits += p
    assert np.allclose(hits / 3000, [0.3, 0.3, 0.3, 0.5, 0.5, 0.5], atol=0.03)


def test_take(odd):
    plan = mixing.mix(odd)
    rows = mixing.take(odd)
    assert rows.columns == odd.columns
    assert rows.count() == plan.agg({"copies": "sum"}).first()[0]


def test_empty_table(make):
    assert mixing.mix(make([])).count() == 0 and mixing.take(make([])).count() == 0
