import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import fingerprints, queries


def simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    votes, total = [0] * 64, 0
    for w in words:
        h, n = xxhash.xxh64_intdigest(w.encode(), seed=42), len(w.encode())
        n = max(n - 2, 1) * min(n, 12)
        total += n
        votes = [v + n * (h >> i & 1) for i, v in enumerate(votes)]
    return sum(1 << i for i, v in enumerate(votes) if 2 * v > total)


def brute(rows):
    key = lambda r: (0, -r[0]) if r[0] is not None else (1, 0)
    rows = sorted(((d, t or "") for d, t in rows), key=key)
    fps = [simhash(t) for _, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        k = len(t) // 3
        edited = t[: len(t) - k] + rows[j][1][:k]
        e = simhash(edited)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[i]:016x}", f"{e:016x}", 1 - (fps[i] ^ e).bit_count() / 64, 1 - (fps[i] ^ fps[j]).bit_count() / 64))
    return out


@pytest.mark.parametrize("block", [2, 1000])
def test_whole_table(spark, sf, block, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op6_fingerprints(spark, sf).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(brute(rows))
    fps = [int(r.fingerprint, 16) for r in got]
    for r, f in zip(got, fps):
        assert r.near_other == (sum((f ^ g).bit_count() <= 3 for g in fps) > 1)


@pytest.mark.parametrize("block", [1, 1000])
def test_odd_rows(make, block, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    long = "Wörter und Zeichen \U0001f600 " * 30_000
    rows = [(1, "a b c d"), (-5, "a b c d"), (3, None), (40, ""), (5, " \t\n"), (60, long), (7, long + "end"), (1000, "é" * 1000), (90, "İstanbul ſ"), (12, "one  two\n\nthree "), (2**62, "x y"), (-(2**62), "z")]
    got = fingerprints.edited_fingerprints(make(rows)).collect()
    name = lambda x: f"{x & (1 << 64) - 1:016x}"
    got = sorted((r[0], r[1], r[2], name(r[3]), name(r[4]), *tuple(r)[5:]) for r in got)
    want = sorted(brute(rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3:] for g in got if g[0] != 90] == [w[3:] for w in want if w[0] != 90]


def test_nulls_and_repeated_rows(make):
    rows = [(None, "p q r"), (1, "a b c"), (1, "a b c"), (2, "d e f g"), (None, None)]
    got = fingerprints.edited_fingerprints(make(rows)).collect()
    assert len(got) == 5 and sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None", "None"]
    assert fingerprints.fingerprints(make(rows)).count() == 5


@pytest.mark.parametrize("quantiles", [2, 4, 64])
def test_crowded_and_clustered_ids(make, quantiles, monkeypatch):
    """An id and null that many rows share, and ids that lie close together beside one far away: every row has its successor."""
    monkeypatch.setattr(fingerprints, "BLOCK", 3)
    monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
    rows = [(None, f"none {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(50)] + [(5, "five"), (9, "nine"), (11, "x")] + [(10**6 + i, f"near {i}") for i in range(60)] + [(2**60, "far")]
    got = fingerprints.with_next(make(rows).repartition(5)).collect()
    assert len(got) == len(rows)
    after = {(r._id, r._text): (r._next_id, r._next) for r in got}
    at, seen = (2**60, "far"), []
    for _ in rows:
        seen.append(at)
        at = after[at]
    assert at == (2**60, "far") and sorted(seen, key=str) == sorted(rows, key=str)
    ids = [i for i, _ in seen]
    assert ids == sorted([i for i in ids if i is not None], reverse=True) + [None] * 40
    blocks = fingerprints._placed(make(rows).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))).groupBy("_block").count().collect()
    assert quantiles == 2 or max(r["count"] for r in blocks) <= 15  # eight parts are too few for small blocks


def test_crowd_without_near_pairs(spark):
    """Fingerprints that share half their bits and are all far apart go through the finer tables."""
    rng = np.random.default_rng(5)
    fps = {0x1234567800000000 | int(x) for x in rng.integers(0, 1 << 32, 9000)}
    pair = 0x1234567800000000 | 0xFFFF0000
    fps |= {pair, pair ^ 0b111}
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    want = {int(x) for x in a if (np.bitwise_count(a ^ x) <= 3).sum() > 1}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert {r.fp for r in fingerprints.has_near(df, crowd=500).collect()} == want and pair in want


def test_one_row_and_empty_table(make):
    r = fingerprints.edited_fingerprints(make([(4, "abc def ghi")])).collect()
    assert [tuple(x)[:3] for x in r] == [(4, 11, hashlib.sha256(b"abc def abc").hexdigest())]
    assert fingerprints.edited_fingerprints(make([])).count() == 0


@pytest.mark.parametrize("crowd", [2, 500])
def test_search_is_complete(spark, crowd):
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(10):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                y ^= 1 << int(b)
            fps.add(y - (1 << 64) if y >> 63 else y)
    df = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    near = {(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    near |= {(b, a) for a, b in near}
    got = {tuple(r) for r in fingerprints.within(df, df.withColumnRenamed("fp", "query"), crowd=crowd).collect()}
    assert got == near
    assert {r.fp for r in fingerprints.has_near(df, crowd=crowd).collect()} == {a for a, _ in near}


def test_edit_is_nearer_than_the_next(spark):
    got = queries.op6_fingerprints(spark, "/root/testdata/sf0.01").collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.1
