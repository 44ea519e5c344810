import hashlib
import random

import pytest

from palimpsest.llm import queries, repeats


def brute(rows, w=50):
    data = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in data:
        if d is not None:
            for p in range(len(b) - w + 1):
                k = hash(b[p : p + w])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        if d is not None:
            end = 0
            for p in range(len(b) - w + 1):
                if least[hash(b[p : p + w])] < d:
                    a, end = max(p, end), p + w
                    gone[a:end] = b"\1" * (end - a)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(df, **how):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in repeats.dedup(df, **how).collect()), key=str) == brute(rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in queries.op3_repeated_bytes(spark, sf).collect()), key=str) == brute(rows)
    check(docs.repartition(7), part=2000)


@pytest.mark.parametrize("crowd", [0, 2])
def test_crowded_grams(make, monkeypatch, crowd):
    """One K-gram before and after many different bytes, open at once where a task sees over crowd of its spans."""
    send = repeats._send
    monkeypatch.setattr(repeats, "_send", lambda items, buckets, many=None: send(items, buckets, None if many is None else crowd))
    r = random.Random(5)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    common = "the line that all of these have in common, word by word"
    rows = [(i, own(r.randint(0, 60)) + common[r.randint(0, 20) :] + own(r.randint(0, 60))) for i in range(80)]
    check(make(rows + rows[:7]).repartition(3), part=400)


def test_odd_rows(odd):
    check(odd)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("chunk", [64, 300, 1 << 20])
def test_random_copies(make, seed, chunk, monkeypatch):
    """Texts pieced together from shared passages, of few different letters or many, cut at any byte."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    r = random.Random(seed)
    letters = ["ab", "abcdefgh ", "aé😀 "][seed % 3]
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    pool = [text(r.randint(30, 160)) for _ in range(8)] + ["x" * 70, "xy" * 60]
    rows = []
    for i in range(40):
        parts = [r.choice(pool) if r.random() < 0.6 else text(r.randint(1, 90)) for _ in range(r.randint(1, 6))]
        p = r.choice(parts)
        parts.append(p[r.randint(0, len(p) // 2) :])
        rows.append((r.randint(0, 60), "".join(parts)))
    check(make(rows).repartition(5), part=300)


def test_what_stays(make):
    a = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    got = {r.doc_id: bytes(r.kept).decode() for r in repeats.dedup(make([(1, a), (2, "x" + a[3:] + "y"), (3, a[:49])]), texts=True).collect()}
    assert got == {1: a, 2: "xy", 3: a[:49]}


def test_empty_table(make):
    assert repeats.dedup(make([])).count() == 0
