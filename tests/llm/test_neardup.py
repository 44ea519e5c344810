import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from palimpsest.llm import neardup
from palimpsest.llm.components import connected_components


def fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """fps: list of (id, fingerprint)."""
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def check(df, **how):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = [(d, fingerprint(t)) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, components(fps))), key=str)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, **how).collect()), key=str)
    assert got == want


def test_odd_rows(odd):
    check(odd)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.mark.parametrize("limit", [1, 4, 4096])
@pytest.mark.parametrize("parts", ["1", "5"])
def test_links_are_complete(spark, limit, parts):
    """Clusters of fingerprints near each other, on both ways and over task edges."""
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                y ^= 1 << int(b)
            fps.add(y if y < 1 << 63 else y - (1 << 64))
    fps = sorted(fps)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = neardup.links(spark.createDataFrame([(x,) for x in fps], "fp long"), run_limit=limit)
        roots = {r.node: r.root for r in connected_components(found).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    least = components([(x, x & (1 << 64) - 1) for x in fps])
    assert {x: roots.get(x, x) for x in fps} == dict(zip(fps, least))


def test_long_path_is_one_component(spark):
    n = 500
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert all(roots[i] == 0 for i in range(n + 1)) and roots[1001] == 1000


def test_one_of_each(odd):
    left = neardup.one_of_each(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(2) == 0 and ids.count(1) == 1 and ids.count(3) == 1 and 4 not in ids and 8 in ids


def test_one_of_each_with_repeated_ids(make):
    """A text that is unlike any other stays, whatever else bears its id."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "quite another text of seven words"
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, "no id but its own words")]
    left = sorted(((r.doc_id, r.text) for r in neardup.one_of_each(make(rows)).collect()), key=str)
    assert left == sorted([(1, a), (5, b), (7, c), (7, c), (None, "no id but its own words")], key=str)


def test_empty_table(make):
    assert neardup.near_duplicates(make([])).count() == 0 and neardup.one_of_each(make([])).count() == 0
