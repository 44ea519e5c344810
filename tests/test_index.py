"""The kept index against one made from all blocks at once: appends, removals, lookups, compaction."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import index, retrieve
from palimpsest.plans import base


@pytest.fixture(scope="module")
def blocks(spark, sf):
    x = base.simple_blocks(spark, sf, embed=False)
    return x.select("block_id", "block_seq", "keywords", F.sha2(F.col("text").cast("binary"), 256).alias("hash")).cache()


@pytest.fixture(scope="module")
def queries(spark, sf):
    return retrieve.analyzed(base.text_queries(spark, sf)).cache()


def found(df):
    return sorted(map(tuple, df.select("query_id", "block_id", "block_seq", "first", F.round("score", 9)).collect()))


def test_batches_and_removals_equal_a_rebuild(spark, blocks, queries, tmp_path):
    at = f"{tmp_path}/index"
    third = F.pmod(F.xxhash64("block_id"), F.lit(3))
    for i in range(3):
        assert index.update(spark, at, blocks.filter(third == i))["new"] == blocks.filter(third == i).count()
        assert index.update(spark, at, blocks.filter(third <= i)) == {"new": 0, "changed": 0, "gone": 0}
    assert found(index.scores(spark, at, queries)) == found(retrieve.keyword_scores(queries, blocks)) != []
    gone = blocks.filter("block_seq = 1").select("block_id")
    assert index.update(spark, at, blocks.limit(0), removals=gone)["gone"] == gone.count()
    left = blocks.join(gone, "block_id", "left_anti")
    assert found(index.scores(spark, at, queries)) == found(retrieve.keyword_scores(queries, left))
    index.compacted(spark, at, f"{tmp_path}/small")
    assert found(index.scores(spark, f"{tmp_path}/small", queries)) == found(retrieve.keyword_scores(queries, left))
    assert index.read(spark, f"{tmp_path}/small", "postings").count() == index.live(spark, at, "postings").count() < index.read(spark, at, "postings").count()
    # What was removed comes back as new, and unknown removals are none.
    assert index.update(spark, f"{tmp_path}/small", blocks, removals=spark.createDataFrame([("nobody",)], "block_id string"))["new"] == gone.count()
    assert found(index.scores(spark, f"{tmp_path}/small", queries)) == found(retrieve.keyword_scores(queries, blocks))


def test_a_lookup_reads_the_parts_of_its_keys(spark, blocks, queries, tmp_path):
    at = f"{tmp_path}/index"
    index.update(spark, at, blocks)
    one = queries.limit(1)
    parts = {r[0] for r in retrieve.query_keys(one).select(index.part_of("key")).distinct().collect()}
    plan = index.scores(spark, at, one)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "part#" in line)
    assert 0 < len(parts) < index.PARTS and "part#" in scan.split("PartitionFilters:")[1]


def test_no_index_yet(spark, queries, tmp_path):
    assert index.scores(spark, f"{tmp_path}/none", queries).count() == 0


@pytest.mark.parametrize("often", [0, 3, 40, 10_000])
def test_pruned_topk_gives_the_same_rows(spark, blocks, queries, often):
    want = sorted(map(tuple, retrieve.keyword_topk(queries, blocks, 6).collect()))
    assert sorted(map(tuple, retrieve.pruned_topk(queries, retrieve.postings(blocks), 6, often).collect())) == want != []


def test_pruning_on_one_very_frequent_key(spark, tmp_path):
    words = [["common"] + [f"w{(i * j) % 97}" for j in range(1, 1 + i % 6)] for i in range(3000)]
    b = spark.createDataFrame([(f"b{i:05d}", i, w, "h") for i, w in enumerate(words)], "block_id string, block_seq long, keywords array<string>, hash string")
    asked = [["common", f"w{i}", f"w{i + 1}", f"w{2 * i}"] for i in range(30)] + [["common"], ["common", "nothing"], ["nothing"], []]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, keywords array<string>")
    want = sorted(map(tuple, retrieve.keyword_topk(q, b, 5).collect()))
    postings = retrieve.postings(b)
    got = retrieve.pruned_topk(q, postings, 5, 500)
    assert sorted(map(tuple, got.collect())) == want
    # What is scored: the blocks that share a rarer key, or all for queries that have no other.
    rare = sum(len({i for i, w in enumerate(words) if set(w) & set(a) - {"common"}}) for a in asked[:30]) + 2 * 3000
    assert rare < 0.25 * retrieve.scored(q, postings).count()
    index.update(spark, str(tmp_path), b)
    assert sorted(map(tuple, index.topk(spark, str(tmp_path), q, 5, often=500).collect())) == want
