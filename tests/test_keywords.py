"""Keyword search by blocks against the rows of a join: ties, pieces of words, small blocks and slices; and what goes to Python."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors
from palimpsest.operators import keywords, retrieve, tiles


def rows(df):
    return sorted(map(tuple, df.collect()))


def by_join(q, b, k):
    """Through a row for each key that a query and a block share."""
    x = retrieve.keyword_scores(q, b)
    return rows(retrieve.ranked(x, k, F.desc("score"), "first", "block_seq", "block_id").select("query_id", "block_id", "score", "rank"))


@pytest.mark.parametrize("sizes, limit", [((512, 4000), 1 << 20), ((3, 7), 1 << 20), ((4, 5), 400)])
def test_ties_pieces_and_empty_sets(spark, monkeypatch, sizes, limit):
    monkeypatch.setattr(retrieve, "QUERIES", sizes[0])
    monkeypatch.setattr(retrieve, "BLOCKS", sizes[1])
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(tiles, "ROW_BYTES", 8)
    words = [["Common", "common", f"w{i % 3}", " x "][: 1 + i % 4] + ["日本語", "日本", "x"][: i % 3] for i in range(60)] + [[], ["  "], None]
    b = spark.createDataFrame([(f"b{i * 37 % 64:02d}", i // 9, w) for i, w in enumerate(words)], "block_id string, block_seq long, keywords array<string>").repartition(5)
    asked = [["common", "w1"], ["W2", "common", "x"], ["本語", "w0"], [" x ", "X"], ["nothing"], [], None, ["日本語", "w1", "w2"]]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, keywords array<string>")
    for k in (1, 4, 100):
        assert rows(retrieve.keyword_topk(q, b, k)) == by_join(q, b, k) != []


def test_many_ties_in_one_block_are_cut_to_k():
    import numpy as np

    r, n, k = np.random.default_rng(3), 900, 4
    best, seq, ids = keywords.Nearest(3, k), r.integers(0, 3, n), np.array([f"b{i:04d}" for i in r.permutation(n)], object)
    score, first = r.integers(0, 3, 3 * n) / 7, r.integers(0, 3, 3 * n)
    row, col = np.divmod(np.arange(3 * n), n)
    for part in np.array_split(r.permutation(3 * n), 2):
        best.add(row[part], score[part], first[part], col[part], seq, ids)
    for j in range(3):
        mine = row == j
        want = sorted(zip(-score[mine], first[mine], seq, ids, strict=True))[:k]
        assert list(zip(-best.score[j], best.first[j], best.seq[j], best.id[j], strict=True)) == want


def test_no_candidate_is_a_row_of_a_shuffle(spark):
    """All 300 queries share a word with all 3,000 blocks: a task passes on k rows a query, not 900,000."""
    b = spark.range(3000).select(F.format_string("b%05d", "id").alias("block_id"), F.col("id").alias("block_seq"), F.array(F.lit("common"), F.format_string("w%d", "id")).alias("keywords")).repartition(4)
    q = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit("common"), F.format_string("w%d", F.col("id") * 7)).alias("keywords"))
    hits = keywords.candidates(retrieve._keyed(q, F.col("query_id").alias("id")), retrieve._keyed(b, F.col("block_id").alias("id"), "block_seq"), 5, (512, 4000))
    assert 300 * 5 <= hits.count() <= 300 * 5 * 4
    assert rows(retrieve.keyword_topk(q, b, 5)) == by_join(q, b, 5)


def test_text_functions_hold_few_rows_as_objects(spark, monkeypatch):
    """Keywords and embeddings of batches that are larger than the rows taken at a time, against one row at a time."""
    texts = ["", "a an THE", "Straße straße ÉTÉ été x1 x1", "日本 語 😀 zwei zwei drei"] + [f"word{i} word{i % 5} word{i % 5} tail" for i in range(700)]
    d = spark.createDataFrame(list(enumerate([*texts, None])), "id long, t string").coalesce(1)
    got = d.select("id", T.keywords("t", 3).alias("k"), vectors.hash_embedding("t", 16, 5).alias("e"), T.tokens(F.coalesce("t", F.lit(""))).alias("n")).orderBy("id").collect()
    for r, t in zip(got, [*texts, None], strict=True):
        count = [0] * 16
        for w in r.n:
            count[vectors.hash_of(w, 5) % 16] += 1
        size = sum(c * c for c in count) ** 0.5
        assert r.k == T.keyword_list(t, 3) and r.e == pytest.approx([c / size if size else 0 for c in count])


def test_embedding_a_batch_takes_little_memory():
    """Ten million characters in one batch: as objects its tokens alone are over 100 MB."""
    import tracemalloc

    import pyarrow as pa

    s = pa.array([" ".join(f"w{(i * j) % 1000:05d}" for j in range(400)) for i in range(4000)])
    tracemalloc.start()
    out = vectors.embedded(s, 64)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4000 and most < 40e6


def test_both_searches_and_the_scores_come_from_one_pass(spark, monkeypatch):
    """Blocks packed with keys and vectors give what each search packs for itself; texts are parsed once, rows without keys or vector included."""
    monkeypatch.setattr(retrieve, "BLOCKS", 7)
    monkeypatch.setattr(keywords, "OUT", 5)
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: seen.add(1) or t)
    texts = [" ".join(f"w{(i * j) % 11}" for j in range(1, 2 + i % 9)) for i in range(60)] + ["", "the", "x"]
    b = spark.createDataFrame([(f"b{i:02d}", i, t) for i, t in enumerate(texts)], "block_id string, block_seq long, t string").repartition(4)
    b = b.withColumn("t", count.asNondeterministic()("t")).select("block_id", "block_seq", vectors.analysis("t", 8, 16).alias("a")).select("block_id", "block_seq", "a.keywords", "a.embedding")
    b = b.withColumn("embedding", F.when(F.col("block_seq") != 7, F.col("embedding")))
    q = spark.createDataFrame([(i, texts[i * 5]) for i in range(13)], "query_id long, query string").select("query_id", T.keywords("query", 8).alias("keywords"), vectors.hash_embedding("query", 16).alias("embedding"))
    there = retrieve.packed_blocks(b)
    assert seen.value == len(texts)
    assert rows(retrieve.keyword_topk(q, b, 4, there)) == rows(retrieve.keyword_topk(q, b, 4))
    assert rows(retrieve.vector_topk(q, b, 4, there=there)) == rows(retrieve.vector_topk(q, b, 4))
    assert rows(retrieve.keyword_scores_over(q, there, 0.2)) == rows(retrieve.keyword_scores(q, b).filter("score > 0.2")) != []
    before = seen.value
    retrieve.semantic_topk(q, b).count()
    assert seen.value - before == len(texts)


def test_a_hybrid_search_parses_its_documents_once(spark, sf, monkeypatch):
    """Both lists, and the ids that the graph step looks up, from one use of the text functions."""
    from palimpsest.plans import q_retrieve

    made = []
    for name, module in (("analysis", vectors), ("hash_embedding", vectors), ("keywords", T)):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _n=name, _f=real, **k: made.append(_n) or _f(*a, **k))
    q_retrieve._docs(spark, sf).count()
    assert made == ["analysis"]
