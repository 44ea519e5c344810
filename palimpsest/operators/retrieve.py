"""Retrieval for a batch of queries: keywords, vectors, fusion, graph scores, boosts.

Batches of queries may be as large as the tables.  Ranking works on narrow rows (query, block, score); wide
block columns are joined to the winners.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import vectors
from palimpsest.operators import keywords, tiles
from palimpsest.shipping import ship
from palimpsest.sources.config import DEFAULT, Config
from palimpsest.storage import durable, setting

#: Vectors of queries and of blocks that are multiplied at a time.
QUERIES, BLOCKS = 512, 4000
#: Entries of a bucket table that a task cuts at a time.
CHUNK = 1 << 16
#: Postings over which a key counts as frequent.
OFTEN = 100
HITS = "query_id bigint, block_id string, score double"


def ranked(hits: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k of each query with their rank from 1."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def analyzed(queries: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """query_id, query with keywords, embedding and directional intent."""
    x = queries.withColumn("keywords", T.keywords("query", 8)).withColumn("embedding", vectors.hash_embedding("query", cfg.embedding_dim, cfg.embedding_seed))
    return x.withColumn("intent", T.directional_intent("query", cfg.relation_depth))


def _keyed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns, size (the number of different keywords) and keys, an array of (key, indexed, own): the index keys in order, then keywords that are none; own: it is one of the keywords as they are."""
    x = df.select(*columns, F.array_distinct(F.transform("keywords", F.lower)).alias("_own"), T.index_keys("keywords").alias("_index"))
    entry = lambda indexed: lambda k: F.struct(k.alias("key"), F.lit(indexed).alias("indexed"), F.array_contains("_own", k).alias("own"))
    keys = F.concat(F.transform("_index", entry(True)), F.transform(F.array_except("_own", "_index"), entry(False)))
    return x.select(*[c for c in x.columns if c not in ("_own", "_index")], F.size("_own").alias("size"), keys.alias("keys"))


def postings(blocks: DataFrame) -> DataFrame:
    """key, indexed, own, block_id, block_seq, size: the inverted index as a view; size is the number of the block's keywords."""
    return _keyed(blocks, "block_id", "block_seq").select(F.explode("keys").alias("k"), "block_id", "block_seq", "size").select("k.*", "block_id", "block_seq", "size")


def _packed(spark: SparkSession, *frames: DataFrame) -> list[DataFrame]:
    """Saved blocks; texts and vectors go to Python in small batches, and as they are saved a task has one Python worker at a time."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"):
        return [durable(x) for x in frames]


def packed_blocks(blocks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Saved blocks of blocks with keys and vectors both, so that their texts are parsed once for all searches."""
    there = _keyed(blocks, F.col("block_id").alias("id"), F.col("block_seq").cast("bigint").alias("block_seq"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("v"))
    x = keywords.flat(there).withColumn("dim", F.size("v"))
    return _packed(blocks.sparkSession, tiles.packed(x, "v", BLOCKS, unit=True))[0]


def keyword_topk(queries: DataFrame, blocks: DataFrame, k: int, there: DataFrame | None = None) -> DataFrame:
    """query_id, block_id, score, rank by Jaccard of keyword sets; ties by first shared key, then block order.

    Candidates that share only a two-character piece score 0 and keep their ranks.  Blocks of queries meet blocks of
    blocks as in vector_topk (operators.keywords), so a candidate is no row and a task keeps k a query.  there: packed_blocks,
    which may also come as blocks.
    """
    asked = _keyed(queries, F.col("query_id").cast("bigint").alias("id"))
    there = blocks if there is None and "hashes" in blocks.columns else there
    if there is None:
        own = _keyed(blocks, F.col("block_id").alias("id"), F.col("block_seq").cast("bigint").alias("block_seq"))
        hits = keywords.candidates(asked, own, k, (QUERIES, BLOCKS))
    else:
        hits = keywords.best_of(*_packed(queries.sparkSession, keywords.packed(asked, QUERIES)), there, k)
    return ranked(hits, k, F.desc("score"), "first", "block_seq", "block_id").select("query_id", "block_id", "score", "rank")


def keyword_scores_over(queries: DataFrame, there: DataFrame, least: float) -> DataFrame:
    """The rows of keyword_scores over a score, saved; there: packed_blocks.  Only such a candidate is a row."""
    asked = keywords.packed(_keyed(queries, F.col("query_id").cast("bigint").alias("id")), QUERIES)
    return keywords.scores(*_packed(queries.sparkSession, asked), there, least)


def keyword_scores(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, block_id, block_seq, first and the Jaccard score of all candidates; ids of blocks are unique.

    Candidates share an index key; first is the place of the first such key.  Postings carry the size of
    their block's set, so the score falls out of counts of shared keys and nothing is joined back.
    """
    return scored(queries, postings(blocks))


def query_keys(queries: DataFrame) -> DataFrame:
    """query_id, _size, pos, key, _indexed, _own: a row for each key that a query looks up."""
    q = _keyed(queries, "query_id").select("query_id", F.col("size").alias("_size"), F.posexplode("keys").alias("pos", "k"))
    return q.select("query_id", "_size", "pos", F.col("k.key").alias("key"), F.col("k.indexed").alias("_indexed"), F.col("k.own").alias("_own"))


def scored(queries: DataFrame, index: DataFrame) -> DataFrame:
    """As keyword_scores, from postings that were made before."""
    return _jaccard(query_keys(queries).join(index, "key"))


def _jaccard(both: DataFrame) -> DataFrame:
    """Scores from a row for each key that a query and a block share."""
    x = both.groupBy("query_id", "block_id", "block_seq").agg(
        F.min(F.when(F.col("indexed") & F.col("_indexed"), F.col("pos"))).cast("long").alias("first"), F.count(F.when(F.col("own") & F.col("_own"), 1)).alias("shared"), (F.max("size") + F.max("_size")).alias("sizes"),
    )
    union = F.col("sizes") - F.col("shared")
    return x.filter("first is not null").select("query_id", "block_id", "block_seq", "first", F.when(union == 0, 0.0).otherwise(F.col("shared") / union).alias("score"))


def pruned_topk(queries: DataFrame, index: DataFrame, k: int, often: int = OFTEN) -> DataFrame:
    """The rows of keyword_topk, from postings, without following frequent keys where they cannot matter.

    Keys with over often postings are held back (a query's rarest key never is).  What shares a rarer key is
    scored exactly, with the frequent keys looked up for these blocks only.  A block that shares held-back keys
    alone has at most their number in common, so with the sizes in the postings its score is bounded, and only
    postings whose bound reaches the query's k-th score so far are followed.
    """
    keys = query_keys(queries)
    counts = index.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("_df"))
    keys = keys.join(counts, "key")
    rarest = F.min(F.struct("_df", "pos")).over(Window.partitionBy("query_id"))
    keys = durable(keys.withColumn("_back", (F.col("_df") > often) & (F.col("pos") != rarest["pos"])).drop("_df"))
    back = keys.filter("_back").drop("_back")
    near = durable(keys.filter("NOT _back").drop("_back").join(index, "key"))
    found = near.select("query_id", "block_id").distinct()
    more = found.join(back, "query_id").join(index, ["key", "block_id"])
    first = durable(_jaccard(near.unionByName(more)))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "block_seq", "block_id")
    least = first.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") == k).select("query_id", F.col("score").alias("_least"))
    alone = back.groupBy("query_id").agg(F.count_if("_own").alias("_most"))
    held = back.join(alone, "query_id").join(least, "query_id", "left").join(index, "key")
    common = F.least("_most", "size")
    bound = F.when(common == 0, 0.0).otherwise(common / (F.col("_size") + F.col("size") - common))
    held = held.filter(F.col("_least").isNull() | (bound >= F.col("_least"))).drop("_most", "_least")
    rest = _jaccard(held.join(found, ["query_id", "block_id"], "left_anti"))
    return ranked(first.unionByName(rest), k, F.desc("score"), "first", "block_seq", "block_id").select("query_id", "block_id", "score", "rank")


def _vectors(df: DataFrame, name: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return df.select(v.alias("v"), F.col(name).alias("id"), F.size(v).alias("dim")).filter("dim > 0")


def vector_topk(queries: DataFrame, blocks: DataFrame, k: int, min_score: float | None = None, vector: str = "embedding", digits: int = 9, there: DataFrame | None = None) -> DataFrame:
    """query_id, block_id, score, rank by exact cosine among vectors of the query's length, ties by id.

    Blocks of queries meet blocks of blocks, each pair once, in one pass (operators.tiles); a task keeps k a
    query.  Scores are rounded to digits, so that ties do not hang on the order of sums.  there: packed_blocks.
    """
    left = tiles.packed(_vectors(queries, "query_id", vector), "v", QUERIES, unit=True)
    right = [tiles.packed(_vectors(blocks, "block_id", vector), "v", BLOCKS, unit=True)] if there is None else []
    left, *right = _packed(queries.sparkSession, left, *right)
    hits = tiles.best_beside(left, there if there is not None else right[0], HITS, tiles.UNITS, tiles.cosine_feed(k, digits), tiles.entries(["query_id", "block_id", "score"]))
    if min_score is not None:
        hits = hits.filter(F.col("score") >= min_score)
    return ranked(hits, k, F.desc("score"), "block_id")


def clamped(hits: DataFrame) -> DataFrame:
    """Scores as one less the cosine distance, within 0 and 1."""
    return hits.withColumn("score", S.clamp(F.col("score")))


def buckets(vectors_df: DataFrame, name: str, dim: int, tables: int, bits: int, rows: int, vector: str = "embedding", probes: tuple[int, ...] = (0,)) -> DataFrame:
    """m, id, table, key: the bucket table of sign hashes, in blocks of at most rows vectors of one bucket, by id (and probe: bits of the key that are turned).

    A task cuts CHUNK entries of a table at a time from vectors that it has once.  m has the vectors as they are, as
    float32 where that loses nothing, as a vector goes to each table.
    """
    ship(vectors_df.sparkSession)
    kind, turned = vectors_df.schema[name].dataType.simpleString(), np.array(probes, np.int32)
    valid = vectors_df.filter(vectors.is_valid(F.col(vector), dim)).select(F.col(vector).cast("array<double>").alias("v"), F.col(name).alias("id"))

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by("id")
        ids = t.column("id").combine_chunks()
        m = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        keys = vectors.sign_keys(m, tables, bits).astype(np.int32)
        with np.errstate(over="ignore", under="ignore"):
            narrow = m.astype(np.float32)
        m = narrow if (narrow == m).all() else m
        for table in range(tables):
            key = (keys[:, table, None] ^ turned).ravel()
            order = np.argsort(key, kind="stable")
            row, key = order // len(turned), key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            at = np.concatenate([np.arange(lo, hi, rows) for lo, hi in zip(first, [*first[1:], len(key)], strict=True)])
            ends = np.append(at, len(key))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(row)))
            cut = [m[row[lo:hi]].tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), lists, pa.array(np.full(len(at), table, np.int32)), pa.array(key[at])], ["m", "id", "table", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n * len(turned) >= CHUNK:
                yield from blocks(held)
                held, n = [], 0
        if n:
            yield from blocks(held)

    return valid.mapInArrow(run, f"m binary, id array<{kind}>, table int, key int")


def bucket_pairs(queries: DataFrame, vectors_df: DataFrame, dim: int, tables: int, bits: int, probe: int, vector: str = "embedding") -> DataFrame:
    """Blocks of queries beside blocks of vectors that lie in one bucket of a table, or within probe bits of it.

    Queries are dealt out before they are copied to their buckets, so that few tasks make large blocks of them.
    Neither side is broadcast: sizes are guessed from what goes into buckets(), which makes hundreds of copies of a query.
    """
    turned = tuple(sum(1 << b for b in some) for n in range(probe + 1) for some in combinations(range(bits), n))
    left = tiles.numbered(buckets(queries.select("query_id", vector).repartition("query_id"), "query_id", dim, tables, bits, QUERIES, vector, turned))
    right = buckets(vectors_df, "block_id", dim, tables, bits, BLOCKS, vector)
    return right.join(left.hint("merge"), (F.col("table") == F.col("l_table")) & (F.col("key") == F.col("l_key")))


def _bucket_feed(k: int, dim: int, digits: int):
    """For pairs of blocks of buckets: the k best cosines of each query."""

    def unit(b: pa.RecordBatch, i: int, prefix: str, n: int) -> np.ndarray:
        m = b.column(f"{prefix}m")[i].as_buffer()
        m = np.frombuffer(m, np.float32 if m.size == 4 * n * dim else np.float64).reshape(n, dim).astype(float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1)

    def feed(b: pa.RecordBatch, i: int, state: dict) -> None:
        keys, number, ids = tiles.values(b, i, "l_id"), b.column("l_number")[i].as_py(), tiles.values(b, i, "id")
        if number not in state:
            state[number] = tiles.Best(len(keys), k, object if ids.dtype == object else np.int64), keys.copy()
        s = np.round(tiles.product(unit(b, i, "l_", len(keys)), unit(b, i, "", len(ids))), digits)
        state[number][0].add(np.arange(len(keys)), s, np.ones(s.shape, bool), ids)

    return feed


def lsh_topk(queries: DataFrame, vectors_df: DataFrame, k: int, dim: int, tables: int = 6, bits: int = 12, probe: int = 1, min_score: float = -1.0, backfill: bool = True, vector: str = "embedding") -> DataFrame:
    """Approximate cosine top k: query keys and bucket keys of sign hashes are joined, and pairs in one bucket scored exactly.

    A query also looks at the keys that differ from its own in up to probe bits.  Both sides are packed by
    bucket before the join, so a row is a block of vectors of one bucket: a bucket with a third of all vectors
    is many rows, which adaptive execution splits, and its pairs stay inside a task.  Each side is shuffled once, and
    of what tasks find the k best are kept only.  How many neighbours are found hangs on how near they are: tables,
    bits and probe must fit the data.  With backfill, queries that found fewer than k candidates are answered by the
    exact search.
    """
    pairs = bucket_pairs(queries, vectors_df, dim, tables, bits, probe, vector)
    best = lambda found: ranked(found.groupBy("query_id", "block_id").agg(F.max("score").alias("score")), k, F.desc("score"), "block_id")
    hits = tiles.best_pairs([pairs], HITS, _bucket_feed(k, dim, 9), tiles.entries(["query_id", "block_id", "score"]), then=best)
    if not backfill:
        return hits.filter(F.col("score") >= min_score)
    enough = hits.filter(F.col("rank") == k).select("query_id")
    short = queries.join(enough, "query_id", "left_anti")
    near = hits.filter(F.col("score") >= min_score).join(enough, "query_id", "left_semi")
    return near if short.isEmpty() else near.unionByName(vector_topk(short, vectors_df, k, min_score, vector))  # which packs all vectors


def two_stage_topk(queries: DataFrame, blocks: DataFrame, k: int, total: int, cfg: Config = DEFAULT, rerank: bool = True) -> DataFrame:
    """Prescreen by hash vectors, then rerank some by local vectors (columns hash, local on both sides).

    total: number of blocks.  Queries without a local part keep the hash order, and so do those whose k-th
    and next hash scores lie far apart.
    """
    import math

    screen = min(total, min(cfg.hybrid_prescreen_max, max(cfg.hybrid_prescreen_min, math.floor(total * cfg.hybrid_prescreen_ratio))))
    first = vector_topk(queries, blocks, screen, None, "hash").withColumnsRenamed({"score": "hash_score", "rank": "hash_rank"})
    w = Window.partitionBy("query_id").orderBy("hash_rank")
    gap = F.col("hash_score") - F.lead("hash_score").over(w)
    sure = F.max(F.when(F.col("hash_rank") == k, gap >= cfg.hybrid_early_stop_min_gap)).over(Window.partitionBy("query_id"))
    sure = F.coalesce(sure, F.lit(False)) if cfg.hybrid_early_stop_min_gap > 0 else F.lit(False)
    x = first.withColumn("sure", sure).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    x = x.join(queries.select("query_id", F.col("local").alias("q")), "query_id").join(blocks.select("block_id", F.col("local").alias("v")), "block_id")
    some = lambda c: F.coalesce(F.exists(F.col(c), lambda e: e != 0), F.lit(False))
    again = some("q") & ~F.col("sure") & F.lit(rerank)
    x = x.filter(~again | (F.col("hash_rank") <= S.rerank_size(F.col("n"), k, cfg)))
    x = x.withColumn("score", F.when(again & some("v"), F.round(vectors.cosine("q", "v"), 9)).otherwise(F.col("hash_score")))
    return ranked(x, k, F.desc("score"), "hash_rank").select("query_id", "block_id", "score", "rank")


def semantic_text(summary: Column, first_raw: Column, limit: int = 512) -> Column:
    """What a block is reranked by: the summary if it is longer than the first event, else both, cut."""
    first = F.coalesce(first_raw, F.lit(""))
    return F.left(F.when(F.char_length(summary) > F.char_length(first), summary).otherwise(F.trim(F.concat_ws(" ", summary, first))), F.lit(limit))


def rrf(lists: dict[str, tuple[DataFrame, float]], k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked hits: sum of weight / (c + rank); ties by number of lists, list order, rank."""
    parts = None
    for i, (name, (hits, weight)) in enumerate(lists.items()):
        x = hits.select("query_id", "block_id", "rank", F.lit(name).alias("source"), F.lit(i).alias("place"), (weight / (c + F.col("rank"))).alias("part"))
        parts = x if parts is None else parts.unionByName(x)
    x = parts.groupBy("query_id", "block_id").agg(F.sum("part").alias("score"), F.count("*").alias("sources"), F.min(F.struct("place", "rank")).alias("seen"))
    return ranked(x, k, F.desc(F.round("score", 12)), F.desc("sources"), "seen.place", "seen.rank").select("query_id", "block_id", "score", "sources", "rank")


def semantic_topk(queries: DataFrame, blocks: DataFrame, cfg: Config = DEFAULT, index: DataFrame | None = None, there: DataFrame | None = None) -> DataFrame:
    """Both lists fused.  cfg.vector_search says how the vectors are searched: exact, lsh, or two_stage (columns hash and local on both sides).

    index: the blocks' postings, saved; with them frequent keywords are followed only where they can matter.
    there: packed_blocks; without an index the exact search makes them, so that both lists come from one pass over the blocks.
    """
    k = cfg.semantic_top_k
    if cfg.vector_search not in ("lsh", "two_stage") and index is None and there is None:
        there = packed_blocks(blocks)
    if cfg.vector_search == "lsh":
        near = lsh_topk(queries, blocks, k, cfg.embedding_dim, min_score=cfg.vector_min_score)
    elif cfg.vector_search == "two_stage":
        near = clamped(two_stage_topk(queries, blocks, k, blocks.count(), cfg)).filter(F.col("score") >= cfg.vector_min_score)
    else:
        near = vector_topk(queries, blocks, k, cfg.vector_min_score, there=there)
    words = keyword_topk(queries, blocks if there is None else there, k) if index is None else pruned_topk(queries, index, k)
    return rrf({"keyword": (words, cfg.keyword_weight), "vector": (near, cfg.vector_weight)}, k)


def add_scores(*scored: DataFrame) -> DataFrame:
    """query_id, block_id and the sum of scores over all lists."""
    out = scored[0].select("query_id", "block_id", "score")
    for s in scored[1:]:
        out = out.unionByName(s.select("query_id", "block_id", "score"))
    return out.groupBy("query_id", "block_id").agg(F.sum("score").alias("score"))


def open_block_scores(queries: DataFrame, open_blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Half Jaccard, half cosine on the unsealed text; open_blocks: session_id, block_id, text.  Only positive ones."""
    b = open_blocks.withColumn("bk", T.keywords("text", 8)).withColumn("bv", vectors.hash_embedding("text", cfg.embedding_dim, cfg.embedding_seed))
    x = queries.join(b, "session_id")
    score = S.jaccard(F.array_distinct(F.transform("keywords", F.lower)), F.array_distinct(F.transform("bk", F.lower))) * 0.5 + vectors.cosine("embedding", "bv") * 0.5
    return x.select("query_id", "block_id", score.alias("score")).filter("score > 0")


def with_open_blocks(scores: DataFrame, opened: DataFrame) -> DataFrame:
    """The higher of both scores."""
    return scores.select("query_id", "block_id", "score").unionByName(opened).groupBy("query_id", "block_id").agg(F.max("score").alias("score"))


def boosted(scores: DataFrame, intents: DataFrame, queries: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Scores with the boost of active predictions; also base, boost.  intents: query_id, block_id, confidence, active."""
    q = queries.select("query_id", S.keyword_sparse(F.col("query"), F.col("keywords")).alias("sparse"))
    x = scores.select("query_id", "block_id", "score").join(intents.select("query_id", "block_id", "confidence", "active"), ["query_id", "block_id"], "full_outer").join(q, "query_id")
    base, conf = F.coalesce("score", F.lit(0.0)), F.col("confidence")
    allowed = F.coalesce(F.col("active"), F.lit(False)) & conf.isNotNull() & S.boost_allowed(conf, base, F.col("sparse"), cfg)
    boost = F.when(allowed, S.prediction_boost(conf, F.col("sparse"), cfg)).otherwise(0.0)
    x = x.filter(F.col("score").isNotNull() | allowed)
    return x.select("query_id", "block_id", base.alias("base"), boost.alias("boost"), (base + boost).alias("score"))


def final_rank(scores: DataFrame, k: int) -> DataFrame:
    return ranked(scores, k, F.desc(F.round("score", 12)), "block_id")


def rank_shift(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, block_id, rank before and after the boost, their difference, and the gap to the k-th score.

    scores as boosted() gives them; a block without a score ranks behind all of them.  targets: query_id, block_id, k.
    """
    by = lambda c: Window.partitionBy("query_id").orderBy(F.desc(F.round(c, 12)), "block_id")
    x = scores.select("query_id", "block_id", "score", F.row_number().over(by("base")).alias("pre"), F.row_number().over(by("score")).alias("post"), F.count("*").over(Window.partitionBy("query_id")).alias("n"))
    sizes = x.groupBy("query_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("post", "score")).alias("s"))
    y = targets.join(sizes, "query_id").join(x.drop("n"), ["query_id", "block_id"], "left")
    kth = F.element_at(F.filter("s", lambda e: e["post"] == F.least("k", "n")), 1)["score"]
    pre, post = (F.coalesce(c, F.col("n") + 1) for c in ("pre", "post"))
    return y.select("query_id", "block_id", pre.cast("long").alias("pre"), post.cast("long").alias("post"), (pre - post).cast("long").alias("delta"), F.greatest(F.lit(0.0), kth - F.coalesce("score", F.lit(0.0))).alias("gap"))
