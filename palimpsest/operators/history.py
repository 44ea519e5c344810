"""History match: each block against all earlier blocks of its session, and the retention that follows.

The best earlier block and the nearest ones are found by products of blocks of rows (operators.tiles): a
session is cut into stretches, pairs of stretches are shared out over tasks, and a task keeps the best so far
of each row.  What follows from the winners is worked out by columns, for the winners only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import vectors
from palimpsest.operators import tiles
from palimpsest.sources.config import DEFAULT, Config
from palimpsest.storage import durable

from .seal import event_text

#: Blocks of a session in a stretch.
STRETCH = 2000


def ladder(gap: np.ndarray, steps: tuple[tuple[int, float], ...], rest: float = 0.0) -> np.ndarray:
    """A step function of time distances; unknown ones are the rest."""
    return np.select([gap <= most for most, _ in steps], [value for _, value in steps], rest)


def _shared(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each left row's keys, repeats counted, that each right row has; and the number of keys of both."""
    left, right = b.column("l_keys")[i].values, b.column("keys")[i].values
    sizes, own = (x.value_lengths().to_numpy(zero_copy_only=False) for x in (left, right))
    out = np.zeros((len(sizes), len(own)))
    key, row = left.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    have = np.unique(np.stack([right.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(own)), own)], axis=1), axis=0)
    lo, hi = np.searchsorted(have[:, 0], key, "left"), np.searchsorted(have[:, 0], key, "right")
    n = hi - lo
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    np.add.at(out, (np.repeat(row, n), have[at, 1]), 1)
    return out, sizes[:, None].astype(float), own[None, :].astype(float)


def _overlap(shared: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.where((sizes > 0) & (own > 0), shared / np.maximum(1, np.maximum(sizes, own)), 0)


def _earlier(b: pa.RecordBatch, i: int, state: dict, k: int) -> tuple:
    best, _ = state.setdefault(b.column("l_number")[i].as_py(), (tiles.Best(len(tiles.values(b, i, "l_block_id")), k), tiles.values(b, i, "l_block_id")))
    seq = tiles.values(b, i, "block_seq")
    return best, seq < tiles.values(b, i, "l_block_seq")[:, None], seq


def _history(b: pa.RecordBatch, i: int, state: dict) -> None:
    """The rule of scoring.history_score, without boosts, on a pair of stretches."""
    best, ok, seq = _earlier(b, i, state, 1)
    get = lambda c: tiles.values(b, i, c)
    cos = tiles.product(tiles.matrix(b, i, "l_"), tiles.matrix(b, i)) * ((get("l_dim")[:, None] == get("dim")) & (get("dim") > 0))
    shared, sizes, own = _shared(b, i)
    new = np.where(sizes > 0, 1 - shared / np.maximum(1, sizes), 0)
    near = lambda c: ladder(np.abs(get(c)[:, None].astype(float) - get("end_ms")), S.HISTORY_STEPS)
    moves = (get("l_moved")[:, None] * 0.45 + new * 0.35 + near("l_start_ms") * 0.2) * np.where(get("end_ms") <= get("l_start_ms")[:, None], 1.0, 0.45)
    score = np.minimum(1, (cos * 0.63 + _overlap(shared, sizes, own) * 0.27 + near("l_end_ms") * 0.1) * (1 - np.clip(moves, 0, 1) * 0.22))
    score = np.round(score, 9)  # ties do not hang on the order of sums
    best.add(np.arange(len(score)), score, ok & (score > 0), seq)


def _nearest(k: int):
    def feed(b: pa.RecordBatch, i: int, state: dict) -> None:
        """The rule of scoring.neighbor_score on a pair of stretches."""
        best, ok, seq = _earlier(b, i, state, k)
        gap = np.abs(tiles.values(b, i, "l_end_ms")[:, None].astype(float) - tiles.values(b, i, "end_ms"))
        best.add(np.arange(len(gap)), _overlap(*_shared(b, i)) * 0.7 + ladder(gap, S.NEIGHBOR_STEPS, 0.08) * 0.3, ok, seq)

    return feed


def stretches(rows: DataFrame) -> DataFrame:
    """Rows packed by session and stretch, which are dealt to a fixed number of tasks, as a small table may be much work."""
    x = rows.filter("session_id is not null and block_seq is not null").withColumn("stretch", F.floor(F.col("block_seq") / STRETCH))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(n, "session_id", "stretch").sortWithinPartitions("session_id", "stretch", "block_seq")
    return tiles.packed(x, "v", STRETCH, by=("session_id", "stretch"))


def _winners(rows: DataFrame, feed) -> DataFrame:
    """block_id, session_id, o_block_seq, score: what feed keeps of each block against the earlier ones of its session.

    rows: v, session_id, block_seq, block_id, keys (hashes of keywords) and what feed reads, sorted by block_seq in a stretch.
    """
    right = durable(stretches(rows))
    pairs = [x.filter("stretch <= l_stretch") for x in tiles.paired(right, right, ("session_id",))]
    found = tiles.best_pairs(pairs, "block_id string, o_block_seq bigint, score double", feed, tiles.entries(["block_id", "o_block_seq", "score"]))
    return found.join(rows.select("block_id", "session_id"), "block_id")


def nearest(blocks: DataFrame, k: int) -> DataFrame:
    """block_id, other, score, rank: the k earlier blocks of the session that are nearest in keywords and time, ties by block_seq."""
    keys = F.transform(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), T.normalize), lambda x: F.xxhash64(x))
    rows = durable(blocks.select(F.array().cast("array<double>").alias("v"), "session_id", "block_seq", "block_id", "end_ms", keys.alias("keys")))
    w = Window.partitionBy("block_id").orderBy(F.desc("score"), "o_block_seq")
    x = _winners(rows, _nearest(k)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    old = rows.select("session_id", F.col("block_seq").alias("o_block_seq"), F.col("block_id").alias("other"))
    return x.join(old, ["session_id", "o_block_seq"]).select("block_id", "other", "score", F.col("rank").cast("long").alias("rank"))


def match(blocks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """block_id, match_score, best_id, relation_boost, affinity, novelty; zeros without an earlier block that scores.

    Of equal scores the earliest block wins.  edges (src, dst, type) add their type's weight, backward 0.6.
    """
    text = T.normalize(F.concat_ws(" ", "summary", event_text("raw_events")))
    # What a pair needs is worked out once a block: keywords normalised, vectors at unit length.
    cols = ["session_id", "block_seq", "block_id", "start_ms", "end_ms", "keywords", "embedding"]
    own = blocks.select("session_id", "block_seq", "block_id", "start_ms", "end_ms", F.transform("keywords", T.normalize).alias("keywords"), vectors.unit(F.col("embedding")).alias("embedding"), S.moved(text).alias("moved"))
    own = durable(own)
    v = F.coalesce("embedding", F.array().cast("array<double>"))
    keys = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: F.xxhash64(x))
    best = _winners(own.select(v.alias("v"), F.size(v).alias("dim"), "session_id", "block_seq", "block_id", "start_ms", "end_ms", "moved", keys.alias("keys")), _history)
    old = own.select(*[F.col(c).alias(f"o_{c}") for c in cols])
    # One a block and task; an edge can only add to its own pair.
    pairs = best.select("session_id", "block_id", "o_block_seq").join(old.select(F.col("o_session_id").alias("session_id"), "o_block_seq", "o_block_id"), ["session_id", "o_block_seq"]).select("block_id", "o_block_id")
    boost = F.lit(0.0)
    if edges is not None:
        w = S.type_weight(F.col("type"))
        both = edges.select("src", "dst", w.alias("w")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (w * 0.6).alias("w")))
        more = durable(both.groupBy(F.col("src").alias("o_block_id"), F.col("dst").alias("block_id")).agg(F.max("w").alias("boost")))
        pairs = pairs.unionByName(more.select("block_id", "o_block_id")).distinct().join(more, ["o_block_id", "block_id"], "left")
        boost = F.coalesce("boost", F.lit(0.0))
    pairs = pairs.join(own, "block_id").join(old, "o_block_id").filter((F.col("session_id") == F.col("o_session_id")) & (F.col("o_block_seq") < F.col("block_seq")))
    keys, cos = (F.col("keywords"), F.col("o_keywords")), F.when(F.size("embedding") == F.size("o_embedding"), vectors.dot("embedding", "o_embedding")).otherwise(0.0)
    x = pairs.select("block_id", "o_block_id", "o_block_seq", cos.alias("cos"), S.overlap(*keys, normal=True).alias("shared"), S.novelty(*keys, normal=True).alias("novelty"), S.recency_history(F.col("end_ms"), F.col("o_end_ms")).alias("recency"), "moved", "start_ms", "o_end_ms", boost.alias("boost"))
    x = x.withColumn("affinity", S.direction_affinity(F.col("moved"), F.col("novelty"), F.col("start_ms"), F.col("o_end_ms")))
    score = S.history_score(F.coalesce("cos", F.lit(0.0)), F.col("shared"), F.col("recency"), F.col("affinity"), F.col("boost"))
    x = x.select("block_id", "o_block_id", "o_block_seq", score.alias("score"), "affinity", "boost", "novelty").filter("score > 0")
    top = x.groupBy("block_id").agg(F.max(F.struct("score", (-F.col("o_block_seq")).alias("first"), "o_block_id", "boost", "affinity", "novelty")).alias("b"))
    out = blocks.select("block_id").join(top, "block_id", "left")
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0.0))
    return out.select("block_id", F.least(F.lit(1.0), zero("score")).alias("match_score"), F.col("b.o_block_id").alias("best_id"), zero("boost").alias("relation_boost"), zero("affinity").alias("affinity"), zero("novelty").alias("novelty"))


def retain(blocks: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Blocks with match_score, retention_mode, retention_reason and conflict."""
    x = blocks.join(matches, "block_id")
    text = F.lower(F.concat_ws(" ", "summary", event_text("raw_events")))
    x = x.withColumn("_r", S.retention(text, F.col("token_count"), F.col("match_score"), F.col("affinity"), F.col("novelty"), F.col("relation_boost"), cfg))
    x = x.withColumn("retention_mode", F.col("_r.mode")).withColumn("retention_reason", F.col("_r.reason"))
    return x.withColumn("conflict", F.col("retention_mode") == "conflict").drop("_r", "best_id", "relation_boost", "affinity", "novelty")
