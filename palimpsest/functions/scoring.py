"""Scores, ladders and decisions as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import words

MINUTE, HOUR = 60_000, 3_600_000
HISTORY_STEPS = ((HOUR, 1.0), (6 * HOUR, 0.6), (24 * HOUR, 0.3))
NEIGHBOR_STEPS = ((HOUR, 1.0), (6 * HOUR, 0.75), (24 * HOUR, 0.45), (72 * HOUR, 0.2))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null and NaN count as low."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.nanvl(F.coalesce(x.cast("double"), F.lit(low)), F.lit(low))))


def ladder(gap: Column, steps: Sequence[tuple[int, float]], rest: float) -> Column:
    out = F.when(gap <= steps[0][0], steps[0][1])
    for most, value in steps[1:]:
        out = out.when(gap <= most, value)
    return out.otherwise(rest)


def recency_history(a: Column, b: Column) -> Column:
    return ladder(F.abs(a - b), HISTORY_STEPS, 0.0)


def recency_relation(start: Column, earlier_end: Column) -> Column:
    gap = F.greatest(F.lit(0).cast("long"), start - earlier_end)
    return ladder(gap, [(5 * MINUTE, 1.0), (30 * MINUTE, 0.8), (2 * HOUR, 0.55), (24 * HOUR, 0.3)], 0.1)


def recency_neighbor(a: Column, b: Column) -> Column:
    return ladder(F.abs(a - b), NEIGHBOR_STEPS, 0.08)


def _shared(a: Column, b: Column, normal: bool = False) -> Column:
    """Entries of a, repeats counted, that b has, both normalised (normal: they are already)."""
    a, b = (a, b) if normal else (F.transform(a, T.normalize), F.transform(b, T.normalize))
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def overlap(a: Column, b: Column, normal: bool = False) -> Column:
    """Shared over the larger size; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_shared(a, b, normal) / F.greatest(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets; 0 for two empty ones."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def continuous(a: Column, b: Column, least: float = 0.34) -> Column:
    """Whether the smaller of two lower-cased sets is shared to that part; false if either is empty."""
    x, y = (F.array_distinct(F.transform(v, F.lower)) for v in (a, b))
    small = F.least(F.size(x), F.size(y))
    return F.coalesce((small > 0) & (F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), small) >= least), F.lit(False))


def novelty(current: Column, candidate: Column, normal: bool = False) -> Column:
    """Part of the current keywords, repeats counted, that the candidate lacks; 0 without keywords."""
    return F.when(F.size(current) == 0, 0.0).otherwise(1 - _shared(current, candidate, normal) / F.greatest(F.lit(1), F.size(current)))


def moved(text: Column) -> Column:
    """Whether a normalised text says that something goes on to something else: 1 or 0."""
    return F.when(T.contains_any(text, words.TRANSITION), 1.0).otherwise(0.0)


def direction_affinity(moves: Column, new: Column, start: Column, earlier_end: Column) -> Column:
    """moves: moved() of the current block; new: its novelty against the earlier one."""
    x = moves * 0.45 + new * 0.35 + recency_history(start, earlier_end) * 0.2
    return clamp(x * F.when(earlier_end <= start, 1.0).otherwise(0.45))


def by_type(kind: Column, table: dict[str, float], rest: float) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise(rest)


def type_weight(kind: Column) -> Column:
    return by_type(kind, words.TYPE_WEIGHT, words.OTHER_WEIGHT)


def edge_confidence(kind: Column, stored: Column) -> Column:
    """Stored confidence within 0.05 and 1 (NaN: 0.5), else the type's own."""
    kept = F.when(F.isnan(stored), 0.5).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), stored)))
    return F.when(stored.isNotNull(), kept).otherwise(by_type(kind, words.DEFAULT_CONFIDENCE, words.OTHER_CONFIDENCE))


def history_score(cos: Column, shared: Column, recency: Column, affinity: Column, boost: Column) -> Column:
    return F.least(F.lit(1.0), (cos * 0.63 + shared * 0.27 + recency * 0.1) * (1 - affinity * 0.22) + boost)


def neighbor_score(shared: Column, recency: Column) -> Column:
    return shared * 0.7 + recency * 0.3


def retention(text: Column, token_count: Column, match: Column, affinity: Column, new: Column, boost: Column, cfg) -> Column:
    """struct(mode, reason) of a block; text is its lower-cased summary and events."""
    upper = max(cfg.compression_high_match_threshold, cfg.compression_low_match_threshold + 0.01)
    lower = min(cfg.compression_low_match_threshold, upper - 0.01)
    band, weight = min(max(cfg.compression_soft_band, 0.0), 0.25), min(max(cfg.compression_preserve_weight, 0.0), 1.5)
    affinity, new, relation = clamp(affinity), clamp(new), clamp(boost / 0.1)
    keep = clamp(affinity * 0.5 + new * 0.35 + relation * 0.15)
    progress = ((affinity >= 0.62) & (new >= 0.22)) | ((affinity >= 0.5) & (new >= 0.3) & (relation >= 0.35)) | (keep >= 0.68)
    compress = clamp((match - (lower - band)) / (upper + band - (lower - band))) * (1 - keep * weight)
    as_ = lambda mode, reason: F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))
    conflict = T.contains_any(text, words.CONFLICT) if cfg.conflict_marker_enabled else F.lit(False)
    return (
        F.when(conflict, as_("conflict", "conflict_signal_detected"))
        .when((token_count <= max(0, int(cfg.compression_min_raw_tokens))) & (match < upper), as_("raw", "small_block_preserve"))
        .when((match >= upper + band) & progress, as_("raw", "high_match_directional_progress"))
        .when(match >= upper + band, as_("compressed", "high_match_redundant"))
        .when(match <= lower - band, as_("raw", "low_match_unique"))
        .when(compress >= 0.58, as_("compressed", "adaptive_soft_compress"))
        .otherwise(as_("raw", "adaptive_soft_keep"))
    )


def prediction_boost(confidence: Column, sparse: Column, cfg) -> Column:
    """min(confidence * weight * multiplier * 14, cap), 0 at least; the multiplier is 8 for sparse queries."""
    factor = F.when(sparse, 8.0).otherwise(cfg.prediction_dense_boost_multiplier)
    return F.least(F.greatest(confidence * cfg.prediction_boost_weight * factor * 14, F.lit(0.0)), F.lit(cfg.prediction_boost_cap))


def boost_allowed(confidence: Column, base: Column, sparse: Column, cfg) -> Column:
    low = base <= cfg.prediction_base_score_gate_max
    return F.when(sparse, low).otherwise((confidence >= cfg.prediction_dense_confidence_gate_min) | low)


def keyword_sparse(query: Column, keys: Column) -> Column:
    own = T.tokens(query)
    n = F.size(F.filter(keys, lambda k: F.array_contains(own, F.lower(k))))
    return F.when(F.size(keys) == 0, True).otherwise(n / F.size(keys) < 0.5)


def informative(query: Column, keys: Column, cfg) -> Column:
    return (F.size(T.tokens(query)) >= max(1, cfg.topic_shift_min_tokens)) & (F.size(F.array_distinct(F.transform(keys, F.lower))) >= max(1, cfg.topic_shift_min_keywords))


def probabilities(values: Column) -> Column:
    """The positive finite ones, highest first, over their sum; empty if there is none."""
    own = F.sort_array(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))), asc=False)
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    return F.transform(own, lambda x: x / total)


def entropy(p: Column, eps: float) -> Column:
    """Of probabilities, over the logarithm of their number; 0 for one or none."""
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(x + eps))
    return F.when(F.size(p) <= 1, 0.0).otherwise(s / F.log(F.size(p).cast("double")))


def timing(now: Column, last: Column, first: Column, trigger: Column) -> Column:
    """struct(allow, mode, depth, reason) in UTC seconds; a null trigger lies long back, other nulls are invalid."""
    made = lambda allow, mode, depth, reason: F.struct(F.lit(allow).alias("allow"), F.lit(mode).alias("mode"), depth.alias("depth"), F.lit(reason).alias("reason"))
    idle, none = now - last, F.lit(0)
    depth = F.when(last - first <= 1200, 2).otherwise(1)
    return (
        F.when(now.isNull() | last.isNull() | first.isNull(), made(False, "none", none, "invalid_input"))
        .when(F.coalesce(now - trigger < 120, F.lit(False)), made(False, "none", none, "cooldown"))
        .when(idle <= 300, made(True, "inject", depth, "inject"))
        .when(idle <= 1800, made(True, "prefetch", F.lit(1), "prefetch"))
        .otherwise(made(False, "none", none, "idle_too_long"))
    )


def retrieve_gate(values: Column, similarity: Column, prefetch: Column) -> Column:
    """Whether predictions are sure and near enough; prefetching has looser thresholds."""
    p = probabilities(values)
    h = entropy(p, 1e-9)
    margin = F.element_at(p, 1) - F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(0.0))
    pick = lambda inject, fetch: F.when(prefetch, fetch).otherwise(inject)
    ok = (h <= pick(0.6, 0.75)) & (h <= pick(0.3, 0.5)) & (margin >= pick(0.2, 0.05)) & (similarity >= pick(0.6, 0.35))
    return F.when(F.size(p) == 0, False).otherwise(F.coalesce(ok, F.lit(False)))


def relation_trigger(values: Column, cfg) -> Column:
    """struct(matched, short, info, entropy, size)."""
    p = probabilities(values)
    h = entropy(p, 1e-12)
    n = F.size(p)
    short = (n > 0) & (n <= max(1, int(cfg.relation_trigger_short_chain_max_size)))
    flat = (n > 0) & (1 - h < cfg.relation_trigger_low_info_threshold) & (h > cfg.relation_trigger_high_entropy_threshold)
    zero = lambda x: F.when(n > 0, x).otherwise(0.0)
    return F.struct((short | flat).alias("matched"), short.alias("short"), zero(1 - h).alias("info"), zero(h).alias("entropy"), n.alias("size"))


def topic_shift(similarity: Column, keywords: Column, retrieval: Column, cfg) -> Column:
    """hard or soft if two of three signals are low enough, else none."""
    n = lambda *pairs: sum(((x <= most).cast("int") for x, most in pairs), F.lit(0))
    hard = n((similarity, cfg.topic_shift_query_similarity_hard_max), (keywords, cfg.topic_shift_keyword_overlap_hard_max), (retrieval, cfg.topic_shift_retrieval_overlap_hard_max))
    soft = n((similarity, cfg.topic_shift_query_similarity_soft_max), (keywords, cfg.topic_shift_keyword_overlap_soft_max), (retrieval, cfg.topic_shift_retrieval_overlap_soft_max))
    return F.when(hard >= 2, "hard").when(soft >= 2, "soft").otherwise("none")


def prescreen_size(total: Column, cfg) -> Column:
    return F.least(total, F.least(F.lit(cfg.hybrid_prescreen_max), F.greatest(F.lit(cfg.hybrid_prescreen_min), F.floor(total * cfg.hybrid_prescreen_ratio))))


def rerank_size(n: Column, top_k: int, cfg) -> Column:
    import math

    return F.least(n, F.lit(max(1, math.ceil(top_k * cfg.hybrid_rerank_multiplier))), F.lit(cfg.hybrid_rerank_hard_cap))
