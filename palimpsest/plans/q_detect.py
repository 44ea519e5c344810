"""Queries over the detectors, open blocks and chunk mates: logs of queries that are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import chunks, detect, retrieve
from palimpsest.sources.config import DEFAULT, load

from . import base
from . import sqltext as Q
from .registry import query

#: Forty vectors in a row are a session of queries, some seconds apart.
_LOG = """q AS (SELECT vec_id AS seq, vec_id // 40 AS s, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) AS n, 1704067200 + vec_id * 100 AS now, embedding::DOUBLE[] AS e, label,
  list_distinct(['k' || vec_id % 3, 'k' || vec_id % 4, 'l' || label]) AS keys, list_distinct(['b' || vec_id // 3 % 5, 'b' || vec_id // 4 % 3]) AS top,
  CASE WHEN vec_id % 7 < 5 THEN list_distinct(['b' || vec_id // 5 % 4, 'g' || vec_id // 6 % 3]) ELSE []::VARCHAR[] END AS graph,
  list_filter(list_transform(embedding[1:vec_id // 5 % 6], lambda x: abs(x::DOUBLE)), lambda x: x > 0) AS vals, CASE WHEN vec_id % 11 = 0 THEN 'timer' ELSE 'user' END AS source FROM embeddings)"""


def _log(spark, sf):
    v = F.col("vec_id")
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    part = lambda by, n: F.floor(v / by) % n
    vals = F.transform(F.slice("embedding", 1, (part(5, 6)).cast("int")), lambda x, i: F.struct(F.concat(F.lit("i"), i.cast("string")).alias("block_id"), F.abs(x.cast("double")).alias("confidence")))
    graph = F.array_distinct(F.array(name("b", part(5, 4)), name("g", part(6, 3))))
    cells = {
        "session_id": F.floor(v / 40), "seq": v, "now": F.lit(1_704_067_200) + v * 100, "first": F.lit(0).cast("long"), "last": F.lit(0).cast("long"), "source": F.when(v % 11 == 0, "timer").otherwise("user"), "n_tokens": F.lit(5),
        "keywords": F.array_distinct(F.array(name("k", v % 3), name("k", v % 4), name("l", F.col("label")))), "embedding": F.col("embedding").cast("array<double>"), "top_ids": F.array_distinct(F.array(name("b", part(3, 5)), name("b", part(4, 3)))),
        "graph_ids": F.when(v % 7 < 5, graph).otherwise(F.array().cast("array<string>")), "graph_confidence": (v % 9) / 10.0, "prediction_weight": (v % 5) / 100.0, "predicted": F.lit(True), "active": F.lit(False), "sparse": F.lit(False),
        "intents": vals, "top_embedding": F.lit(None).cast("array<double>"),
    }
    return base.table(spark, sf, "embeddings").select(*[c.alias(k) for k, c in cells.items()])


def _signal(df):
    return df.select("session_id", "seq", "level", "reason", "hint", "allow", "mode", F.col("n_intents").cast("long").alias("n_intents"))


_C = DEFAULT
_LOW = lambda kind: " + ".join(f"({x} <= {getattr(_C, f'topic_shift_{name}_{kind}_max')})::INTEGER" for x, name in (("sim", "query_similarity"), ("kov", "keyword_overlap"), ("rov", "retrieval_overlap")))


@query(f"""WITH RECURSIVE {_LOG},
p AS (SELECT *, list_transform(vals, lambda x: x / list_sum(vals)) AS prob FROM q),
h AS (SELECT *, len(vals) BETWEEN 1 AND {_C.relation_trigger_short_chain_max_size} AS short, CASE WHEN len(vals) <= 1 THEN 0 ELSE -list_sum(list_transform(prob, lambda x: x * ln(x + 1e-12))) / ln(len(vals)) END AS ent FROM p),
g AS (SELECT *, len(vals) > 0 AND (short OR (1 - ent < {_C.relation_trigger_low_info_threshold} AND ent > {_C.relation_trigger_high_entropy_threshold})) AS on_ FROM h),
f AS (SELECT s, 0::BIGINT AS n, NULL::BIGINT AS seq, 0 AS streak, -1e15::DOUBLE AS rel, -1e15::DOUBLE AS soft, -1e15::DOUBLE AS hard, NULL::BIGINT AS last, '' AS level, '' AS reason, '' AS hint FROM (SELECT DISTINCT s FROM q)
UNION ALL SELECT s, n, seq, streak, CASE WHEN rl = 'hard' THEN now ELSE rel END, CASE WHEN rl = 'none' AND sl IN ('hard', 'soft') THEN now ELSE soft END, CASE WHEN rl = 'none' AND sl = 'hard' THEN now ELSE hard END, CASE WHEN rl = 'none' AND source = 'user' THEN seq ELSE last END,
  CASE WHEN rl <> 'none' THEN rl ELSE sl END, CASE WHEN rl <> 'none' THEN CASE WHEN short THEN 'relation_short_chain_' ELSE 'relation_' END || rl || '_triggered' WHEN sl <> 'none' THEN 'topic_shift_' || sl ELSE 'inactive_prediction' END,
  CASE WHEN rl = 'hard' THEN 'search_required' WHEN rl = 'soft' OR sl <> 'none' THEN 'search_optional' ELSE 'none' END
FROM (SELECT *, CASE WHEN source <> 'user' OR was IS NULL THEN 'none' WHEN {_LOW("hard")} >= 2 THEN CASE WHEN now - hard < {_C.topic_shift_hard_cooldown_seconds} THEN 'none' ELSE 'hard' END
    WHEN {_LOW("soft")} >= 2 THEN CASE WHEN now - soft < {_C.topic_shift_soft_cooldown_seconds} THEN 'none' ELSE 'soft' END ELSE 'none' END AS sl FROM (
  SELECT *, CASE WHEN NOT on_ THEN 'none' WHEN streak < {_C.relation_trigger_streak_required} THEN 'soft' WHEN now - rel < {_C.relation_trigger_cooldown_seconds} THEN 'none' ELSE 'hard' END AS rl,
    greatest(0, least(1, list_cosine_similarity(e, was))) AS sim, len(list_intersect(keys, wkeys))::DOUBLE / len(list_distinct(list_concat(keys, wkeys))) AS kov, len(list_intersect(top, wtop))::DOUBLE / len(list_distinct(list_concat(top, wtop))) AS rov FROM (
    SELECT g.s, g.n, g.seq, g.now, g.source, g.short, g.on_, CASE WHEN g.on_ THEN f.streak + 1 ELSE 0 END AS streak, f.rel, f.soft, f.hard, f.last, g.e, g.keys, g.top, o.e AS was, o.keys AS wkeys, o.top AS wtop FROM f JOIN g ON g.s = f.s AND g.n = f.n + 1 LEFT JOIN q o ON o.seq = f.last))))
SELECT f.s AS session_id, f.seq, level, reason, hint, level <> 'none' AS allow, CASE WHEN level <> 'none' THEN 'inject' ELSE 'none' END AS mode, least(5, f.seq // 5 % 6)::BIGINT AS n_intents FROM f WHERE f.n > 0""")
def shift_and_relation_signals(spark, sf):
    """Relation-entropy and topic-shift detectors with their streaks, cooldowns and precedence; the prediction is never active."""
    return _signal(detect.detect(_log(spark, sf), load(env={}, low_entropy_trigger_enabled=False)))


_BOOST = _C.prediction_boost_weight * _C.prefetch_boost_ratio


@query(f"""WITH RECURSIVE {_LOG},
t AS (SELECT s, n, seq, now, now - seq * 37 % 2400 AS last, now - seq * 37 % 2400 - seq * 91 % 3000 AS first, seq % 3 <> 0 AS active, seq % 13 = 0 AS sparse, list_transform(vals, lambda x: x ** 6) AS conf,
  list_cosine_similarity(e, list_concat(e[1:40], list_transform(range(24), lambda i: 0::DOUBLE))) AS sim FROM q),
p AS (SELECT *, list_reverse_sort(list_transform(conf, lambda x: x / list_sum(conf))) AS prob FROM t),
h AS (SELECT *, CASE WHEN len(prob) <= 1 THEN 0 ELSE -list_sum(list_transform(prob, lambda x: x * ln(x + 1e-9))) / ln(len(prob)) END AS ent, coalesce(prob[1] - coalesce(prob[2], 0), 0) AS margin FROM p),
g AS (SELECT *, len(conf) > 0 AND ent <= 0.3 AND margin >= 0.2 AND sim >= 0.6 AS sure, len(conf) > 0 AND ent <= 0.5 AND margin >= 0.05 AND sim >= 0.35 AS likely FROM h),
f AS (SELECT s, 0::BIGINT AS n, NULL::BIGINT AS seq, -1e15::DOUBLE AS trigger, NULL::DOUBLE AS staged, 0::BIGINT AS at, '' AS mode, '' AS reason, '' AS hint, 0::BIGINT AS n_intents, 0::DOUBLE AS boost FROM (SELECT DISTINCT s FROM q)
UNION ALL SELECT s, n, seq, CASE WHEN reason IN ('inject_ready', 'prefetch_only') THEN now ELSE trigger END, CASE WHEN reason = 'prefetch_only' THEN conf[1] END, now, CASE WHEN reason IN ('inject_ready', 'keyword_sparse_priority') THEN 'inject' WHEN reason = 'prefetch_only' THEN 'prefetch' ELSE 'none' END, reason,
  CASE WHEN reason IN ('inject_ready', 'keyword_sparse_priority') THEN 'search_optional' ELSE 'none' END, CASE reason WHEN 'inject_ready' THEN least(len(conf), CASE WHEN last - first <= 1200 THEN 2 ELSE 1 END) WHEN 'prefetch_only' THEN 1 ELSE len(conf) END::BIGINT, boost FROM (
  SELECT *, CASE WHEN sparse THEN 'keyword_sparse_priority' WHEN NOT active THEN 'inactive_prediction' WHEN now - trigger < 120 THEN 'timing_blocked:cooldown' WHEN now - last > 1800 THEN 'timing_blocked:idle_too_long'
    WHEN NOT CASE WHEN now - last <= 300 THEN sure ELSE likely END THEN 'retrieve_gate_blocked' WHEN now - last <= 300 THEN 'inject_ready' ELSE 'prefetch_only' END AS reason FROM (
    SELECT g.*, f.trigger, coalesce(CASE WHEN g.now - f.at <= {_C.prefetch_ttl_seconds} THEN f.staged END, 0) * {_BOOST} AS boost FROM f JOIN g ON g.s = f.s AND g.n = f.n + 1)))
SELECT s AS session_id, seq, mode = 'inject' AS allow, mode, reason, hint, n_intents, round(boost, 9) AS prefetch_boost FROM f WHERE n > 0""")
def gate_signals(spark, sf):
    """The prediction gate alone: sparse queries, cooldown, timing, surety and nearness, depth, and what is staged for the next query."""
    v, half = F.col("seq"), F.concat(F.slice("embedding", 1, 40), F.array_repeat(F.lit(0.0), 24))
    last = F.col("now") - v * 37 % 2400
    peaked = F.transform("intents", lambda x: F.struct(x["block_id"].alias("block_id"), F.pow(x["confidence"], F.lit(6.0)).alias("confidence")))
    x = _log(spark, sf).withColumns({"last": last, "first": last - v * 91 % 3000, "active": v % 3 != 0, "sparse": v % 13 == 0, "top_embedding": half, "intents": peaked})
    got = detect.detect(x, load(env={}, relation_trigger_enabled=False, topic_shift_trigger_enabled=False, low_entropy_trigger_enabled=False))
    return got.select("session_id", "seq", "allow", "mode", "reason", "hint", F.col("n_intents").cast("long").alias("n_intents"), F.round("prefetch_boost", 9).alias("prefetch_boost"))


_SIZE = max(1, _C.low_entropy_window_size)
_NAMES = ("novelty", "overlap", "weight", "fresh", "cover", "sure")
_ON = (f"novelty < {_C.low_entropy_novelty_max}", f"overlap > {_C.low_entropy_retrieval_overlap_min}", f"weight < {_C.low_entropy_prediction_weight_max}", f"fresh < {_C.low_entropy_relation_new_rate_max}", f"cover < {_C.low_entropy_graph_coverage_max}", f"sure < {_C.low_entropy_relation_confidence_max}")


@query(f"""WITH RECURSIVE {_LOG},
w AS (SELECT *, flatten(list(top) OVER past) AS tops, flatten(list(graph) OVER past) AS graphs, (seq % 9) / 10.0::DOUBLE AS conf, (seq % 5) / 100.0::DOUBLE AS raw FROM q WINDOW past AS (PARTITION BY s ORDER BY n ROWS BETWEEN {_SIZE - 1} PRECEDING AND 1 PRECEDING)),
a AS (SELECT s, n, [raw] AS ws, raw AS weight FROM w WHERE n = 1 UNION ALL SELECT w.s, w.n, list_append(a.ws, x.v)[-{_SIZE}:], x.v FROM a JOIN w ON w.s = a.s AND w.n = a.n + 1, LATERAL (SELECT list_sum(list_append(a.ws[-{_SIZE - 1}:], w.raw)) / len(list_append(a.ws[-{_SIZE - 1}:], w.raw)) AS v) x),
v AS (SELECT w.s, w.n, w.seq, w.now, weight, len(list_intersect(top, tops))::DOUBLE / len(list_distinct(list_concat(top, coalesce(tops, [])))) AS overlap, CASE WHEN len(graph) = 0 THEN 1 ELSE len(list_filter(graph, lambda x: NOT list_contains(coalesce(graphs, []), x)))::DOUBLE / len(graph) END AS fresh,
  CASE WHEN len(graph) = 0 THEN 1 ELSE len(list_intersect(top, graph))::DOUBLE / len(top) END AS cover, CASE WHEN len(graph) = 0 THEN 1 ELSE conf END AS sure FROM w JOIN a ON a.s = w.s AND a.n = w.n),
n AS (SELECT *, 1 - coalesce(overlap, 0) AS novelty FROM (SELECT * REPLACE (coalesce(overlap, 0) AS overlap) FROM v)),
m AS (SELECT *, {", ".join(f"CASE WHEN count(*) OVER last < 2 THEN 1 ELSE 1 / (var_pop({x}) OVER last + 0.01) END AS r_{x}" for x in _NAMES)} FROM n WINDOW last AS (PARTITION BY s ORDER BY n ROWS BETWEEN {_SIZE - 1} PRECEDING AND CURRENT ROW)),
b AS (SELECT *, least({", ".join("r_" + x for x in _NAMES)}) AS low, greatest({", ".join("r_" + x for x in _NAMES)}) AS high FROM m),
y AS (SELECT *, {", ".join(f"CASE WHEN low = high THEN 1 ELSE 0.5 + (r_{x} - low) / (high - low) * 1.5 END AS w_{x}" for x in _NAMES)} FROM b),
d AS (SELECT s, n, seq, now, {" + ".join(f"CASE WHEN {on} THEN w_{x} ELSE 0 END" for x, on in zip(_NAMES, _ON, strict=True))} >= {max(1, _C.low_entropy_min_signals)} / 6.0::DOUBLE * ({" + ".join("w_" + x for x in _NAMES)}) AS met FROM y),
f AS (SELECT s, 0::BIGINT AS n, NULL::BIGINT AS seq, 0 AS streak, -1e15::DOUBLE AS soft, -1e15::DOUBLE AS hard, '' AS level FROM (SELECT DISTINCT s FROM q)
UNION ALL SELECT s, n, seq, streak, CASE WHEN l IN ('hard', 'soft') THEN now ELSE soft END, CASE WHEN l = 'hard' THEN now ELSE hard END, l FROM (
  SELECT *, CASE WHEN streak >= {_C.low_entropy_hard_streak_k} THEN CASE WHEN now - hard < {_C.low_entropy_hard_cooldown_seconds} THEN 'none' ELSE 'hard' END WHEN streak >= {_C.low_entropy_soft_streak_k} THEN CASE WHEN now - soft < {_C.low_entropy_soft_cooldown_seconds} THEN 'none' ELSE 'soft' END ELSE 'none' END AS l FROM (
    SELECT d.s, d.n, d.seq, d.now, CASE WHEN d.met THEN f.streak + 1 ELSE 0 END AS streak, f.soft, f.hard FROM f JOIN d ON d.s = f.s AND d.n = f.n + 1)))
SELECT s AS session_id, seq, level, CASE WHEN level = 'none' THEN 'inactive_prediction' ELSE 'low_entropy_' || level END AS reason, CASE level WHEN 'hard' THEN 'search_required' WHEN 'soft' THEN 'search_optional' ELSE 'none' END AS hint, level <> 'none' AS allow, CASE WHEN level <> 'none' THEN 'inject' ELSE 'none' END AS mode, least(5, seq // 5 % 6)::BIGINT AS n_intents FROM f WHERE n > 0""")
def low_entropy_signals(spark, sf):
    """The low-entropy detector alone: six signals weighed by how steady they are, streaks and cooldowns."""
    cfg = load(env={}, relation_trigger_enabled=False, topic_shift_trigger_enabled=False)
    return _signal(detect.detect(_log(spark, sf), cfg))


@query(f"""WITH {Q.EVENTS}, o AS (SELECT session_id, arg_max(text, seq) AS text FROM ev GROUP BY session_id), u AS (SELECT session_id, arg_min(text, seq) AS text FROM ev WHERE role = 'user' GROUP BY session_id),
{Q.keywords("ok", "o", "session_id", "text", 8)}, {Q.keywords("uk", "u", "session_id", "text", 8)}, {Q.vectors("ov", "o", "session_id", "text")}, {Q.vectors("uv", "u", "session_id", "text")},
c AS (SELECT session_id, sum(ov.value * uv.value) AS cos FROM ov JOIN uv USING (session_id, bin) GROUP BY session_id),
z AS (SELECT session_id, coalesce(CASE WHEN len(list_distinct(list_concat(a.keywords, b.keywords))) = 0 THEN 0 ELSE len(list_intersect(a.keywords, b.keywords))::DOUBLE / len(list_distinct(list_concat(a.keywords, b.keywords))) END, 0) * 0.5 + coalesce(cos, 0) * 0.5 AS score FROM uk a JOIN ok b USING (session_id) LEFT JOIN c USING (session_id))
SELECT session_id, round(score, 6) AS score FROM z WHERE score > 0""")
def open_block_scores(spark, sf):
    """Each conversation's last turn is a block that is still open; its first user turn asks."""
    e = base.events(spark, sf)
    opened = e.groupBy("session_id").agg(F.max_by("text", "seq").alias("text")).withColumn("block_id", base.name("session_id", F.lit(0)))
    asked = e.filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "seq").alias("query")).withColumn("query_id", F.col("session_id"))
    return retrieve.open_block_scores(retrieve.analyzed(asked), opened).select(F.col("query_id").alias("session_id"), F.round("score", 6).alias("score"))


#: Chunks of four vectors, sessions of forty; each twentieth vector asks and finds itself, the next and the one after six.
_REFS = "r AS (SELECT vec_id AS query_id, vec_id + d AS b, CASE d WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.5 END::DOUBLE AS score, d // 3 + d % 3 + 1 AS rank FROM embeddings, (SELECT unnest([0, 1, 6]) AS d) WHERE vec_id % 20 = 0 AND vec_id + d < (SELECT count(*) FROM embeddings))"


@query(f"""WITH {_REFS}, x AS (SELECT r.query_id, b AS seed, rank, score, d, b + d AS b FROM r, (SELECT unnest([-1, 1]) AS d) WHERE score >= {_C.chunk_neighbor_score_gate}),
m AS (SELECT x.query_id, x.b, min(struct_pack(rank := rank, ord := 2 + (d > 0)::INTEGER, seed := score)) AS k FROM x WHERE b // 4 = seed // 4 AND b >= 0 AND b < (SELECT count(*) FROM embeddings) AND NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = x.query_id AND r.b = x.b) GROUP BY ALL),
z AS (SELECT query_id, b, greatest(0, k.seed - 0.0001) AS score, row_number() OVER (PARTITION BY query_id ORDER BY k.rank, k.ord) AS p FROM m)
SELECT query_id, b AS vec_id, round(score, 6) AS score, rank::BIGINT AS rank FROM r UNION ALL SELECT query_id, b, round(score, 6), (SELECT max(rank) FROM r WHERE r.query_id = z.query_id) + p FROM z WHERE p <= {_C.chunk_max_expanded_blocks}""")
def chunk_mates(spark, sf):
    """Hits and the chunk mates of the good ones behind them."""
    e = base.table(spark, sf, "embeddings").select("vec_id")
    name = lambda c: F.lpad(c.cast("string"), 10, "0")
    place = Window.partitionBy(F.floor(F.col("vec_id") / 4)).orderBy("vec_id")
    placed = e.select(F.floor(F.col("vec_id") / 40).alias("session_id"), F.floor(F.col("vec_id") / 4).alias("chunk_seq"), name(F.col("vec_id")).alias("block_id"), (F.row_number().over(place) - 1).alias("pos"))
    found = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("score"), F.lit(r).cast("long").alias("rank")) for d, s, r in ((0, 0.95, 1), (1, 0.85, 2), (6, 0.5, 3))]))
    refs = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), found.alias("h")).filter(F.col("query_id") + F.col("h.d") < e.count())
    refs = refs.select("query_id", name(F.col("query_id") + F.col("h.d")).alias("block_id"), "h.score", "h.rank")
    got = chunks.expanded(refs, refs, placed)
    return got.select("query_id", F.col("block_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")
