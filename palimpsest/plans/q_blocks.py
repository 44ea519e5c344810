"""Queries over sealing, windows, history, relations and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import words
from palimpsest.operators import chunks, diagnostics, history, relations, seal
from palimpsest.sources import tables
from palimpsest.sources.config import DEFAULT, load
from palimpsest.storage import durable

from . import base
from . import sqltext as Q
from .registry import query

#: Small enough that the short conversations have several blocks.
SMALL = load(env={}, max_tokens_per_block=120, min_tokens_per_block=40)

_NAME = "'block_' || lpad(session_id::VARCHAR, 10, '0') || '_' || lpad({}::VARCHAR, 6, '0')"
_ORDERED = f"{Q.EVENTS}, o AS (SELECT *, {Q.estimate('text')} AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ev)"


def _fold(cfg, strategy_sql: str) -> str:
    return f"""WITH RECURSIVE {_ORDERED}, m AS (SELECT *, max(ts_ms - n) OVER (PARTITION BY session_id ORDER BY seq) + n AS t FROM o),
f AS (SELECT session_id, seq, n, role, text, t, tokens, 0::BIGINT AS block_seq, tokens::BIGINT AS held FROM m WHERE n = 1
UNION ALL SELECT m.session_id, m.seq, m.n, m.role, m.text, m.t, m.tokens, CASE WHEN {strategy_sql} THEN f.block_seq + 1 ELSE f.block_seq END, CASE WHEN {strategy_sql} THEN m.tokens ELSE f.held + m.tokens END
FROM f JOIN m ON m.session_id = f.session_id AND m.n = f.n + 1)"""


_PREFIXES = " OR ".join(f"starts_with(lower(ltrim(m.text, e' \\t\\n\\r')), '{p}')" for p in words.TOPIC_PREFIXES)


def _meaning(cfg) -> str:
    most, least = cfg.max_tokens_per_block, cfg.min_tokens_per_block
    return f"""(f.held > 0 AND (f.held + m.tokens > {most * 1.35} OR (f.held + m.tokens >= {most} AND f.held >= {least} AND (m.role <> f.role
OR regexp_matches(rtrim(f.text, e' \\t\\n\\r'), '[。！？.!?]["''」』]?$') OR contains(rtrim(f.text, e' \\t\\n\\r'), e'\\n\\n') OR contains(ltrim(m.text, e' \\t\\n\\r'), e'\\n\\n') OR {_PREFIXES}))))"""


def _hard(cfg) -> str:
    return f"f.held >= {int(cfg.max_tokens_per_block * 1.5)}"


def sealed_events(cfg) -> str:
    """session_id, seq, block_seq, held and the event: the hybrid rule as SQL, in a CTE f."""
    idle = f"(m.t - f.t) / 1000.0 >= {cfg.proactive_seal_idle_seconds}"
    turn = f"(m.role <> f.role AND f.held >= {max(cfg.proactive_seal_min_tokens, cfg.min_tokens_per_block)})"
    fixed = f"(f.held > 0 AND f.held + m.tokens > {cfg.max_tokens_per_block})"
    return _fold(cfg, f"({_hard(cfg)} OR {idle} OR {turn} OR {fixed} OR {_meaning(cfg)})")


@query(f"{sealed_events(SMALL)} SELECT session_id, seq, block_seq, tokens FROM f")
def seal_events(spark, sf):
    return seal.assign_blocks(base.events(spark, sf), SMALL).select("session_id", "seq", "block_seq", "tokens")


@query(f"{_fold(SMALL, f'({_hard(SMALL)} OR {_meaning(SMALL)})')} SELECT session_id, block_seq, min(t) AS start_ms, max(t) AS end_ms, sum(tokens)::BIGINT AS token_count, count(*) AS n_events FROM f GROUP BY ALL")
def seal_semantic_blocks(spark, sf):
    cfg = load(env={}, max_tokens_per_block=120, min_tokens_per_block=40, chunk_strategy="semantic", proactive_seal_enabled=False)
    b = seal.to_blocks(seal.assign_blocks(base.events(spark, sf), cfg))
    return b.select("session_id", "block_seq", "start_ms", "end_ms", "token_count", F.size("raw_events").cast("long").alias("n_events"))


@query(f"WITH {Q.EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, 1704067200000 + session_id * 86400000 + ((seq * 7) % 4) * 1000 AS late FROM ev) SELECT session_id, seq, max(late - n) OVER (PARTITION BY session_id ORDER BY seq) + n AS ts_ms FROM o")
def monotone_time(spark, sf):
    """Times out of order are moved behind their predecessor."""
    e = base.events(spark, sf).withColumn("ts_ms", F.lit(1_704_067_200_000) + F.col("session_id") * 86_400_000 + ((F.col("seq") * 7) % 4) * 1000)
    return seal.with_monotone_time(e).select("session_id", "seq", "ts_ms")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000 >= 3600000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 AS end_ms, count(*) AS n FROM s GROUP BY user_id, s""")
def idle_sessions(spark, sf):
    x = seal.idle_sessions(base.table(spark, sf, "events"), "user_id", "ts", 3600)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return x.select("user_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "n")


@query(f"WITH {Q.EVENTS} SELECT {_NAME.format('p')} AS src, {_NAME.format('seq')} AS dst, ts_ms, 1.0::DOUBLE AS confidence FROM (SELECT *, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM ev) WHERE p IS NOT NULL")
def follows_edges(spark, sf):
    return seal.follows(base.simple_blocks(spark, sf, embed=False)).select("src", "dst", "ts_ms", "confidence")


@query(f"""WITH {Q.EVENTS} SELECT session_id, seq, lag(role) OVER w AS previous_role, lag(ts_ms) OVER w AS previous_ms, first_value(ts_ms) OVER w AS first_ms,
(SELECT 1) * (CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 2 THEN 1 ELSE 0 END)::BIGINT AS recent FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq)""")
def event_timeline(spark, sf):
    w = Window.partitionBy("session_id").orderBy("seq")
    recent = (F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq"))) <= 2).cast("long")
    return base.events(spark, sf).select("session_id", "seq", F.lag("role").over(w).alias("previous_role"), F.lag("ts_ms").over(w).alias("previous_ms"), F.first_value("ts_ms").over(w).alias("first_ms"), recent.alias("recent"))


@query("""WITH h AS (SELECT user_id, event_id, ts, value > 50 AS hit FROM events), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM h)
SELECT event_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id)::BIGINT AS streak FROM g""")
def streaks(spark, sf):
    return diagnostics.streaks(base.table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 50).select("event_id", "streak")


_KW = f"{Q.EVENTS}, {Q.keywords('k', 'ev', 'session_id, seq', 'text', 8)}"
_BLK = f"{_KW}, {Q.vectors('v', 'ev', 'session_id, seq', 'text')}, b AS (SELECT ev.*, k.keywords, {Q.norm(chr(39) + ' ' + chr(39) + ' || text')} AS nt FROM ev JOIN k USING (session_id, seq))"
_OVER = "CASE WHEN len(a.keywords) = 0 OR len(o.keywords) = 0 THEN 0 ELSE len(list_filter(a.keywords, lambda x: list_contains(o.keywords, x)))::DOUBLE / greatest(len(a.keywords), len(o.keywords)) END"
_NEW = "CASE WHEN len(a.keywords) = 0 THEN 0 ELSE 1 - len(list_filter(a.keywords, lambda x: list_contains(o.keywords, x)))::DOUBLE / len(a.keywords) END"


def _rec(gap: str) -> str:
    return f"(CASE WHEN {gap} <= 3600000 THEN 1.0 WHEN {gap} <= 21600000 THEN 0.6 WHEN {gap} <= 86400000 THEN 0.3 ELSE 0.0 END)"


_HIST = f"""{_BLK}, dots AS (SELECT a.session_id, a.seq, o.seq AS oseq, sum(a.value * o.value) AS cos FROM v a JOIN v o ON a.session_id = o.session_id AND o.seq < a.seq AND a.bin = o.bin GROUP BY ALL),
p AS (SELECT a.session_id, a.seq, o.seq AS oseq, coalesce(d.cos, 0) AS cos, {_OVER} AS ov, {_NEW} AS nov, {_rec('abs(a.ts_ms - o.ts_ms)')} AS rec,
least(1, greatest(0, ((CASE WHEN {Q.has('a.nt', words.TRANSITION)} THEN 1 ELSE 0 END) * 0.45 + ({_NEW}) * 0.35 + {_rec('abs(a.ts_ms - o.ts_ms)')} * 0.2) * (CASE WHEN o.ts_ms <= a.ts_ms THEN 1 ELSE 0.45 END))) AS aff
FROM b a JOIN b o ON a.session_id = o.session_id AND o.seq < a.seq LEFT JOIN dots d ON d.session_id = a.session_id AND d.seq = a.seq AND d.oseq = o.seq),
s AS (SELECT *, round(least(1, (cos * 0.63 + ov * 0.27 + rec * 0.1) * (1 - aff * 0.22)), 9) AS score FROM p),
best AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY score DESC, oseq) AS r FROM s WHERE score > 0)"""


def _history_blocks(spark, sf):
    x = durable(base.simple_blocks(spark, sf))
    events = F.array(F.struct(F.lit("e").alias("event_id"), F.lit("user").alias("role"), F.col("text"), F.col("start_ms").alias("ts_ms")))
    return x.withColumn("summary", F.lit("")).withColumn("raw_events", events)


@query(f"""WITH {_HIST} SELECT ev.session_id, ev.seq, round(coalesce(score, 0), 6) AS match_score, round(coalesce(aff, 0), 6) AS affinity, round(coalesce(nov, 0), 6) AS novelty
FROM ev LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (session_id, seq)""")
def history_match(spark, sf):
    """Every block against all earlier ones of its session."""
    b = _history_blocks(spark, sf)
    m = history.match(b)
    x = b.select("session_id", F.col("block_seq").alias("seq"), "block_id").join(m, "block_id")
    return x.select("session_id", "seq", *[F.round(c, 6).alias(c) for c in ("match_score", "affinity", "novelty")])


_RET = f"""WITH {_HIST}, m AS (SELECT ev.session_id, ev.seq, {Q.estimate('text')} AS tok, lower(' ' || text) AS t, coalesce(score, 0) AS score, coalesce(aff, 0) AS aff, coalesce(nov, 0) AS nov FROM ev LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (session_id, seq)),
q AS (SELECT *, least(1, greatest(0, aff * 0.5 + nov * 0.35)) AS keep FROM m)
SELECT session_id, seq, CASE WHEN {Q.has('t', words.CONFLICT)} THEN 'conflict_signal_detected' WHEN tok <= 56 AND score < 0.82 THEN 'small_block_preserve'
WHEN score >= 0.9 AND ((aff >= 0.62 AND nov >= 0.22) OR keep >= 0.68) THEN 'high_match_directional_progress' WHEN score >= 0.9 THEN 'high_match_redundant' WHEN score <= 0.27 THEN 'low_match_unique'
WHEN least(1, greatest(0, (score - 0.27) / 0.63)) * (1 - keep * 0.7) >= 0.58 THEN 'adaptive_soft_compress' ELSE 'adaptive_soft_keep' END AS reason FROM q"""


def _retained(spark, sf):
    b = _history_blocks(spark, sf)
    return history.retain(b, history.match(b))


@query(_RET)
def retention(spark, sf):
    return _retained(spark, sf).select("session_id", F.col("block_seq").alias("seq"), F.col("retention_reason").alias("reason"))


@query(f"SELECT mode, count(*) AS n FROM (SELECT CASE WHEN reason = 'conflict_signal_detected' THEN 'conflict' WHEN reason IN ('high_match_redundant', 'adaptive_soft_compress') THEN 'compressed' ELSE 'raw' END AS mode FROM ({_RET})) GROUP BY mode")
def retention_histogram(spark, sf):
    return diagnostics.histogram(_retained(spark, sf), "retention_mode").withColumnRenamed("retention_mode", "mode")


@query(f"""WITH {_KW}, b AS (SELECT ev.*, k.keywords FROM ev JOIN k USING (session_id, seq)),
p AS (SELECT a.session_id, a.seq, o.seq AS other, round(0.7 * ({_OVER}) + 0.3 * (CASE WHEN abs(a.ts_ms - o.ts_ms) <= 3600000 THEN 1.0 WHEN abs(a.ts_ms - o.ts_ms) <= 21600000 THEN 0.75 WHEN abs(a.ts_ms - o.ts_ms) <= 86400000 THEN 0.45 WHEN abs(a.ts_ms - o.ts_ms) <= 259200000 THEN 0.2 ELSE 0.08 END), 9) AS score FROM b a JOIN b o ON a.session_id = o.session_id AND o.seq < a.seq)
SELECT session_id, seq, other, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY score DESC, other) AS rank FROM p) WHERE rank <= 3""")
def nearest_blocks(spark, sf):
    b = base.simple_blocks(spark, sf, embed=False)
    ids = b.select("block_id", "session_id", "block_seq")
    x = relations.neighbors(b, 3).join(ids, "block_id").join(ids.select(F.col("block_id").alias("other"), F.col("block_seq").alias("o")), "other")
    return x.select("session_id", F.col("block_seq").alias("seq"), F.col("o").alias("other"), F.round("score", 6).alias("score"), "rank")


_EXTRACT = f"""WITH {Q.EVENTS}, t AS (SELECT *, {Q.norm("' ' || text")} AS nt FROM ev), {Q.keywords('w', 't', 'session_id, seq', 'nt', 12)}, {Q.keywords('k', 'ev', 'session_id, seq', 'text', 8)},
b AS (SELECT t.*, w.keywords AS kw, k.keywords FROM t JOIN w USING (session_id, seq) JOIN k USING (session_id, seq)),
p AS (SELECT a.session_id, a.seq, o.seq AS other, a.ts_ms, o.ts_ms AS o_ms, a.nt, o.nt AS o_nt, a.kw, o.kw AS o_kw, round(0.7 * ({_OVER}) + 0.3 * (CASE WHEN abs(a.ts_ms - o.ts_ms) <= 3600000 THEN 1.0 ELSE 0.75 END), 9) AS ns FROM b a JOIN b o ON a.session_id = o.session_id AND o.seq < a.seq),
n AS (SELECT *, count(*) OVER (PARTITION BY session_id, seq) AS cnt, row_number() OVER (PARTITION BY session_id, seq ORDER BY other DESC) AS last FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY ns DESC, other) AS rank FROM p) WHERE rank <= 6),
q AS (SELECT *, len(list_intersect(kw, o_kw))::DOUBLE / greatest(len(kw), len(o_kw), 1) AS l, CASE WHEN greatest(0, ts_ms - o_ms) <= 300000 THEN 1.0 WHEN greatest(0, ts_ms - o_ms) <= 1800000 THEN 0.8 WHEN greatest(0, ts_ms - o_ms) <= 7200000 THEN 0.55 WHEN greatest(0, ts_ms - o_ms) <= 86400000 THEN 0.3 ELSE 0.1 END AS r FROM n),
e AS (SELECT session_id, seq, other, cnt, 'FOLLOWS' AS type, 0.55 + r * 0.4 AS c FROM q WHERE last = 1
UNION ALL SELECT session_id, seq, other, cnt, 'CAUSES', 0.45 + l * 0.35 + r * 0.2 FROM q WHERE {Q.has('nt', words.CAUSE)} AND {Q.has('nt', words.OUTCOME)} AND ({Q.has('o_nt', words.TRIGGER)} OR l >= 0.2)
UNION ALL SELECT session_id, seq, other, cnt, 'PARENT_TASK', 0.5 + l * 0.3 + r * 0.2 FROM q WHERE {Q.has('nt', words.SUBTASK)} AND {Q.has('o_nt', words.TASK)}
UNION ALL SELECT session_id, seq, other, cnt, 'CHILD_TASK', 0.45 + l * 0.35 + r * 0.2 FROM q WHERE {Q.has('nt', words.TASK)} AND {Q.has('o_nt', words.SUBTASK)}
UNION ALL SELECT session_id, seq, other, cnt, 'ALTERNATIVE', 0.4 + l * 0.4 + r * 0.2 FROM q WHERE {Q.has('nt', words.ALTERNATIVE)} AND l >= 0.15
UNION ALL SELECT session_id, seq, other, cnt, 'CONTEXT', l * 0.75 + r * 0.25 FROM q WHERE l * 0.75 + r * 0.25 >= 0.18),
z AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq, type ORDER BY c DESC, other) AS place FROM e)
SELECT session_id, seq, other, type, round(least(1, c), 6) AS confidence FROM z WHERE type <> 'CONTEXT' OR place <= greatest(2, least(6, ceil(cnt * 0.6)))"""


def _edges(spark, sf):
    b = _history_blocks(spark, sf)
    return b, relations.extract(b)


@query(_EXTRACT)
def relation_extract(spark, sf):
    b, e = _edges(spark, sf)
    ids = b.select("block_id", "session_id", "block_seq")
    x = e.join(ids.withColumnRenamed("block_id", "dst"), "dst").join(ids.select(F.col("block_id").alias("src"), F.col("block_seq").alias("other")), "src")
    return x.select("session_id", F.col("block_seq").alias("seq"), "other", "type", F.round("confidence", 6).alias("confidence"))


@query("""WITH r AS (SELECT trim(src) AS src, trim(dst) AS dst, trim(CASE type WHEN 'cause' THEN 'CAUSES' WHEN 'follow' THEN 'FOLLOWS' ELSE type END) AS type, least(1, greatest(0, c)) AS confidence FROM
(SELECT 's' || (o_orderkey % 40) || ' ' AS src, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'd' || (o_orderkey % 7) END AS dst, CASE o_orderkey % 5 WHEN 0 THEN 'cause' WHEN 1 THEN 'follow' WHEN 2 THEN ' ' WHEN 3 THEN 'CONTEXT' ELSE 'Cause' END AS type, (o_orderkey % 150) / 100.0 AS c FROM orders))
SELECT src, dst, type, max(confidence)::DOUBLE AS confidence FROM r WHERE type <> '' AND confidence >= 0.35 GROUP BY ALL""")
def relation_normalize(spark, sf):
    k = F.col("o_orderkey").cast("long")
    kind = F.when(k % 5 == 0, "cause").when(k % 5 == 1, "follow").when(k % 5 == 2, " ").when(k % 5 == 3, "CONTEXT").otherwise("Cause")
    dst = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("d"), (k % 7).cast("string")))
    x = base.table(spark, sf, "orders").select(F.concat(F.lit("s"), (k % 40).cast("string"), F.lit(" ")).alias("src"), dst.alias("dst"), kind.alias("type"), ((k % 150) / 100).alias("confidence"))
    return relations.normalized(x)


@query("""WITH w AS (SELECT 'c' || (o_custkey % 50) AS src, 'd' || (o_orderkey % 9) AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'FOLLOWS' ELSE 'CONTEXT' END AS type, o_orderkey AS write_seq, (o_orderkey % 100) / 100.0 AS confidence FROM orders)
SELECT src, dst, type, max(write_seq)::BIGINT AS write_seq, arg_max(confidence, write_seq)::DOUBLE AS confidence FROM w GROUP BY ALL""")
def latest_edges(spark, sf):
    k = F.col("o_orderkey").cast("long")
    x = base.table(spark, sf, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("src"), F.concat(F.lit("d"), (k % 9).cast("string")).alias("dst"), F.when(k % 2 == 0, "FOLLOWS").otherwise("CONTEXT").alias("type"), k.alias("write_seq"), ((k % 100) / 100).alias("confidence"))
    return tables.latest_edges(x)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_orderpriority END AS state FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey <> 0""")
def upsert_rows(spark, sf):
    """Changed rows replace, new ones are added, every fifth id is removed."""
    o = base.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderpriority").alias("state"))
    changes = o.filter("id % 3 = 0").select("id", F.lit("changed").alias("state"), F.lit(2).alias("at")).union(o.filter("id % 3 = 0").select("id", F.lit("stale").alias("state"), F.lit(1).alias("at"))).union(o.filter("id % 7 = 0").select((-F.col("id")).alias("id"), F.lit("new").alias("state"), F.lit(1).alias("at")))
    out = tables.upsert(o, changes, ["id"], "at")
    return tables.remove(out, o.filter("id % 5 = 0").select("id"), "id")


@query(f"WITH {Q.EVENTS}, x AS (SELECT session_id * 1000000 + seq AS ord, {_NAME.format('seq')} AS block_id, {Q.estimate('text')} AS token_count, session_id FROM ev) SELECT ord, block_id, token_count FROM x UNION ALL SELECT -1 - ord, block_id, token_count FROM x WHERE session_id % 10 = 0")
def get_many(spark, sf):
    """Blocks of every conversation; those of each tenth are asked for twice, once in front and backwards."""
    b = base.simple_blocks(spark, sf, embed=False)
    ids = b.select((F.col("session_id") * 1_000_000 + F.col("block_seq")).alias("ord"), "block_id", "session_id")
    ids = ids.drop("session_id").union(ids.filter("session_id % 10 = 0").select(-1 - F.col("ord"), "block_id"))
    return tables.get_many(b.select("block_id", "token_count"), ids).select("ord", "block_id", "token_count")


@query(f"""WITH RECURSIVE {_KW}, b AS (SELECT 0 AS g, ev.session_id // 5 AS s, {_NAME.format('seq')} AS block_id, ts_ms, greatest(1, {Q.estimate('text')}) AS tokens, k.keywords, row_number() OVER (PARTITION BY ev.session_id // 5 ORDER BY ts_ms, ev.session_id, seq) AS n FROM ev JOIN k USING (session_id, seq)),
f AS (SELECT s, block_id, n, tokens, ts_ms, keywords, 0::BIGINT AS chunk_seq, tokens::BIGINT AS held, 1 AS cnt FROM b WHERE n = 1
UNION ALL SELECT b.s, b.block_id, b.n, b.tokens, b.ts_ms, b.keywords, CASE WHEN x.cut THEN f.chunk_seq + 1 ELSE f.chunk_seq END, CASE WHEN x.cut THEN b.tokens ELSE f.held + b.tokens END, CASE WHEN x.cut THEN 1 ELSE f.cnt + 1 END
FROM f JOIN b ON b.s = f.s AND b.n = f.n + 1, LATERAL (SELECT (b.ts_ms - f.ts_ms > 900000) OR ((f.held >= 150 OR f.held + b.tokens > 150 OR f.held + b.tokens > 1400 OR f.cnt >= 3)
AND NOT (len(f.keywords) > 0 AND len(b.keywords) > 0 AND len(list_intersect(f.keywords, b.keywords))::DOUBLE / greatest(1, least(len(f.keywords), len(b.keywords))) >= 0.34)) AS cut) x)
SELECT block_id, chunk_seq, row_number() OVER (PARTITION BY s, chunk_seq ORDER BY n) - 1 AS pos, coalesce(sum(tokens) OVER (PARTITION BY s ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_start FROM f""")
def chunk_manifest(spark, sf):
    """Five conversations at a time as one sequence of blocks, cut into chunks."""
    b = base.simple_blocks(spark, sf, embed=False).withColumn("session_id", F.floor(F.col("session_id") / 5))
    cfg = load(env={}, chunk_target_tokens=150, chunk_max_blocks=3)
    return chunks.positions(b, cfg).select("block_id", "chunk_seq", "pos", "token_start")


@query("WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), c AS (SELECT user_id, event_id, n // 4 AS chunk, n % 4 AS pos FROM x) SELECT a.event_id, b.event_id AS other, abs(a.pos - b.pos) AS distance FROM c a JOIN c b ON a.user_id = b.user_id AND a.chunk = b.chunk AND abs(a.pos - b.pos) BETWEEN 1 AND 2")
def chunk_neighbors(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = base.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("block_id"), n.cast("long").alias("n"))
    placed = e.select("session_id", "block_id", F.floor(F.col("n") / 4).alias("chunk_seq"), (F.col("n") % 4).alias("pos"))
    return chunks.neighbors(placed, 2).select(F.col("block_id").cast("long").alias("event_id"), F.col("other").cast("long").alias("other"), F.col("distance").cast("long").alias("distance"))


@query("""SELECT o_orderkey AS id, CASE WHEN t < 120 THEN 'cooldown' WHEN i <= 300 THEN 'inject' WHEN i <= 1800 THEN 'prefetch' ELSE 'idle_too_long' END AS reason, CASE WHEN t < 120 THEN 0 WHEN i <= 300 THEN CASE WHEN s <= 1200 THEN 2 ELSE 1 END WHEN i <= 1800 THEN 1 ELSE 0 END::BIGINT AS depth
FROM (SELECT o_orderkey, o_orderkey % 2500 AS i, o_orderkey % 1900 AS s, o_orderkey % 700 AS t FROM orders)""")
def timing_policy(spark, sf):
    k = F.col("o_orderkey").cast("long")
    now = F.lit(1_000_000).cast("long")
    last = now - k % 2500
    x = base.table(spark, sf, "orders").select(k.alias("id"), S.timing(now, last, last - k % 1900, now - k % 700).alias("t"))
    return x.select("id", "t.reason", F.col("t.depth").cast("long").alias("depth"))


@query("""SELECT o_orderkey AS id, CASE WHEN (a <= .2)::INT + (b <= .15)::INT + (c <= .2)::INT >= 2 THEN 'hard' WHEN (a <= .35)::INT + (b <= .3)::INT + (c <= .35)::INT >= 2 THEN 'soft' ELSE 'none' END AS level FROM (SELECT o_orderkey, (o_orderkey % 97) / 100.0 AS a, (o_orderkey % 89) / 100.0 AS b, (o_orderkey % 83) / 100.0 AS c FROM orders)""")
def topic_shift_level(spark, sf):
    k = F.col("o_orderkey").cast("long")
    return base.table(spark, sf, "orders").select(k.alias("id"), S.topic_shift((k % 97) / 100, (k % 89) / 100, (k % 83) / 100, DEFAULT).alias("level"))


_PROBS = "SELECT id, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM (SELECT o_orderkey AS id, list_sort(list_filter([((o_orderkey % 7) / 10.0)::DOUBLE, ((o_orderkey % 5) / 10.0)::DOUBLE, ((o_orderkey % 3) / 10.0)::DOUBLE], lambda x: x > 0), 'DESC') AS raw FROM orders)"


def _three(spark, sf):
    k = F.col("o_orderkey").cast("long")
    return base.table(spark, sf, "orders").select(k.alias("id"), F.array((k % 7) / 10, (k % 5) / 10, (k % 3) / 10).alias("v"))


@query(f"""WITH p AS ({_PROBS}), h AS (SELECT id, p, len(p) AS n, CASE WHEN len(p) <= 1 THEN 0 ELSE -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))) / ln(len(p)) END AS h FROM p)
SELECT id, n::BIGINT AS size, round(CASE WHEN n = 0 THEN 0 ELSE h END, 6) AS entropy, n > 0 AND (n <= 2 OR (1 - h < 0.25 AND h > 0.75)) AS matched FROM h""")
def relation_trigger(spark, sf):
    x = _three(spark, sf).select("id", S.relation_trigger(F.col("v"), DEFAULT).alias("t"))
    return x.select("id", F.col("t.size").cast("long").alias("size"), F.round("t.entropy", 6).alias("entropy"), "t.matched")


@query(f"""WITH p AS ({_PROBS}), h AS (SELECT id, p, CASE WHEN len(p) <= 1 THEN 0 ELSE -list_sum(list_transform(p, lambda x: x * ln(x + 1e-9))) / ln(len(p)) END AS h, (id % 100) / 100.0 AS sim, id % 2 = 0 AS pre FROM p)
SELECT id, len(p) > 0 AND h <= CASE WHEN pre THEN 0.5 ELSE 0.3 END AND p[1] - coalesce(p[2], 0) >= CASE WHEN pre THEN 0.05 ELSE 0.2 END AND sim >= CASE WHEN pre THEN 0.35 ELSE 0.6 END AS passed FROM h""")
def retrieve_gate(spark, sf):
    return _three(spark, sf).select("id", S.retrieve_gate(F.col("v"), (F.col("id") % 100) / 100, F.col("id") % 2 == 0).alias("passed"))


@query("SELECT o_orderkey AS id, round(least(greatest(c * 0.25 * CASE WHEN sparse THEN 8 ELSE 0.054 END * 14, 0), 0.14), 6)::DOUBLE AS boost, CASE WHEN sparse THEN base <= 0.14 ELSE c >= 0.5 OR base <= 0.14 END AS allowed FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0 AS c, (o_orderkey % 61) / 100.0 AS base, o_orderkey % 2 = 0 AS sparse FROM orders)")
def prediction_boost(spark, sf):
    k = F.col("o_orderkey").cast("long")
    c, low, sparse = (k % 101) / 100, (k % 61) / 100, k % 2 == 0
    return base.table(spark, sf, "orders").select(k.alias("id"), F.round(S.prediction_boost(c, sparse, DEFAULT), 6).alias("boost"), S.boost_allowed(c, low, sparse, DEFAULT).alias("allowed"))


@query("""WITH e AS (SELECT 'n' || (l_orderkey % 30) AS dst, CASE l_linenumber % 5 WHEN 0 THEN 'file:a' WHEN 1 THEN ' ' WHEN 2 THEN 'snapshot:b' ELSE 'n' || l_linenumber END AS src, CASE l_orderkey % 4 WHEN 0 THEN 'SNAPSHOT_OF_FILE' WHEN 1 THEN 'CAUSES' WHEN 2 THEN '' ELSE 'FILE_MENTIONS_BLOCK' END AS type, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount * 20 END AS c FROM lineitem)
SELECT trim(src) AS src, dst, type, max(CASE WHEN c IS NULL THEN 0.5 ELSE least(1, greatest(0, c)) END)::DOUBLE AS confidence FROM e WHERE type <> '' AND (type = 'CAUSES' OR src LIKE 'file:%' OR src LIKE 'snapshot:%') GROUP BY ALL""")
def relation_validate(spark, sf):
    k, n = F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long")
    src = F.when(n % 5 == 0, "file:a").when(n % 5 == 1, " ").when(n % 5 == 2, "snapshot:b").otherwise(F.concat(F.lit("n"), n.cast("string")))
    kind = F.when(k % 4 == 0, "SNAPSHOT_OF_FILE").when(k % 4 == 1, "CAUSES").when(k % 4 == 2, "").otherwise("FILE_MENTIONS_BLOCK")
    conf = F.when(k % 3 != 0, F.col("l_discount").cast("double") * 20)
    x = base.table(spark, sf, "lineitem").select(src.alias("src"), F.concat(F.lit("n"), (k % 30).cast("string")).alias("dst"), kind.alias("type"), conf.alias("confidence"), F.lit("cur").alias("current_id"))
    return relations.validated(x)


def _overlap(x, *ids):
    return x.select(*ids, F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), S.continuous(F.col("a"), F.col("b")).alias("chained"))


@query("SELECT conv_id, turn, len(list_intersect(a, b)) AS shared, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b))::DOUBLE / greatest(1, least(len(list_distinct(a)), len(list_distinct(b)))) >= 0.34 AS chained FROM (SELECT conv_id, turn, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a, b FROM (SELECT conv_id, turn, " + Q.tokens("coalesce(text, '')") + " AS b FROM conversations)) WHERE a IS NOT NULL")
def set_overlap(spark, sf):
    """Whole texts: each turn with the one before it in its conversation."""
    x = base.table(spark, sf, "conversations").select("conv_id", "turn", T.tokens(F.coalesce("text", F.lit(""))).alias("b"))
    x = x.withColumn("a", F.lag("b").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("a is not null")
    return _overlap(x, "conv_id", "turn")
