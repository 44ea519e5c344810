"""Queries over retrieval, graph steps, prediction, context and detectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors
from palimpsest.operators import context, detect, diagnostics, graph, retrieve
from palimpsest.plans.engine import Engine
from palimpsest.sources.config import DEFAULT, load
from palimpsest.storage import durable

from . import base
from . import sqltext as Q
from .registry import query

_DOCS = f"src AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), qs AS (SELECT item_id AS id, text FROM benchmark), {Q.keywords('dk', 'src', 'id', 'text', 8)}, {Q.keywords('qk', 'qs', 'id', 'text', 8)}"
_KEY = f"""{_DOCS}, qx AS (SELECT id AS query_id, unnest(keywords) AS key, generate_subscripts(keywords, 1) - 1 AS pos FROM qk), dx AS (SELECT DISTINCT id, unnest(keywords) AS key FROM dk),
cand AS (SELECT query_id, dx.id, min(pos) AS first FROM qx JOIN dx USING (key) GROUP BY ALL),
ks AS (SELECT c.query_id, c.id, c.first, len(list_intersect(a.keywords, b.keywords))::DOUBLE / len(list_distinct(list_concat(a.keywords, b.keywords))) AS score FROM cand c JOIN qk a ON a.id = c.query_id JOIN dk b ON b.id = c.id),
kw AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM ks) WHERE rank <= 6)"""
_VEC = f"""{Q.vectors('dv', 'src', 'id', 'text')}, {Q.vectors('qv', 'qs', 'id', 'text')}, vs AS (SELECT qv.id AS query_id, dv.id, round(sum(qv.value * dv.value), 9) AS score FROM qv JOIN dv USING (bin) GROUP BY ALL),
vec AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lpad(id::VARCHAR, 10, '0')) AS rank FROM vs) WHERE rank <= 6)"""
_RRF = f"""{_KEY}, {_VEC}, parts AS (SELECT query_id, id, rank, 0 AS place, 0.45 / (60 + rank) AS part FROM kw UNION ALL SELECT query_id, id, rank, 1, 0.55 / (60 + rank) FROM vec),
fused AS (SELECT query_id, id, sum(part)::DOUBLE AS score, count(*) AS sources, min(place * 100 + rank) AS seen FROM parts GROUP BY ALL),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, sources DESC, seen) AS rank FROM fused) WHERE rank <= 6)"""


def _docs(spark, sf, of=("keywords", "embedding")):
    """Documents as one-event blocks, with keywords, embedding, or both from one count of a text's tokens."""
    d = base.spread(base.table(spark, sf, "documents").select("doc_id", "text"))
    t = F.coalesce("text", F.lit(""))
    x = d.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("block_id"), F.col("doc_id").alias("block_seq"), t.alias("_t"))
    found = vectors.analysis("_t", 8) if len(of) == 2 else F.struct(T.keywords("_t", 8).alias("keywords") if of == ("keywords",) else vectors.hash_embedding("_t").alias("embedding"))
    return x.select("block_id", "block_seq", found.alias("_a")).select("block_id", "block_seq", *[f"_a.{c}" for c in of])


def _queries(spark, sf):
    return retrieve.analyzed(base.text_queries(spark, sf))


def _plain(hits, *more):
    return hits.select("query_id", F.col("block_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), "rank", *more)


@query(f"WITH {_KEY} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM kw")
def kw_topk(spark, sf):
    return _plain(retrieve.keyword_topk(_queries(spark, sf), _docs(spark, sf, ("keywords",)), 6))


@query(f"WITH {_DOCS}, {_VEC} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM vec")
def vec_topk(spark, sf):
    return _plain(retrieve.vector_topk(_queries(spark, sf), _docs(spark, sf, ("embedding",)), 6, 0.0))


@query(f"WITH {_RRF} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank, sources FROM rrf")
def rrf_topk(spark, sf):
    """Flagship: a batch of text queries against all documents, keyword and vector lists fused by rank."""
    return _plain(retrieve.semantic_topk(_queries(spark, sf), _docs(spark, sf)), "sources")


def _vectors(spark, sf):
    """All vectors, those of ids divisible by 20 as queries, and all as blocks."""
    e = base.table(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("block_id"), "embedding")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _nearest(q, b):
    return _hits(retrieve.vector_topk(q, b, 5))


def _two_stage(q, b):
    """The first half of each vector prescreens, the second reranks."""
    halves = {"hash": F.slice("embedding", 1, 32), "local": F.slice("embedding", 33, 32)}
    return _hits(retrieve.two_stage_topk(q.withColumns(halves), b.withColumns(halves), 5, b.count()))


def _hits(found):
    return found.select("query_id", F.col("block_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5")
def embedding_topk(spark, sf):
    """Every id divisible by 20 is a query."""
    return _nearest(*_vectors(spark, sf)[1:])


@query()
def lsh_topk(spark, sf):
    """Approximate; recall is tested against embedding_topk. The true neighbours have a cosine of 0.3 to 0.45 only, so many tables of few bits."""
    _, q, b = _vectors(spark, sf)
    return _hits(retrieve.lsh_topk(q, b, 5, 64, tables=24, bits=8))


@query("""WITH s AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]), 9) AS h, round(list_cosine_similarity(a.embedding[33:64]::DOUBLE[], b.embedding[33:64]::DOUBLE[]), 9) AS l FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, vec_id) AS hr FROM c), t AS (SELECT * FROM p, s WHERE hr <= least(n, least(100, greatest(20, floor(n * 0.05))))),
g AS (SELECT *, max(CASE WHEN hr = 5 THEN h END) OVER w - max(CASE WHEN hr = 6 THEN h END) OVER w >= 0.12 AS sure FROM t WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT query_id, vec_id, hr, CASE WHEN sure THEN h ELSE l END AS score FROM g WHERE sure OR hr <= least(15, 16))
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hr) AS rank FROM z) WHERE rank <= 5""")
def two_stage_topk(spark, sf):
    """Every id divisible by 20 is a query."""
    return _two_stage(*_vectors(spark, sf)[1:])


_TRADE = "e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'FOLLOWS' AS type, 0.9::DOUBLE AS conf FROM orders UNION ALL SELECT src, dst, 'CONTEXT', max(conf) FROM (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, greatest(0.05, least(1, l_discount))::DOUBLE AS conf FROM lineitem) GROUP BY ALL)"
_SEEDS = "s AS (SELECT c_custkey AS query_id, 'c' || c_custkey AS node FROM customer)"


def _seeds(spark, sf):
    """Every customer starts a query."""
    return base.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


@query(f"""WITH {_TRADE}, {_SEEDS}, a AS (SELECT src AS node, dst AS target FROM e UNION SELECT dst, src FROM e),
s1 AS (SELECT DISTINCT query_id, target AS node FROM s JOIN a USING (node)), f1 AS (SELECT * FROM s1 EXCEPT SELECT * FROM s), s2 AS (SELECT DISTINCT query_id, target AS node FROM f1 JOIN a USING (node)), f2 AS (SELECT * FROM s2 EXCEPT (SELECT * FROM s UNION SELECT * FROM f1))
SELECT query_id, node, 0 AS step FROM s UNION ALL SELECT query_id, node, 1 FROM f1 UNION ALL SELECT query_id, node, 2 FROM f2""")
def graph_traverse(spark, sf):
    return graph.traverse(_seeds(spark, sf), base.trade_edges(spark, sf), depth=2)


@query(f"""WITH {_TRADE}, {_SEEDS}, a AS (SELECT src AS node, dst AS target, conf FROM e), n AS (SELECT node, count(*) AS n FROM a GROUP BY node),
f1 AS (SELECT query_id, target AS node, sum(1.0::DOUBLE / n * conf) AS mass FROM s JOIN a USING (node) JOIN n USING (node) GROUP BY ALL),
f2 AS (SELECT query_id, target AS node, sum(mass / n * 0.88::DOUBLE * conf) AS mass FROM f1 JOIN a USING (node) JOIN n USING (node) GROUP BY ALL),
t AS (SELECT query_id, node, sum(mass) AS mass FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY ALL), z AS (SELECT query_id, node, mass / max(mass) OVER (PARTITION BY query_id) AS score FROM t)
SELECT query_id, node AS block_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, node) AS rank FROM z WHERE node LIKE 'p%') WHERE rank <= 8""")
def graph_topk(spark, sf):
    """Mass from customers over orders to parts; only parts are blocks."""
    parts = base.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("block_id"))
    return graph.expand(_seeds(spark, sf), base.trade_edges(spark, sf), parts, 8, "outgoing", [], 2).select("query_id", "block_id", F.round("score", 6).alias("score"), "rank")


_WALK = f"""{_TRADE}, {_SEEDS}, a AS (SELECT DISTINCT src AS node, dst AS target FROM e), n AS (SELECT node, count(*) AS n FROM a GROUP BY node),
f1 AS (SELECT query_id, target AS node, sum(1.0::DOUBLE / n) AS p FROM s JOIN a USING (node) JOIN n USING (node) GROUP BY ALL), f2 AS (SELECT query_id, target AS node, sum(p / n * 0.75::DOUBLE) AS p FROM f1 JOIN a USING (node) JOIN n USING (node) GROUP BY ALL),
t AS (SELECT query_id, node, sum(p) AS p FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY ALL), w AS (SELECT query_id, node, p / sum(p) OVER (PARTITION BY query_id) AS p FROM t)"""


@query(f"WITH {_WALK} SELECT query_id, node, round(p + 1e-12, 6) AS p FROM w")
def random_walk(spark, sf):
    """Shares such as 1/128 end in a 5 behind the sixth digit: a nudge rounds them alike in whichever order they were summed."""
    return graph.walk(_seeds(spark, sf), base.trade_edges(spark, sf)).select("query_id", "node", F.round(F.col("p") + 1e-12, 6).alias("p"))


@query(f"""WITH {_WALK}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 12) DESC, node) AS rank FROM w)
SELECT query_id, node AS block_id, round(p, 6) AS confidence, rank, CASE WHEN node LIKE 'p%' THEN (SELECT left(p_name, 24) FROM part WHERE 'p' || p_partkey = node) ELSE 'unknown-intent' END AS label FROM r WHERE rank <= 3""")
def predicted_intents(spark, sf):
    b = base.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("block_id"), F.array().cast("array<string>").alias("keywords"), F.col("p_name").alias("summary"))
    x = graph.intents(graph.walk(_seeds(spark, sf), base.trade_edges(spark, sf)), b, 3)
    return x.select("query_id", "block_id", F.round("confidence", 6).alias("confidence"), "rank", "label")


_RING = "r AS (SELECT vec_id AS src, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS dst, CASE WHEN vec_id % 2 = 0 THEN 'FOLLOWS' ELSE 'CAUSES' END AS type FROM embeddings)"


def _ring(spark, sf):
    e = base.table(spark, sf, "embeddings").select("vec_id")
    n = e.count()
    s = lambda c: c.cast("string")
    return e.select(s(F.col("vec_id")).alias("src"), s((F.col("vec_id") * 7 + 3) % n).alias("dst"), F.when(F.col("vec_id") % 2 == 0, "FOLLOWS").otherwise("CAUSES").alias("type"))


def _nodes(spark, sf):
    return base.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("block_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _unit_sql(mix: str) -> str:
    return f"z AS (SELECT vec_id, i, {mix} AS x FROM own LEFT JOIN mean USING (vec_id, i)) SELECT vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM z"


_OWN = "own AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS e FROM embeddings)"


def _cells(df):
    return df.select(F.col("block_id").cast("long").alias("vec_id"), F.posexplode("vector").alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


@query(f"WITH {_RING}, {_OWN}, nb AS (SELECT src AS vec_id, dst AS o FROM r UNION SELECT dst, src FROM r), mean AS (SELECT nb.vec_id, i, avg(e) AS m FROM nb JOIN own ON own.vec_id = nb.o GROUP BY ALL), {_unit_sql('0.65::DOUBLE * e + 0.35::DOUBLE * coalesce(m, 0)')}")
def graph_embedding(spark, sf):
    return _cells(graph.embed_nodes(_nodes(spark, sf), _ring(spark, sf), "mean", dim=64))


def _type_cells() -> str:
    return ", ".join(f"('{t}', {i}::BIGINT, {x!r}::DOUBLE)" for t in ("FOLLOWS", "CAUSES") for i, x in enumerate(vectors.relation_vector(t, 64)))


@query(f"WITH {_RING}, {_OWN}, tv AS (SELECT * FROM (VALUES {_type_cells()}) AS v(type, i, x)), nb AS (SELECT DISTINCT src AS vec_id, dst AS o, type, -1 AS g FROM r UNION SELECT DISTINCT dst, src, type, 1 FROM r), mean AS (SELECT nb.vec_id, own.i, avg(e + g * x) AS m FROM nb JOIN own ON own.vec_id = nb.o JOIN tv ON tv.type = nb.type AND tv.i = own.i GROUP BY ALL), {_unit_sql('0.6::DOUBLE * e + 0.4::DOUBLE * coalesce(m, 0)')}")
def graph_translation(spark, sf):
    return _cells(graph.embed_nodes(_nodes(spark, sf), _ring(spark, sf), "translate", dim=64))


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) SELECT label, i, round(avg(e), 6) AS value FROM x GROUP BY ALL")
def vector_mean(spark, sf):
    m = vectors.vector_sum(base.table(spark, sf, "embeddings"), ["label"], "embedding", mean=True)
    return m.select("label", F.posexplode("vector").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("value"))


_HYB = f"""{_RRF}, ring AS (SELECT doc_id AS src, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS dst FROM documents), arcs AS (SELECT src AS node, dst AS target FROM ring UNION ALL SELECT dst, src FROM ring), deg AS (SELECT node, count(*) AS n FROM arcs GROUP BY node),
m AS (SELECT query_id, count(*) AS m FROM rrf GROUP BY query_id), g1 AS (SELECT query_id, target AS id, sum(1.0::DOUBLE / m / n * 0.9::DOUBLE) AS mass FROM rrf JOIN m USING (query_id) JOIN arcs ON arcs.node = rrf.id JOIN deg ON deg.node = rrf.id GROUP BY ALL),
g2 AS (SELECT g1.* FROM g1 ANTI JOIN rrf USING (query_id, id)), g3 AS (SELECT query_id, id, mass / max(mass) OVER (PARTITION BY query_id) AS score FROM g2), g4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, lpad(id::VARCHAR, 10, '0')) AS r FROM g3) WHERE r <= 4),
h AS (SELECT query_id, id, sum(score) AS score FROM (SELECT query_id, id, score FROM rrf UNION ALL SELECT query_id, id, score * 0.3 FROM g4) GROUP BY ALL)"""


def _hybrid(spark, sf):
    d, q = _docs(spark, sf), _queries(spark, sf)
    n = base.table(spark, sf, "documents").count()
    key = lambda c: F.lpad(c.cast("string"), 10, "0")
    ids = base.table(spark, sf, "documents").select("doc_id")
    edges = ids.select(key(F.col("doc_id")).alias("src"), key((F.col("doc_id") * 7 + 3) % n).alias("dst"), F.lit("FOLLOWS").alias("type"), F.lit(None).cast("double").alias("confidence"))
    semantic = durable(retrieve.semantic_topk(q, d))  # few rows, used three times
    found = graph.expand(semantic.select("query_id", F.col("block_id").alias("node")), edges, d, 4, "both", [], 1)
    return q, retrieve.add_scores(semantic, found.select("query_id", "block_id", (F.col("score") * 0.3).alias("score")))


@query(f"WITH {_HYB} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, lpad(id::VARCHAR, 10, '0')) AS rank FROM h) WHERE rank <= 8")
def hybrid_topk(spark, sf):
    """Fused hits, and what one step over a ring of edges adds to them."""
    return _plain(retrieve.final_rank(_hybrid(spark, sf)[1], 8))


@query(f"""WITH {_HYB}, i AS (SELECT query_id, id, 0.4 + (id % 5) / 10.0 AS c, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM h), b AS (SELECT h.query_id, h.id, h.score AS base, CASE WHEN i.n <= 3 AND (i.c >= 0.5 OR h.score <= 0.14) THEN least(i.c * 0.25 * 0.054 * 14, 0.14) ELSE 0 END AS boost FROM h JOIN i USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(base, 12) DESC, lpad(id::VARCHAR, 10, '0')) AS pre, row_number() OVER (PARTITION BY query_id ORDER BY round(base + boost, 12) DESC, lpad(id::VARCHAR, 10, '0')) AS post, count(*) OVER (PARTITION BY query_id) AS n FROM b),
k AS (SELECT query_id, base + boost AS kth FROM r WHERE post = least(5, n)), t AS (SELECT query_id, min(id) AS id FROM h GROUP BY query_id)
SELECT query_id, id AS doc_id, pre, post, pre - post AS delta, round(greatest(0, kth - (base + boost)), 6)::DOUBLE AS gap FROM r JOIN t USING (query_id, id) JOIN k USING (query_id)""")
def boosted_ranks(spark, sf):
    """Predictions boost three documents of each query; how the first one's rank moves."""
    q, h = _hybrid(spark, sf)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("block_id"))
    i = h.select("query_id", "block_id", (0.4 + (F.col("block_id").cast("long") % 5) / 10).alias("confidence"), n.alias("n")).filter("n <= 3").withColumn("active", F.lit(True))
    b = retrieve.boosted(h, i, q)
    t = h.groupBy("query_id").agg(F.min("block_id").alias("block_id")).withColumn("k", F.lit(5))
    return retrieve.rank_shift(b, t).select("query_id", F.col("block_id").cast("long").alias("doc_id"), "pre", "post", "delta", F.round("gap", 6).alias("gap"))


@query(f"""WITH {_RRF}, tr AS (SELECT query_id, id FROM ks WHERE score > 0.05), hit AS (SELECT tr.query_id, count(*) AS hits FROM tr JOIN rrf USING (query_id, id) WHERE rank <= 5 GROUP BY ALL), w AS (SELECT query_id, count(*) AS want FROM tr GROUP BY query_id)
SELECT count(*) AS queries, round(avg(coalesce(hits, 0)::DOUBLE / want), 6) AS recall, round(avg(coalesce(hits, 0) / 5.0::DOUBLE), 6) AS precision, round(avg(CASE WHEN coalesce(hits, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate FROM w LEFT JOIN hit USING (query_id)""")
def retrieval_metrics(spark, sf):
    q, d = _queries(spark, sf), _docs(spark, sf)
    there = retrieve.packed_blocks(d)
    truth = retrieve.keyword_scores_over(q, there, 0.05).select("query_id", F.col("block_id").alias("item"))
    m = diagnostics.retrieval_metrics(retrieve.semantic_topk(q, d, there=there).withColumnRenamed("block_id", "item"), truth, 5)
    return m.select("queries", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "pass_rate")])


def _engine(spark, sf):
    e = Engine(spark, load(env={}, max_tokens_per_block=120, min_tokens_per_block=40))
    return e, e.build(base.events(spark, sf))


def _asked(spark, sf):
    """First user turns as queries, in the order of their conversations."""
    c = base.events(spark, sf).filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "seq").alias("text"))
    return c.select(F.col("session_id").alias("query_id"), "session_id", F.col("text").alias("query"))


@query()
def engine_context(spark, sf):
    """From events to formatted contexts through all stages. The tests hold the hits of long questions against plain Python, not every stage."""
    e, t = _engine(spark, sf)
    return e.context(_asked(spark, sf), t)


@query()
def engine_signals(spark, sf):
    """Queries of twenty conversations in a row as one session each, through the detectors."""
    e, t = _engine(spark, sf)
    q = _asked(spark, sf)
    found = e.retrieve(q, t)
    seq = q.select("query_id", F.floor(F.col("session_id") / 20).alias("session_id"), F.col("session_id").alias("seq"), (F.lit(1_704_067_200) + F.col("session_id") * 400).alias("now"), F.lit("user").alias("source"))
    return detect.detect(e.query_log(seq, found, t), e.cfg)


@query(f"""WITH {Q.EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM ev) SELECT session_id, string_agg(upper(role) || ': ' || md5(text), '|' ORDER BY seq) AS recent FROM r WHERE n <= 6 GROUP BY session_id""")
def recent_events(spark, sf):
    x = context.recent(base.events(spark, sf), DEFAULT.recent_event_window)
    return x.select("session_id", F.array_join(F.transform("recent", lambda e: F.concat(F.upper(e["role"]), F.lit(": "), F.md5(e["text"]))), "|").alias("recent"))


_NEXT = f"(len(given) = 0 OR x.now - given[-1] >= {DEFAULT.proactive_wakeup_min_interval_seconds}) AND len(given) < {max(1, DEFAULT.proactive_wakeup_max_per_hour)}"


@query(f"""WITH RECURSIVE x AS (SELECT user_id % 10 AS session_id, epoch_us(ts) // 1000000 AS now, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 1000000) AS n FROM events),
f AS (SELECT session_id, now, n, true AS admitted, [now] AS given FROM x WHERE n = 1
UNION ALL SELECT session_id, now, n, ok, CASE WHEN ok THEN list_append(given, now) ELSE given END FROM (SELECT x.session_id, x.now, x.n, given, {_NEXT} AS ok
FROM (SELECT f.session_id, f.n, y.now AS now, list_filter(f.given, lambda g: y.now - g <= 3600) AS given FROM f JOIN x y ON y.session_id = f.session_id AND y.n = f.n + 1) p JOIN x ON x.session_id = p.session_id AND x.n = p.n + 1))
SELECT session_id, now, admitted FROM f""")
def wakeup_budget(spark, sf):
    """Every wake-up with what the budget says of it; ten users in a session, so that hours fill up."""
    x = base.table(spark, sf, "events").select((F.col("user_id") % 10).alias("session_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("now"))
    return detect.planned(x)
