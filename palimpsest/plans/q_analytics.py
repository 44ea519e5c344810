"""Queries over counters, histograms, percentiles, windows and grouping sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import diagnostics, retrieve, seal
from palimpsest.sources import files, web
from palimpsest.streaming import stateful

from . import base
from . import sqltext as Q
from .registry import query


@query(f"WITH {Q.EVENTS} SELECT session_id, count(*) AS total, count(*) FILTER (role = 'user') AS turns, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) FILTER (role = 'tool') AS tool_messages, count(*) FILTER (role NOT IN ('user', 'assistant', 'tool') OR role IS NULL) AS system_messages FROM ev GROUP BY session_id")
def conversation_stats(spark, sf):
    return diagnostics.conversation_stats(base.events(spark, sf), ["session_id"])


@query("SELECT reason, count(*) AS n, max(event_id) AS latest, arg_max(user_id, event_id)::VARCHAR AS source FROM (SELECT event_type AS reason, event_id, user_id, value > 90 AS allow, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 120 AND NOT allow GROUP BY reason")
def signal_reasons(spark, sf):
    x = base.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), (F.col("value") > 90).alias("allow"), F.col("event_type").alias("reason"), F.col("user_id").cast("string").alias("source"))
    return diagnostics.reasons(x)


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(CASE WHEN i = floor((n - 1) * 0.95) THEN value END) AS p95_floor, max(CASE WHEN i = greatest(0, ceil(n * 0.5) - 1) THEN value END) AS p50_ceil FROM r GROUP BY user_id""")
def percentiles(spark, sf):
    e = base.table(spark, sf, "events").select("user_id", "value")
    a = diagnostics.percentile(e, "value", 0.95, "floor", ["user_id"]).withColumnRenamed("value", "p95_floor")
    return a.join(diagnostics.percentile(e, "value", 0.5, "ceil", ["user_id"]).withColumnRenamed("value", "p50_ceil"), "user_id")


@query("WITH p AS (SELECT user_id, value / sum(value) OVER (PARTITION BY user_id) AS p FROM events WHERE value > 0) SELECT user_id, count(*) AS n, round(CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p + 1e-9)) / ln(count(*)) END, 6) AS entropy FROM p GROUP BY user_id")
def group_entropy(spark, sf):
    return diagnostics.entropy_of(base.table(spark, sf, "events"), ["user_id"], "value").select("user_id", "n", F.round("entropy", 6).alias("entropy"))


@query("""WITH h AS (SELECT user_id, event_type, CASE WHEN count(*) < 2 THEN 1.0 ELSE 1 / (var_pop(value / 100) + 0.01) END AS w FROM events GROUP BY ALL)
SELECT user_id, event_type, round(CASE WHEN min(w) OVER p = max(w) OVER p THEN 1.0 ELSE 0.5 + (w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p) * 1.5 END, 6) AS weight FROM h WINDOW p AS (PARTITION BY user_id)""")
def variance_weights(spark, sf):
    """Signals (event types) of a user weigh by how steady they are."""
    h = base.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.when(F.count("*") < 2, 1.0).otherwise(1 / (F.var_pop(F.col("value") / 100) + 0.01)).alias("w"))
    p = Window.partitionBy("user_id")
    low, high = F.min("w").over(p), F.max("w").over(p)
    return h.select("user_id", "event_type", F.round(F.when(low == high, 1.0).otherwise(0.5 + (F.col("w") - low) / (high - low) * 1.5), 6).alias("weight"))


@query("""WITH w AS (SELECT user_id, event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past FROM events)
SELECT event_id, coalesce(len(list_distinct(past)), 0)::BIGINT AS known, coalesce(list_contains(past, event_type), false) AS seen FROM w""")
def sliding_union(spark, sf):
    past = F.collect_list("event_type").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-5, -1))
    x = base.table(spark, sf, "events").select("event_id", "event_type", past.alias("past"))
    return x.select("event_id", F.size(F.array_distinct("past")).cast("long").alias("known"), F.array_contains("past", F.col("event_type")).alias("seen"))


@query(f"""WITH {Q.EVENTS}, t AS (SELECT session_id, seq, {Q.tokens('text')} AS k FROM ev WHERE role = 'user'), i AS (SELECT * FROM t WHERE len(k) >= 3 AND len(list_distinct(k)) >= 2), l AS (SELECT *, lag(k) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM i)
SELECT session_id, seq, round(CASE WHEN p IS NULL THEN NULL ELSE len(list_intersect(k, p))::DOUBLE / len(list_distinct(list_concat(k, p))) END, 6) AS overlap FROM l""")
def query_lag(spark, sf):
    """Overlap of each informative user query with the informative one before."""
    from palimpsest.functions import scoring as S
    from palimpsest.functions import text as T

    x = base.events(spark, sf).filter("role = 'user'").select("session_id", "seq", T.tokens("text").alias("k")).filter((F.size("k") >= 3) & (F.size(F.array_distinct("k")) >= 2))
    p = F.lag("k").over(Window.partitionBy("session_id").orderBy("seq"))
    x = x.withColumn("p", p)
    return x.select("session_id", "seq", F.when(F.col("p").isNotNull(), F.round(S.jaccard(F.col("k"), F.col("p")), 6)).alias("overlap"))


@query("SELECT n_nationkey AS k, url, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY rank, url) AS place FROM (SELECT n_nationkey, p_brand AS url, min(p_size) AS rank FROM part, nation WHERE p_partkey % 25 = n_nationkey GROUP BY ALL)) WHERE place <= 5")
def url_dedupe(spark, sf):
    x = base.table(spark, sf, "part").select((F.col("p_partkey") % 25).alias("k"), F.col("p_brand").alias("url"), F.col("p_size").alias("rank"), F.lit("").alias("title"), F.lit("").alias("snippet"))
    n = base.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    y = web.dedupe_by_url(x.join(n, "k"), ["k"], 5)
    return y.select(F.col("k").cast("int").alias("k"), "url", "rank", "place")


@query(f"""WITH {Q.EVENTS} SELECT count(*) AS blocks, sum({Q.estimate('text')})::BIGINT AS tokens, count(*) FILTER (seq % 3 = 0) AS raw, count(*) FILTER (seq % 3 = 1) AS compressed, count(*) FILTER (seq % 3 = 2) AS conflict, count(*) AS raw_buckets, count(*) AS raw_events, (SELECT count(*) FROM ev WHERE seq > (SELECT min(seq) FROM ev e WHERE e.session_id = ev.session_id)) AS relations FROM ev""")
def admin_snapshot(spark, sf):
    b = base.simple_blocks(spark, sf, embed=False)
    mode = F.when(F.col("block_seq") % 3 == 0, "raw").when(F.col("block_seq") % 3 == 1, "compressed").otherwise("conflict")
    raw = b.select("block_id", F.array("text").alias("events"))
    return diagnostics.admin_snapshot(b.withColumn("retention_mode", mode), raw, seal.follows(b))


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS outgoing, (SELECT count(*) FROM supplier WHERE s_nationkey = c_custkey) AS incoming FROM customer")
def block_degrees(spark, sf):
    c = base.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("block_id"))
    o = base.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("src"), F.lit("x").alias("dst"))
    s = base.table(spark, sf, "supplier").select(F.lit("y").alias("src"), F.col("s_nationkey").cast("string").alias("dst"))
    return diagnostics.with_degree(c, o.unionByName(s)).select(F.col("block_id").cast("long").alias("id"), "outgoing", "incoming")


@query("SELECT event_id AS id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 7)")
def trace_tail(spark, sf):
    return files.trace_tail(base.table(spark, sf, "events").select(F.col("event_id").alias("id")), 7, 100).select("id")


@query("""WITH n AS (SELECT event_id AS id, user_id, ts, value FROM events) SELECT a.id, (SELECT count(*) FROM n b WHERE b.user_id = a.user_id AND b.ts < a.ts) > 0 AS has_previous, (SELECT max(b.ts) FROM n b WHERE b.user_id = a.user_id AND b.ts < a.ts) AS previous FROM n a""")
def asof_previous(spark, sf):
    """The latest earlier event of the same user: an as-of join by a running maximum."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    x = base.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.max("ts").over(w).alias("previous"))
    return x.select("id", F.col("previous").isNotNull().alias("has_previous"), "previous")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, sf):
    x = stateful.window_counts(base.table(spark, sf, "events"), "ts", ["event_type"], "value")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, user_id % 5 AS bucket, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, grouping(event_type) * 2 + grouping(user_id % 5) AS level FROM events GROUP BY CUBE (event_type, user_id % 5)")
def event_cube(spark, sf):
    x = base.table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 5)
    return x.cube("event_type", "bucket").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.grouping_id().alias("level"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def lineitem_rollup(spark, sf):
    return base.table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT query_id, block_id, score FROM (SELECT o_custkey AS query_id, o_orderkey AS block_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(spark, sf):
    o = base.table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("block_id"), F.col("o_totalprice").alias("score"))
    return retrieve.ranked(o, 3, F.desc("score"), "block_id").select("query_id", "block_id", "score")


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 2 = 0)")
def seeds_semi_anti(spark, sf):
    c = base.table(spark, sf, "customer")
    o = base.table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    s = base.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return c.join(o, "c_custkey", "left_semi").join(s, "c_nationkey", "left_anti").select(F.col("c_custkey").alias("id"))
