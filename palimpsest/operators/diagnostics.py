"""Counters, histograms, percentiles and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conversation_stats(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages, turns (user messages) and messages by role; unknown roles count as system."""
    n = lambda cond: F.count_if(cond).alias
    role = F.col("role")
    return events.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), n(role == "user")("turns"), n(role == "user")("user_messages"), n(role == "assistant")("assistant_messages"), n(role == "tool")("tool_messages"),
        n(~F.coalesce(role.isin("user", "assistant", "tool"), F.lit(False)))("system_messages"),
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def reasons(signals: DataFrame, last: int = 120) -> DataFrame:
    """Of the last signals of each session that did not wake: count, latest time and its source by reason."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    x = signals.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= last) & ~F.col("allow"))
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.max("at").alias("latest"), F.max_by("source", F.struct("at", "seq")).alias("source"))


def percentile(df: DataFrame, value: str, r: float, kind: str = "floor", by: list[str] | None = None) -> DataFrame:
    """Exact order statistic: index floor((n - 1) r), or ceil(n r) - 1, from 0.  By ranks, so no group is collected."""
    by = by or []
    x = df.select(*by, value, F.row_number().over(Window.partitionBy(*by).orderBy(value)).alias("_i"))
    n = df.groupBy(*by).agg(F.count(value).alias("_n"))
    at = F.floor((F.col("_n") - 1) * r) if kind == "floor" else F.greatest(F.lit(0), F.ceil(F.col("_n") * r) - 1)
    n = n.withColumn("_i", (at + 1).cast("int"))
    y = x.join(n, [*by, "_i"]) if by else x.join(F.broadcast(n), "_i")  # one row
    return y.select(*by, F.col(value).alias("value"))


def retrieval_metrics(results: DataFrame, truth: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """recall, precision and pass rate at k.  results: query_id, item, rank; truth: query_id, item and the by columns."""
    by = by or []
    hits = results.filter(F.col("rank") <= k).join(truth.select("query_id", "item"), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.countDistinct("item").alias("hits"))
    want = truth.groupBy("query_id", *by).agg(F.countDistinct("item").alias("want")).join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return want.groupBy(*by).agg(F.count("*").alias("queries"), F.avg(F.col("hits") / F.col("want")).alias("recall"), F.avg(F.col("hits") / k).alias("precision"), F.avg((F.col("hits") > 0).cast("double")).alias("pass_rate"))


def admin_snapshot(blocks: DataFrame, raw: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of totals."""
    a = blocks.agg(F.count("*").alias("blocks"), F.sum("token_count").alias("tokens"), *[F.count_if(F.col("retention_mode") == m).alias(m) for m in ("raw", "compressed", "conflict")])
    b = raw.agg(F.count("*").alias("raw_buckets"), F.sum(F.size("events")).alias("raw_events"))
    return a.crossJoin(b).crossJoin(relations.agg(F.count("*").alias("relations")))  # one row each


def with_degree(blocks: DataFrame, relations: DataFrame) -> DataFrame:
    """Blocks with their numbers of outgoing and incoming edges, by start."""
    o = relations.groupBy(F.col("src").alias("block_id")).agg(F.count("*").alias("outgoing"))
    i = relations.groupBy(F.col("dst").alias("block_id")).agg(F.count("*").alias("incoming"))
    x = blocks.join(o, "block_id", "left").join(i, "block_id", "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("outgoing", "incoming")})


def streaks(df: DataFrame, by: list[str], order: str, hit: Column) -> DataFrame:
    """streak: consecutive hits up to each row, 0 on a miss."""
    w = Window.partitionBy(*by).orderBy(order)
    x = df.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_g", F.sum((~F.col("_hit")).cast("int")).over(w))
    n = F.sum(F.col("_hit").cast("long")).over(Window.partitionBy(*by, "_g").orderBy(order))
    return x.withColumn("streak", n).drop("_hit", "_g")


def entropy_of(df: DataFrame, by: list[str], weight: str, eps: float = 1e-9) -> DataFrame:
    """Normalised Shannon entropy of the positive weights of each group."""
    x = df.filter(F.col(weight) > 0).withColumn("_p", F.col(weight) / F.sum(weight).over(Window.partitionBy(*by)))
    y = x.groupBy(*by).agg(F.sum(-F.col("_p") * F.log(F.col("_p") + eps)).alias("_h"), F.count("*").alias("n"))
    return y.select(*by, "n", F.when(F.col("n") <= 1, 0.0).otherwise(F.col("_h") / F.log(F.col("n").cast("double"))).alias("entropy"))


def latest_control(events: DataFrame, by: list[str]) -> DataFrame:
    """The last setting (enabled) of the questioning switch in each group; events: metadata as JSON, seq."""
    x = events.filter(F.get_json_object("metadata", "$.tool") == "questioning")
    return x.groupBy(*by).agg(F.max_by((F.get_json_object("metadata", "$.enabled") == "true"), "seq").alias("enabled"))
