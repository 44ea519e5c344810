"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors
from palimpsest.operators import seal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores comes in as few tasks; its rows are dealt out before their texts are parsed."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events: a day a conversation, a minute a turn."""
    ts = F.lit(1_704_067_200_000) + F.col("conv_id") * 86_400_000 + F.col("turn") * 60_000
    return spread(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"), ts.alias("ts_ms"))


def name(session: Column | str = "session_id", seq: Column | str = "seq") -> Column:
    s, q = (F.col(x) if isinstance(x, str) else x for x in (session, seq))
    return seal.block_id(s, q)


def simple_blocks(spark: SparkSession, sf_dir: str, embed: bool = True) -> DataFrame:
    """Every event is a block of its own text (a seal after every event, without a summary)."""
    e = events(spark, sf_dir)
    x = e.select("session_id", F.col("seq").alias("block_seq"), name().alias("block_id"), F.col("ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), T.estimate_tokens("text").alias("token_count"), "text", T.keywords("text", 8).alias("keywords"))
    return x.withColumn("embedding", vectors.hash_embedding("text")) if embed else x


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a batch of queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to orders (FOLLOWS) and orders to parts (CONTEXT): edges at volume."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit("FOLLOWS").alias("type"), F.lit(None).cast("double").alias("confidence"))
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("CONTEXT").alias("type"), F.col("l_discount").cast("double").alias("confidence"))
    return o.unionByName(line)
