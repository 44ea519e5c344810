"""Conversation turns to memory blocks, incrementally: each run takes the files that are new since the last one.

    python -m jobs.seal_conversations --turns PATH --blocks PATH --checkpoint PATH [--config FILE]

Turns come from a Parquet table (a folder that grows by files, or one file).  The open block of every
conversation is kept as stream state in the checkpoint, so a run reads new turns only and picks up
conversations where they were left.  Blocks are written enriched (summary, keywords, tags, embedding) to
BLOCKS/batch=.../sealed=...: sealed ones once, open ones in each batch that touched them.  A batch that is
repeated after a failure replaces its own folders.  Rows without a conversation or a place in it are counted
and left out; null texts are empty, null roles are "user".
"""

from __future__ import annotations

import argparse
import logging
import os
import tomllib

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import seal
from palimpsest.sources.config import load
from palimpsest.streaming import sealing

log = logging.getLogger("jobs.seal_conversations")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "seal_conversations.toml")


def read_config(path: str = CONFIG) -> dict:
    """Tables [turns] (columns as SQL expressions), [run] and [manager] (the engine's settings)."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def as_events(turns: DataFrame, columns: dict) -> DataFrame:
    """session_id, seq, role, text, ts_ms by the configured expressions."""
    x = turns.selectExpr(*[f"{columns[c]} AS {c}" for c in ("session_id", "seq", "role", "text", "ts_ms")])
    return x.select(F.col("session_id").cast("long"), F.col("seq").cast("long"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("ts_ms").cast("long"))


def run(spark: SparkSession, turns: str, blocks: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Seals what is new; gives counts of turns read and left out, batches, and blocks written."""
    config = config or read_config()
    cfg = load(env={}, **config.get("manager", {}))
    # A file stream takes folders; by a pattern that only the table itself fits, it takes a table of one file too.
    pattern = f"{turns.rstrip('/')[:-1]}[{turns.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(spark.read.parquet(turns).schema).option("maxFilesPerTrigger", config["run"]["files_per_batch"]).parquet(pattern)
    known = F.col("session_id").isNotNull() & F.col("seq").isNotNull()
    events = as_events(stream, config["turns"]).observe("read", F.count("*").alias("turns"), F.count_if(~known).alias("left_out")).filter(known)
    out = seal.enrich(sealing.block_stream(events, cfg, keep_open=True), cfg)
    written = {"sealed": 0, "open": 0}

    def each(batch: DataFrame, number: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count_if("sealed").alias("sealed"), F.count_if(~F.col("sealed")).alias("open"))
        counted.write.mode("overwrite").partitionBy("sealed").parquet(f"{blocks}/batch={number:08d}")
        for state, n in seen.get.items():
            written[state] += n

    with sealing.with_state(spark):
        query = out.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(each).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    seen = [p["observedMetrics"]["read"] for p in query.recentProgress if "read" in p["observedMetrics"]]
    result = {"batches": sum(p["numInputRows"] > 0 for p in query.recentProgress), "turns": sum(s["turns"] for s in seen), "left_out": sum(s["left_out"] for s in seen), **written}
    log.info("read %(turns)d turns in %(batches)d batches (%(left_out)d left out); wrote %(sealed)d sealed and %(open)d open blocks", result)
    return result


def current(spark: SparkSession, blocks: str) -> DataFrame:
    """Every block as the last batch that touched it left it."""
    x = spark.read.parquet(blocks).withColumn("sealed", F.col("sealed").cast("boolean"))
    newest = Window.partitionBy("block_id").orderBy(F.desc("batch"), F.desc("sealed"))
    return x.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("turns", "blocks", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    a = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("seal_conversations").getOrCreate()
    try:
        run(spark, a.turns, a.blocks, a.checkpoint, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
