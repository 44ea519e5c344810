"""The relation queue: proposals of a model, block by block, into the kept edge table; what cannot be read goes to dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import relations
from palimpsest.sources import tables
from palimpsest.sources.config import DEFAULT, Config
from palimpsest.storage import durable

PROPOSED = "array<struct<src: string, dst: string, type: string, confidence: double>>"
DEAD = "block_id string, payload string, ts_ms bigint, reason string"


def split(proposals: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(edges, dead letters) of proposals (block_id, payload, ts_ms); a payload is a JSON list of relations.

    Of a payload that can be read, relations that do not hold are left out, as validated and normalized say; the
    strongest of a key counts, at the newest time that it was proposed.
    """
    x = proposals.select("block_id", "payload", "ts_ms").withColumn("p", F.from_json("payload", PROPOSED))
    reason = F.when(F.col("block_id").isNull(), "no block").when(F.col("payload").isNull(), "no payload").when(F.col("p").isNull(), "not a list of relations")
    x = x.withColumn("reason", reason)
    each = x.filter("reason is null").select(F.col("block_id").alias("current_id"), "ts_ms", F.explode("p").alias("r")).filter("r is not null").select("current_id", "ts_ms", "r.*")
    good = relations.normalized(relations.validated(each), cfg.relation_min_confidence)
    # The times go by the ends as they were proposed.
    times = each.groupBy(F.trim(F.coalesce("src", F.lit(""))).alias("src"), F.trim(F.coalesce("dst", "current_id")).alias("dst")).agg(F.max("ts_ms").alias("ts_ms"))
    edges = good.join(times, ["src", "dst"]).select("src", "dst", "type", "ts_ms", "confidence")
    return edges, x.filter("reason is not null").select("block_id", "payload", "ts_ms", "reason")


def queue(at: str, cfg: Config = DEFAULT) -> Callable[[DataFrame, int], None]:
    """A batch function for foreachBatch: edges are stored before the batch counts as done, and a batch that comes again changes nothing.

    Edges are upserted by (src, dst, type) into the kept table; dead letters of a batch are a folder of its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        edges, dead = split(durable(batch), cfg)
        dead.write.mode("overwrite").parquet(f"{at}/dead_letters/batch={number}")
        tables.upsert_kept(batch.sparkSession, at, "relations", edges)

    return each


def dead_letters(spark: SparkSession, at: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"{DEAD}, batch int").parquet(f"{at}/dead_letters")
    except AnalysisException:
        return spark.createDataFrame([], f"{DEAD}, batch int")
