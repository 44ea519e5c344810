"""A keyword index of a document table, kept up to date: each run takes the documents that are new, changed or gone.

    python -m jobs.index_documents --documents PATH --index PATH [--config FILE]

The mark of what is known is the index's own table of members: id and content hash of every document in it.
A run hashes all texts, works out keywords of new and changed ones only, and writes one batch: postings
partitioned by batch and by a hash of the key, removals, members.  A run over an unchanged table writes nothing.
Documents without an id are counted and left out; null texts are empty; of several texts under one id the one
with the greatest hash counts.
"""

from __future__ import annotations

import argparse
import logging
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import index
from palimpsest.sources import tables

log = logging.getLogger("jobs.index_documents")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "index_documents.toml")


def read_config(path: str = CONFIG) -> dict:
    """Tables [documents] (columns as SQL expressions) and [index]."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def as_blocks(documents: DataFrame, config: dict) -> DataFrame:
    """block_id, block_seq, hash, keywords; keywords are worked out only where they are used."""
    c = config["documents"]
    x = documents.selectExpr(f"{c['id']} AS block_seq", f"{c['text']} AS text").filter("block_seq is not null")
    x = x.select(F.format_string("doc_%012d", F.col("block_seq").cast("long")).alias("block_id"), F.col("block_seq").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    x = tables.latest(x.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)), ["block_id"], "hash")
    return x.withColumn("keywords", T.keywords("text", config["index"]["keywords"])).drop("text")


def run(spark: SparkSession, documents: str, at: str, config: dict | None = None) -> dict[str, int]:
    """Brings the index at a folder up to the documents; counts of rows read and left out, and of documents new, changed and gone."""
    config = config or read_config()
    docs = spark.read.parquet(documents)
    read, without = docs.selectExpr("count(*)", f"count_if({config['documents']['id']} IS NULL)").first()
    counts = index.update(spark, at, as_blocks(docs, config), whole=True, parts=config["index"]["parts"])
    result = {"read": read, "left_out": without, **counts}
    log.info("read %(read)d documents (%(left_out)d left out); indexed %(new)d new and %(changed)d changed ones, removed %(gone)d", result)
    return result


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--documents", required=True)
    parser.add_argument("--index", required=True)
    parser.add_argument("--config", default=CONFIG)
    a = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    try:
        run(spark, a.documents, a.index, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
