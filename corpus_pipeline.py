"""Corpus pipeline: quality, exact duplicates, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept; run() writes every stage's
rows as Parquet to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, exact, mixing, neardup, quality
from palimpsest.llm.shared import ensure_checkpoint_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null text is scored as empty; rows of any id, null and repeated ones too, are judged by their text alone,
    so equal texts stay or go together.  Without labels all stay.  An empty table stays empty.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal without white space: the longest, of these the smallest id (null last).

    Null text is empty text, and empty texts are a group.  Repeated rows of one id and text are one document.
    """
    return exact.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints: the smallest id (null last), of its texts the smallest hash.

    Texts without a word are one component.  A document is an id with a text: repeated rows of both stay or
    go together, and another text under the same id is judged for itself.
    """
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 2 times.

    A null source is a source of its own; null and wordless texts have size 0 and take part in their
    source's document count; repeated rows are sampled each for itself.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row, with the exact round trip; null and empty texts have no token."""
    return bpe.round_trip(docs)


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_exact), ("simhash near-dedup", drop_near), ("source mix", mix_sources), ("byte-level bpe", encode)]
#: The classifier's decisions are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
