"""The registered queries over the driver's tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, fingerprints, hard_negatives, langid, mixing, neardup, ngram_lm, quality, repeats, toxicity, warc
from .shared import freed, saved, table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels.filter(~quality.held_out())))


@freed
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_other: another document's fingerprint lies within the radius, found by the block tables."""
    x = saved(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")))
    each = x.groupBy("fp").agg(F.count("*").alias("_n"))
    near = fingerprints.has_near(saved(each.select("fp"))).withColumn("_near", F.lit(True))
    each = each.join(near, "fp", "left").select("fp", ((F.col("_n") > 1) | F.coalesce("_near", F.lit(False))).alias("near_other"))
    name = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return x.join(saved(each), "fp").select("doc_id", "n_chars", "edited_sha256", name("fp").alias("fingerprint"), name("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "near_other")


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams; rounded, as the order in which logarithms are added differs from the SQL's."""
    x = ngram_lm.scores(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_tokens", F.round("score", 4).alias("score"), F.round("mean_score", 8).alias("mean_score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~quality.held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.labelled(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_ngram_lm": op7_ngram_lm,
    "op8_quality": op8_quality,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash_neardup": op10_simhash_neardup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_id": op12_language_id,
}
ORACLES: dict[str, str] = {"op2_warc_round_trip": warc.ORACLE, "op4_exact_dedup": exact.ORACLE, "op7_ngram_lm": ngram_lm.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
