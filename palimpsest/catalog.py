"""Registry of the library's own queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import q_analytics, q_blocks, q_detect, q_retrieve, q_text, registry  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["rrf_topk"](spark, sf_dir)
