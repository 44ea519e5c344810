"""Reliable checkpoints in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own.  Where neither is set, as in tests, a folder of its own, but only in a local session."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = at or tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for what is planned and run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
