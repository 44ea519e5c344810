from pyspark.sql import functions as F

from palimpsest.operators import detect, seal
from palimpsest.plans import base
from palimpsest.sources.config import load
from palimpsest.streaming import stateful

CFG = load(env={}, max_tokens_per_block=120, min_tokens_per_block=40)


def parts(spark, df, order, tmp_path, n=3):
    """Files in the order of arrival, read as a stream one at a time."""
    x = df.withColumn("_p", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy(order)))
    for i in range(1, n + 1):
        x.filter(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_sealing_stream_equals_batch(spark, sf, tmp_path):
    e = base.events(spark, sf)
    stateful.run_once(stateful.seal_stream(parts(spark, e, "seq", tmp_path), CFG), f"{tmp_path}/out", f"{tmp_path}/cp")
    key = ["session_id", "seq", "ts_ms", "block_seq"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(key).collect()))
    assert got == sorted(map(tuple, seal.assign_blocks(e, CFG).select(key).collect()))


def test_detector_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, 1000 * i, 0, 1000 * i - 10, "user", 5, [f"k{(i * s) % 4}", "x"], [float(i % 2), 1.0], [f"b{(i + s) % 3}"], [], 0.0, 0.0, True, False, False, [("b1", 0.6)] if i % 3 else [], [1.0, 0.0]) for s in range(3) for i in range(9)]
    log = spark.createDataFrame(rows, detect.LOG)
    stateful.run_once(stateful.detect_stream(parts(spark, log, "seq", tmp_path)), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, detect.detect(log).collect()))


def test_idle_session_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:04:59.999"), (1, "2024-01-01 00:09:59.999"), (1, "2024-01-03 00:00:00"), (2, "2024-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "u int, t string").select("u", F.to_timestamp("t").alias("t"))
    s = stateful.idle_session_stream(parts(spark, df, "t", tmp_path), "u", "t", 300, "1 minute")
    got = []
    stateful.run_once(s, "", f"{tmp_path}/cp", lambda b, _: got.extend(b.collect()))
    assert sorted(r.n for r in got if r.u == 1) == [1, 1, 2]  # a gap of exactly five minutes splits
    batch = seal.idle_sessions(df, "u", "t", 300)
    assert sorted(r.n for r in batch.filter("u = 1").collect()) == [1, 1, 2]


def test_window_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    got = []
    stateful.run_once(stateful.window_counts(parts(spark, e, "ts", tmp_path), "ts", ["event_type"], "value", "1 day"), "", f"{tmp_path}/cp", lambda b, _: got.extend(b.collect()))
    want = {(r.start, r.event_type): r.n for r in stateful.window_counts(e, "ts", ["event_type"], "value", "1 day").collect()}
    assert got and all(want[r.start, r.event_type] == r.n for r in got)
