"""Blocks out of a stream: the batch's blocks, each once; idle sessions close by timer, without a next event."""

from pyspark.sql import functions as F

from palimpsest.operators import seal
from palimpsest.plans import base
from palimpsest.sources.config import load
from palimpsest.streaming import sealing

CFG = load(env={}, max_tokens_per_block=120, min_tokens_per_block=40)
EVENTS = "session_id long, seq long, role string, text string, ts_ms long"
KEY = ["block_id", "start_ms", "end_ms", "token_count", "raw_events"]
DAY = 1_704_067_200_000


def drive(stream, tmp_path, mode="append"):
    def each(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{tmp_path}/out/n={number}")

    with sealing.with_state(stream.sparkSession):
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").outputMode(mode).trigger(availableNow=True).foreachBatch(each).start()
        q.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{tmp_path}/out").orderBy("batch", "block_id").collect()
    return rows


def source(spark, tmp_path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def arrive(spark, rows, tmp_path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def same(rows, batch):
    want = {r.block_id: tuple(r[c] for c in KEY) for r in seal.to_blocks(batch).collect()}
    return {r.block_id: tuple(r[c] for c in KEY) for r in rows} == want and len(rows) == len(want)


def test_each_block_once_and_the_last_by_timer(spark, sf, tmp_path):
    e = base.events(spark, sf)
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = drive(sealing.block_stream(source(spark, tmp_path), CFG, late="10 minutes"), tmp_path)
    assert all(r.sealed for r in rows) and {r.batch for r in rows} == {0, 1}
    x = seal.assign_blocks(e, CFG)
    newest = x.agg(F.max(F.struct("ts_ms", "session_id", "block_seq")).alias("m")).first().m  # within the lateness, so still open
    assert same(rows, x.filter((F.col("session_id") != newest.session_id) | (F.col("block_seq") != newest.block_seq)))


def test_idle_block_closes_without_a_next_event_and_the_next_one_opens_another(spark, tmp_path):
    short = lambda s, n, ms: (s, n, "user", f"few words {n}", DAY + ms)
    arrive(spark, [short(1, 0, 0), short(1, 1, 1000), short(2, 0, 2000)], tmp_path)
    rows = drive(sealing.block_stream(source(spark, tmp_path), CFG, late="1 minute"), tmp_path)
    assert rows == []
    # Another session moves the watermark to 301 s: session 1 (last at 1 s) is idle for 300 s, session 2 is not quite.
    arrive(spark, [short(3, 0, 361_500)], tmp_path)
    rows = drive(sealing.block_stream(source(spark, tmp_path), CFG, late="1 minute"), tmp_path)
    assert [(r.session_id, r.block_seq, len(r.raw_events)) for r in rows] == [(1, 0, 2)]
    # An event of session 2 in time moves its timer; session 1 opens its second block.
    arrive(spark, [short(2, 1, 301_900), short(1, 2, 310_000)], tmp_path)
    drive(sealing.block_stream(source(spark, tmp_path), CFG, late="1 minute"), tmp_path)
    arrive(spark, [short(3, 1, 2_000_000)], tmp_path)
    rows = drive(sealing.block_stream(source(spark, tmp_path), CFG, late="1 minute"), tmp_path)
    assert sorted((r.session_id, r.block_seq, len(r.raw_events)) for r in rows) == [(1, 0, 2), (1, 1, 1), (2, 0, 2), (3, 0, 1)]


def test_open_blocks_come_with_each_batch_that_touches_them(spark, tmp_path):
    for n in range(3):
        arrive(spark, [(s, n, "user", "long words of one turn " * 6, DAY + n * 1000) for s in (1, 2)], tmp_path)
    rows = drive(sealing.block_stream(source(spark, tmp_path), CFG, keep_open=True), tmp_path, "update")
    assert {(r.batch, r.session_id, r.block_seq, r.sealed, len(r.raw_events)) for r in rows if r.session_id == 1} >= {(0, 1, 0, False, 1), (1, 1, 0, False, 2)}
    closed = [r.block_id for r in rows if r.sealed]
    assert len(closed) == len(set(closed))


def test_null_text_and_time(spark, tmp_path):
    arrive(spark, [(1, 0, "user", None, None), (1, 1, "user", "", DAY), (1, 2, None, "x", None)], tmp_path)
    rows = drive(sealing.block_stream(source(spark, tmp_path), CFG, keep_open=True), tmp_path, "update")
    last = max(rows, key=lambda r: (r.block_seq, r.sealed))
    assert [e.ts_ms for e in last.raw_events][-1] > DAY or last.block_seq == 0
