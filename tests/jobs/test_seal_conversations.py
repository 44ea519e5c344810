"""Two and more runs over a table that grows by files."""

import shutil

from pyspark.sql import functions as F

from jobs import seal_conversations as J
from palimpsest.operators import seal
from palimpsest.sources.config import load

CONFIG = J.read_config() | {"manager": {"max_tokens_per_block": 120, "min_tokens_per_block": 40}}
TURNS = "conv_id long, turn long, role string, text string"


def wanted(spark, turns):
    cfg = load(env={}, **CONFIG["manager"])
    e = J.as_events(turns, CONFIG["turns"]).filter("session_id is not null and seq is not null")
    x = seal.to_blocks(seal.assign_blocks(e, cfg))
    return {r.block_id: (r.start_ms, r.end_ms, r.token_count, tuple(r.raw_events)) for r in x.collect()}


def found(spark, at):
    rows = J.current(spark, at).collect()
    assert len({r.block_id for r in rows}) == len(rows)
    return {r.block_id: (r.start_ms, r.end_ms, r.token_count, tuple(r.raw_events)) for r in rows}, {r.block_id for r in rows if r.sealed}


def test_growing_input(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    folder, out, checkpoint = f"{tmp_path}/turns.parquet", f"{tmp_path}/blocks", f"{tmp_path}/checkpoint"
    odd = spark.createDataFrame([(None, 1, "user", "lost"), (1, None, "user", "lost"), (9001, 0, None, None), (9002, 0, "user", "x" * 300_000), (9002, 1, "user", "next")], TURNS)
    arrivals = [turns.filter("turn < 2"), turns.filter("turn in (2, 3)").unionByName(odd), turns.filter("turn > 3")]
    total, before = None, set()
    for k, part in enumerate(arrivals):
        part.coalesce(2).write.mode("append").parquet(folder)
        counts = J.run(spark, folder, out, checkpoint, CONFIG)
        assert counts["turns"] == part.count() and counts["left_out"] == (2 if k == 1 else 0) and counts["batches"] == 1
        total = part if total is None else total.unionByName(part)
        got, sealed = found(spark, out)
        assert got == wanted(spark, total) and before <= sealed
        assert counts["sealed"] == len(sealed - before)  # a sealed block is written once
        before = sealed
    assert J.run(spark, folder, out, checkpoint, CONFIG) == {"batches": 0, "turns": 0, "left_out": 0, "sealed": 0, "open": 0}
    assert found(spark, out)[0] == got
    assert {c for c in spark.read.parquet(out).columns} >= {"summary", "keywords", "tags", "embedding", "batch", "sealed"}


def test_a_batch_that_is_repeated_replaces_itself(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    folder, out, checkpoint = f"{tmp_path}/turns", f"{tmp_path}/blocks", f"{tmp_path}/checkpoint"
    turns.filter("turn < 2").write.parquet(folder)
    J.run(spark, folder, out, checkpoint, CONFIG)
    turns.filter("turn >= 2").write.mode("append").parquet(folder)
    J.run(spark, folder, out, checkpoint, CONFIG)
    got = found(spark, out)
    (tmp_path / "checkpoint/commits/1").unlink()  # as if it had failed after its output was written
    (tmp_path / "checkpoint/commits/.1.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "blocks/batch=00000001/sealed=false")
    J.run(spark, folder, out, checkpoint, CONFIG)
    assert found(spark, out) == got == (wanted(spark, turns), got[1])


def test_several_batches_in_one_run(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"words of turn {t} " * 9) for c in range(12) for t in range(20)]
    turns = spark.createDataFrame(rows, TURNS)
    for t in range(0, 20, 5):
        turns.filter(f"turn >= {t} and turn < {t + 5}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
    config = CONFIG | {"run": {"files_per_batch": 1}}
    counts = J.run(spark, f"{tmp_path}/turns", f"{tmp_path}/blocks", f"{tmp_path}/checkpoint", config)
    assert counts["batches"] == 4 and counts["turns"] == 240
    assert found(spark, f"{tmp_path}/blocks")[0] == wanted(spark, turns)
    assert spark.read.parquet(f"{tmp_path}/blocks").select(F.count_distinct("batch")).first()[0] == 4


def test_command_line(sf, tmp_path, monkeypatch, spark):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    J.main(["--turns", f"{sf}/conversations.parquet", "--blocks", f"{tmp_path}/b", "--checkpoint", f"{tmp_path}/c"])
    assert found(spark, f"{tmp_path}/b")[0]
