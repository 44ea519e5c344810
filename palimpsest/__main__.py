"""Command line: python -m palimpsest ingest FILE TABLES | ask TABLES QUERY... | stats TABLES"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import diagnostics
from palimpsest.plans.engine import Engine
from palimpsest.sources import config, events


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    parser.add_argument("--config", help="TOML file")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest", help="read events and add them to the tables")
    p.add_argument("file")
    p.add_argument("tables")
    p.add_argument("--format", default="auto", choices=["auto", "txt", "json", "jsonl"])
    p.add_argument("--split", default="paragraph", choices=["paragraph", "line"])
    p.add_argument("--role", default="user")
    p.add_argument("--limit", type=int)
    p.add_argument("--seal-every", type=int)
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("ask", help="answer queries with text contexts")
    p.add_argument("tables")
    p.add_argument("query", nargs="+")
    p = sub.add_parser("stats", help="counters")
    p.add_argument("tables")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    engine = Engine(spark, config.load(a.config))
    if a.command == "ingest":
        good, bad = events.read_events(spark, a.file, a.format, a.split, a.role, limit=a.limit)
        for r in events.ingest_summary(good, bad).orderBy("source").collect():
            print(f"{r.source}: {r.records} records, {r.skipped} skipped")
        if not a.dry_run:
            # A file is a session; it is added to what is there, or takes its own place again.
            own = good.select(F.xxhash64("source").alias("session_id"), F.col("ordinal").alias("seq"), "role", "text", "ts_ms")
            print(f"{engine.append(own, a.tables, a.seal_every, renew=True)} sessions added or renewed")
        return
    kept = engine.kept(a.tables)
    log = kept.events
    if a.command == "stats":
        diagnostics.conversation_stats(log).show(truncate=False)
        return
    last = log.groupBy().agg(F.max_by("session_id", "ts_ms").alias("s")).first().s
    asked = spark.createDataFrame([(i, last, q) for i, q in enumerate(a.query)], "query_id bigint, session_id bigint, query string")
    for r in engine.context(asked, kept).orderBy("query_id").collect():
        print(r.formatted)


if __name__ == "__main__":
    main()
