"""From ranked blocks to a text context: event backtracking, evidence, recent events, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def refs(ranked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block references of ranked hits (query_id, block_id, score, rank): the only place where wide columns are joined."""
    cols = ["block_id", "summary", "start_ms", "end_ms", "keywords", "tags", "raw_events", "retention_mode", "match_score", "conflict"]
    return ranked.join(blocks.select(*cols), "block_id").withColumn("source", F.lit("fusion"))


def backtracked(found: DataFrame, raw: DataFrame) -> DataFrame:
    """References without events of their own get the stored ones, or none."""
    x = found.join(raw.select("block_id", F.col("events").alias("_e")), "block_id", "left")
    empty = F.array().cast(found.schema["raw_events"].dataType)
    return x.withColumn("raw_events", F.when(F.size("raw_events") > 0, F.col("raw_events")).otherwise(F.coalesce("_e", empty))).drop("_e")


def recent(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each session in arrival order, oldest first: session_id, recent."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    x = events.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    e = F.struct("seq", "role", "text", "ts_ms")
    return x.groupBy("session_id").agg(F.array_sort(F.collect_list(e)).alias("recent"))


def evidence(events: Column) -> Column:
    """Up to three events, users first, each cut at 300 characters."""
    return F.array_join(F.transform(T.users_first(events, 3), lambda e: F.concat(F.lit("- "), e["role"], F.lit(": "), T.clipped(T.squeezed(e["text"]), 300, "..."))), "\n")


def _block(b: Column, i: Column) -> Column:
    head = F.concat(
        F.lit("#"), (i + 1).cast("string"), F.lit(" ["), b["block_id"], F.lit("] score="), T.fixed3(b["score"]), F.lit(" retention="), F.coalesce(b["retention_mode"], F.lit("raw")),
        F.lit(" match="), T.fixed3(F.coalesce(b["match_score"], F.lit(0.0))), F.lit(" tags="), F.array_join(F.coalesce(b["tags"], F.array(F.lit("normal"))), "|"),
    )
    text = F.concat(head, F.lit("\nsummary: "), F.when(F.coalesce(b["summary"], F.lit("")) == "", "<empty>").otherwise(b["summary"]))
    return F.when(F.size(b["raw_events"]) > 0, F.concat(text, F.lit("\nevidence:\n"), evidence(b["raw_events"]))).otherwise(text)


def assemble(queries: DataFrame, found: DataFrame, recents: DataFrame | None = None, intents: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """query_id, formatted: retrieved blocks, recent events, and prediction and signal if there are any.

    queries: query_id, session_id; found: references with their rank; intents: query_id, block_id,
    confidence, rank, label, active; signals: query_id, allow, mode, reason, hint, source.
    """
    b = F.struct("rank", "block_id", "score", "retention_mode", "match_score", "tags", "summary", "raw_events")
    x = queries.select("query_id", "session_id").join(found.groupBy("query_id").agg(F.array_sort(F.collect_list(b)).alias("blocks")), "query_id", "left")
    lines = F.concat(F.array(F.lit("=== RETRIEVED BLOCKS ===")), F.coalesce(F.transform("blocks", _block), F.array().cast("array<string>")), F.array(F.lit(""), F.lit("=== RECENT EVENTS ===")))
    if recents is not None:
        x = x.join(recents, "session_id", "left")
        line = F.transform("recent", lambda e: F.concat(T.iso(e["ts_ms"]), F.lit(" "), F.upper(e["role"]), F.lit(": "), e["text"]))
        lines = F.concat(lines, F.coalesce(line, F.array().cast("array<string>")))
    lines = F.concat(lines, F.array(F.lit("")))
    none = F.array().cast("array<string>")
    intent = lambda name: lambda e, i: F.concat(F.lit(f"{name}#"), (i + 1).cast("string"), F.lit(" block="), e["block_id"], F.lit(" conf="), T.fixed3(e["confidence"]), F.lit(" label="), e["label"])
    if intents is not None:
        p = intents.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block_id", "confidence", "label"))).alias("intents"), F.max("active").alias("active"))
        x = x.join(p, "query_id", "left")
        own = F.concat(F.array(F.lit("=== PREDICTION ==="), F.concat(F.lit("activeTrigger="), F.col("active").cast("string"))), F.transform("intents", intent("intent")))
        lines = F.concat(lines, F.when(F.col("intents").isNotNull(), own).otherwise(none))
    if signals is not None:
        x = x.join(signals, "query_id", "left")
        fields = [F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("allowWakeup", "allow"), ("mode", "mode"), ("reason", "reason"), ("evidenceNeedHint", "hint"), ("triggerSource", "source"))]
        own = F.concat(F.array(F.lit("=== PROACTIVE SIGNAL ===")), F.array(*fields))
        gap = F.when(F.col("intents").isNotNull(), F.array(F.lit(""))).otherwise(none) if intents is not None else none
        lines = F.concat(lines, F.when(F.col("reason").isNotNull(), F.concat(gap, own)).otherwise(none))
    return x.select("query_id", F.array_join(lines, "\n").alias("formatted"))


def history_query(found: DataFrame, top: int = 8, include_raw: bool = False, max_chars: int = 4000) -> DataFrame:
    """What a history query answers: the first references, their event counts, events on request, summaries cut."""
    x = found.filter(F.col("rank") <= top)
    out = x.select("query_id", "rank", "block_id", "score", F.left("summary", F.lit(max_chars)).alias("summary"), "start_ms", "end_ms", "keywords", "tags", "retention_mode", F.size("raw_events").cast("long").alias("raw_event_count"), *(["raw_events"] if include_raw else []))
    return out


def search_plan(queries: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """query_id, searches: the query itself, then what shares the least prefix with it, most in all.

    Candidates are the summaries of the first three blocks, cut at 60 characters, and four keywords of the
    first; without a block, three keywords of the query.
    """
    b = found.filter(F.col("rank") <= 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "summary", "keywords"))).alias("_b"))
    none = F.array().cast("array<string>")
    x = queries.select("query_id", "query", T.keywords("query", 3).alias("_k")).join(b, "query_id", "left")
    parts = F.concat(F.transform("_b", lambda e: F.trim(F.left(e["summary"], F.lit(60)))), F.slice(F.coalesce(F.element_at("_b", 1)["keywords"], none), 1, 4))
    own = F.when(F.col("_b").isNull(), F.col("_k")).otherwise(parts)
    own = F.array_except(F.filter(F.array_distinct(own), lambda c: c.isNotNull() & (c != "")), F.array("query"))
    placed = F.array_sort(F.transform(own, lambda c, i: F.struct(T.common_prefix(F.col("query"), c).alias("p"), i.alias("i"), c.alias("c"))))
    return x.select("query_id", F.slice(F.concat(F.array("query"), F.transform(placed, lambda e: e["c"])), 1, most).alias("searches"))
