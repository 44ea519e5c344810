"""The engine: events in, tables of blocks and edges, and batches of text queries answered from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.operators import chunks, context, detect, diagnostics, graph, history, relations, retrieve, seal
from palimpsest.sources import tables
from palimpsest.sources.config import DEFAULT, Config
from palimpsest.storage import durable, setting


#: Rows with embeddings go to Python a thousand at a time; shuffle files of a saved stage go when it has run.
SMALL_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
FREED = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@dataclass
class Tables:
    blocks: DataFrame
    raw: DataFrame
    edges: DataFrame
    events: DataFrame
    opened: DataFrame | None = None  # blocks that are not sealed yet, with their text


@dataclass
class Engine:
    """A façade over the operators; stages between which plans would grow too deep are checkpoints."""

    spark: SparkSession
    cfg: Config = field(default_factory=lambda: DEFAULT)

    def seal(self, events: DataFrame, seal_every: int | None = None) -> DataFrame:
        """Events to plain blocks."""
        return seal.to_blocks(seal.assign_blocks(events, self.cfg, seal_every))

    def build(self, events: DataFrame, seal_every: int | None = None, keep_open: bool = False) -> Tables:
        """All tables from events (session_id, seq, role, text, ts_ms): enriched blocks, their events, their edges.

        keep_open: the last block of each session is still being written; it is scored by its text alone.
        """
        with setting(self.spark, *SMALL_BATCHES), setting(self.spark, *FREED):
            plain, opened = durable(self.seal(events, seal_every)), None
            if keep_open:
                last = plain.groupBy("session_id").agg(F.max("block_seq").alias("block_seq"))
                opened = plain.join(last, ["session_id", "block_seq"], "left_semi").withColumn("text", seal.event_text("raw_events"))
                plain = plain.join(last, ["session_id", "block_seq"], "left_anti")
            blocks = durable(seal.enrich(plain, self.cfg))
            blocks, raw = seal.apply_retention(durable(history.retain(blocks, history.match(blocks), self.cfg)))
            return Tables(blocks, raw, durable(self.link(blocks)), events, opened)

    def link(self, blocks: DataFrame) -> DataFrame:
        """FOLLOWS edges of the sequence, then extracted ones over the minimum, which replace equal keys."""
        found = relations.normalized(relations.extract(blocks, self.cfg), self.cfg.relation_min_confidence)
        times = blocks.select(F.col("block_id").alias("dst"), F.col("end_ms").alias("ts_ms"))
        found = found.join(times, "dst").select("src", "dst", "type", "ts_ms", "confidence", F.lit(1).alias("write_seq"))
        return tables.latest_edges(seal.follows(blocks).withColumn("write_seq", F.lit(0)).unionByName(found)).drop("write_seq")

    def save(self, t: Tables, path: str) -> None:
        for name, df in (("blocks", t.blocks.select(*_names("blocks"))), ("raw_events", t.raw), ("relations", t.edges)):
            tables.save(df, path, name)

    def append(self, events: DataFrame, path: str, seal_every: int | None = None, renew: bool = False) -> int:
        """Adds events to the kept tables at a folder and works out anew the sessions that they belong to; gives the number of these.

        An event that is there (same session and seq) is replaced; with renew its whole session is.  Blocks are
        matched and linked inside their session only, so other sessions stay as they are, and in the end the
        tables are those of all events built at once.  Only hash folders with changed keys are read and rewritten.
        """
        events = durable(events.select("session_id", "seq", "role", "text", "ts_ms"))
        some = durable(events.select("session_id").distinct().withColumn("bucket", tables.bucket_of(["session_id"], tables.BUCKETS)))
        folders = [r.bucket for r in some.select("bucket").distinct().collect()]  # tables.BUCKETS numbers at most
        own = lambda name: tables.load_kept(self.spark, path, name).filter(F.col("bucket").isin(folders)).join(some, ["session_id", "bucket"], "left_semi")
        whole = durable(events if renew else tables.upsert(own("events").drop("bucket"), events, ["session_id", "seq"]))
        before = durable(own("blocks").select("block_id"))
        built = self.build(whole, seal_every)
        tables.upsert_kept(self.spark, path, "events", whole, ["session_id"])
        tables.upsert_kept(self.spark, path, "relations", built.edges, ["src"], gone=before.withColumnRenamed("block_id", "src"))
        tables.upsert_kept(self.spark, path, "raw_events", built.raw, gone=before)
        # Last, as they say which blocks a session had.
        tables.upsert_kept(self.spark, path, "blocks", built.blocks.select(*_names("blocks")), ["session_id"])
        return some.count()

    def kept(self, path: str) -> Tables:
        """The tables that append keeps."""
        blocks, raw, edges, events = (tables.load_kept(self.spark, path, n).drop("bucket") for n in ("blocks", "raw_events", "relations", "events"))
        return Tables(blocks, raw, edges, events)

    def load(self, path: str, events: DataFrame) -> Tables:
        return Tables(tables.load(self.spark, path, "blocks"), tables.load(self.spark, path, "raw_events"), tables.load(self.spark, path, "relations"), events)

    def hybrid(self, queries: DataFrame, t: Tables) -> dict[str, DataFrame]:
        """Semantic hits, graph hits of each query's own direction, and the sum of both."""
        semantic = durable(retrieve.semantic_topk(queries, t.blocks, self.cfg))
        way = queries.select("query_id", F.coalesce("intent.direction", F.lit("both")).alias("direction"), F.coalesce("intent.types", F.array().cast("array<string>")).alias("types"))
        seeds = semantic.select("query_id", F.col("block_id").alias("node")).join(way, "query_id")
        found = durable(graph.expand(seeds, t.edges, t.blocks, self.cfg.graph_expansion_top_k, depth=self.cfg.relation_depth))
        scores = retrieve.add_scores(semantic, found.select("query_id", "block_id", (F.col("score") * self.cfg.graph_weight).alias("score")))
        return {"semantic": semantic, "graph": found, "scores": scores}

    def retrieve(self, queries: DataFrame, t: Tables, boosts: DataFrame | None = None) -> dict[str, DataFrame]:
        """Ranked references of queries (query_id, session_id, query) with all parts that led to them.

        Open blocks count with their own score for queries of their session; boosts (query_id, block_id,
        boost) of prefetched predictions are added; chunk mates of good hits come behind them if configured.
        """
        with setting(self.spark, *SMALL_BATCHES), setting(self.spark, *FREED):
            q = durable(retrieve.analyzed(queries, self.cfg))
            parts = self.hybrid(q, t)
            if t.opened is not None:
                parts["scores"] = retrieve.with_open_blocks(parts["scores"], retrieve.open_block_scores(q, t.opened.select("session_id", "block_id", "text"), self.cfg))
            if boosts is not None:
                parts["scores"] = retrieve.add_scores(parts["scores"], boosts.select("query_id", "block_id", F.col("boost").alias("score")))
            last = t.blocks.groupBy("session_id").agg(F.max_by("block_id", "block_seq").alias("node"))
            seeds = parts["semantic"].select("query_id", F.col("block_id").alias("node")).unionByName(q.join(last, "session_id").select("query_id", "node"))
            predicted = graph.predict(seeds, t.blocks, t.edges, self.cfg)
            intents = durable(predicted["intents"])
            scores = durable(retrieve.boosted(parts["scores"], intents, q, self.cfg))
        ranked = retrieve.final_rank(scores, self.cfg.final_top_k)
        if self.cfg.chunk_neighbor_expand:
            ranked = chunks.expanded(ranked, scores, self.chunked(t.blocks), self.cfg)
        return parts | {"queries": q, "intents": intents, "vectors": predicted["vectors"], "boosted": scores, "ranked": ranked}

    def context(self, queries: DataFrame, t: Tables, signals: DataFrame | None = None, boosts: DataFrame | None = None) -> DataFrame:
        """query_id, formatted text context; signals (query_id, allow, mode, reason, hint, source) as signals() gives them."""
        found = self.retrieve(queries, t, boosts)
        blocks = t.blocks
        if t.opened is not None:
            rest = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in blocks.columns if c not in t.opened.columns}
            blocks = blocks.unionByName(t.opened.withColumns(rest).select(*blocks.columns))
        refs = context.backtracked(context.refs(found["ranked"], blocks), t.raw)
        return context.assemble(queries, refs, context.recent(t.events, self.cfg.recent_event_window), found["intents"], signals)

    def signals(self, queries: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
        """Signals (query_id and the detectors' columns) of queries that also have seq, now, source, and the boosts that prefetches give.

        Blocks are ranked once more with the boosts before the detectors look at them.
        """
        place = queries.select("query_id", "session_id", "seq", "source")
        boosts = durable(detect.staged(self.query_log(queries, self.retrieve(queries, t), t), self.cfg).join(place, ["session_id", "seq"]).select("query_id", "block_id", "boost"))
        log = self.query_log(queries, self.retrieve(queries, t, boosts), t)
        return detect.detect(log, self.cfg).join(place, ["session_id", "seq"]), boosts

    def query_log(self, queries: DataFrame, found: dict[str, DataFrame], t: Tables) -> DataFrame:
        """The detectors' input: one row a query with what its retrieval found.  queries also have seq, now, source."""
        q = found["queries"]
        top = found["ranked"].groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block_id"))), lambda e: e["block_id"]).alias("top_ids"))
        near = found["graph"].groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block_id"))), lambda e: e["block_id"]).alias("graph_ids"), F.avg("score").alias("graph_confidence"))
        intents = found["intents"].groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block_id", "confidence"))), lambda e: F.struct(e["block_id"].alias("block_id"), e["confidence"].alias("confidence"))).alias("intents"), F.max("active").alias("active"))
        sparse = q.select("query_id", S.keyword_sparse(F.col("query"), F.col("keywords")).alias("_s"))
        boost = found["intents"].filter("rank = 1").join(sparse, "query_id").select("query_id", S.prediction_boost(F.col("confidence"), F.col("_s"), self.cfg).alias("prediction_weight"))
        best = found["semantic"].filter("rank = 1").join(t.blocks.select("block_id", F.col("embedding").alias("top_embedding")), "block_id").select("query_id", "top_embedding")
        x = queries.select("query_id", "session_id", "seq", "now", "source").join(q.select("query_id", "query", "keywords", "embedding"), "query_id")
        x = x.withColumn("source", F.when(F.col("query") == self.cfg.timer_probe_query, "timer").otherwise(F.col("source")))
        for part in (top, near, intents, boost, best):
            x = x.join(part, "query_id", "left")
        span = t.events.groupBy("session_id").agg(F.floor(F.min("ts_ms") / 1000).alias("first"), F.floor(F.max("ts_ms") / 1000).alias("last"))
        x = x.join(span, "session_id", "left")
        return x.select(
            "session_id", "seq", "now", F.coalesce("first", "now").alias("first"), F.coalesce("last", "now").alias("last"), "source", F.size(T.tokens("query")).alias("n_tokens"), "keywords", "embedding", "top_ids", "graph_ids",
            F.coalesce("graph_confidence", F.lit(0.0)).alias("graph_confidence"), F.coalesce("prediction_weight", F.lit(0.0)).alias("prediction_weight"), F.col("intents").isNotNull().alias("predicted"), F.coalesce("active", F.lit(False)).alias("active"),
            S.keyword_sparse(F.col("query"), F.col("keywords")).alias("sparse"), "intents", "top_embedding",
        )

    def chunked(self, blocks: DataFrame) -> DataFrame:
        return chunks.positions(blocks, self.cfg)

    def stats(self, events: DataFrame) -> DataFrame:
        return diagnostics.conversation_stats(events)


def _names(name: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f.name for f in StructType.fromDDL(tables.SCHEMAS[name]).fields]
