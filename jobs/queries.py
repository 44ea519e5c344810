"""The jobs as registered queries: each runs twice into one new folder, and returns the output as the second run leaves it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import index, seal
from palimpsest.plans import sqltext as Q
from palimpsest.plans.q_blocks import sealed_events
from palimpsest.sources.config import load
from palimpsest.storage import checkpoint_dir

from . import index_documents, seal_conversations


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_seal_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1")
    for _ in range(2):
        seal_conversations.run(spark, f"{sf_dir}/conversations.parquet", f"{at}/blocks", f"{at}/checkpoint")
    x = seal_conversations.current(spark, f"{at}/blocks")
    text = F.md5(seal.event_text("raw_events").cast("binary"))
    return x.select("session_id", "block_seq", "block_id", "start_ms", "end_ms", "token_count", F.size("raw_events").cast("long").alias("n_events"), text.alias("text_md5"), "sealed")


def job2_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index")
    return index.live(spark, f"{at}/index", "postings").select("key", "indexed", "own", "block_id", F.col("block_seq").alias("doc_id"), "size", "batch")


_CFG = load(env={}, **seal_conversations.read_config()["manager"])
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_seal_conversations": job1_seal_conversations, "job2_index_documents": job2_index_documents}
ORACLES: dict[str, str] = {
    "job1_seal_conversations": f"""{sealed_events(_CFG)},
b AS (SELECT session_id, block_seq, min(t) AS start_ms, max(t) AS end_ms, sum(tokens)::BIGINT AS token_count, count(*) AS n_events, md5(string_agg(text, ' ' ORDER BY seq)) AS text_md5 FROM f GROUP BY ALL)
SELECT session_id, block_seq, 'block_' || lpad(session_id::VARCHAR, 10, '0') || '_' || lpad(block_seq::VARCHAR, 6, '0') AS block_id, start_ms, end_ms, token_count, n_events, text_md5,
block_seq < max(block_seq) OVER (PARTITION BY session_id) OR token_count >= {int(_CFG.max_tokens_per_block * 1.5)} AS sealed FROM b""",
    "job2_index_documents": f"""WITH src AS (SELECT doc_id, max_by(text, h) AS text FROM (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id IS NOT NULL) GROUP BY doc_id),
{Q.keywords("dk", "src", "doc_id", "text", index_documents.read_config()["index"]["keywords"])}
SELECT DISTINCT unnest(keywords) AS key, true AS indexed, true AS own, 'doc_' || lpad(doc_id::VARCHAR, 12, '0') AS block_id, doc_id, len(list_distinct(keywords))::INTEGER AS size, 1 AS batch FROM dk""",
}
