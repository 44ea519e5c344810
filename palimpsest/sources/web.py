"""Web payloads: HTML to text, and search results from JSON answers of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import squeezed

# Entities in the order in which they are replaced.
ENTITIES = ((r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), (r"(?i)&#39;", "'"), (r"(?i)&#x27;", "'"))


def _plain(x: Column) -> Column:
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for pattern, to in ENTITIES:
        x = F.regexp_replace(x, pattern, to)
    return squeezed(x)


def html_text(html: Column | str, max_chars: int = 20_000) -> Column:
    """struct(title, content): without scripts and styles, of the body if there is one; title null if empty."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    for name in ("script", "style", "noscript"):
        h = F.regexp_replace(h, rf"(?is)<{name}.*?</{name}>", " ")
    title = _plain(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = r"(?is)<body[^>]*>(.*?)</body>"
    # An empty body and no body both extract as an empty string; only the latter falls back to the page.
    text = _plain(F.when(h.rlike(body), F.regexp_extract(h, body, 1)).otherwise(h))
    return F.struct(F.when(title != "", title).alias("title"), F.left(text, F.lit(max(512, max_chars))).alias("content"))


def plain_text(content: Column | str, max_chars: int = 20_000) -> Column:
    return F.left(squeezed(content), F.lit(max(512, max_chars)))


def search_results(df: DataFrame, keys: list[str], payload: str, provider: str = "search", fetched_ms: int = 0) -> DataFrame:
    """keys, title, url, snippet, source, rank, fetched_ms of the first shape with items; rank is the place."""
    v = F.try_parse_json(F.col(payload))
    shapes = ("$.results", "$.items", "$.webPages.value", "$.data.results", "$.data.webPages.value")
    lists = [F.filter(F.try_variant_get(v, p, "array<variant>"), lambda i: F.schema_of_variant(i).startswith("OBJECT")) for p in shapes]
    items = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<variant>"))
    x = df.select(*keys, F.posexplode(items).alias("_i", "_v"))

    def first(*names: str) -> Column:
        found = [F.when(F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{n}", "variant")) == "STRING", F.trim(F.try_variant_get(F.col("_v"), f"$.{n}", "string"))) for n in names]
        return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))

    source = first("source", "siteName", "provider")
    x = x.select(
        *keys, first("title", "name", "heading").alias("title"), first("url", "link", "targetUrl").alias("url"), first("snippet", "summary", "description").alias("snippet"),
        F.when(source == "", provider).otherwise(source).alias("source"), (F.col("_i") + 1).cast("long").alias("rank"), F.lit(fetched_ms).cast("long").alias("fetched_ms"),
    )
    return x.filter((F.col("url") != "") & ((F.col("title") != "") | (F.col("snippet") != "")))


def dedupe_by_url(records: DataFrame, keys: list[str], top_k: int) -> DataFrame:
    """The lowest rank of each url (first title on ties), then the top_k by rank and url."""
    from pyspark.sql import Window

    best = records.groupBy(*keys, "url").agg(F.min(F.struct("rank", "title", "snippet")).alias("_b"))
    x = best.select(*keys, "url", "_b.rank", "_b.title", "_b.snippet")
    w = Window.partitionBy(*keys).orderBy("rank", "url")
    return x.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= top_k)
