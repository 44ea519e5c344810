"""Reading role-tagged events from text, JSON and JSON-lines files.

Files are told apart by suffix.  Lines are numbered in their file by the reader's own order within the file
part, and JSON rows by their place; ordinals make the time of rows without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import words
from palimpsest.functions.text import SPACE

SCHEMA = "source string, ordinal bigint, event_id string, role string, text string, ts_ms bigint, metadata string"
_TRIM = f"^{SPACE}+|{SPACE}+$"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, _TRIM, "")


def format_of(path: str, fmt: str = "auto") -> str:
    if fmt != "auto":
        return fmt
    low = path.lower()
    return "json" if low.endswith(".json") else "jsonl" if low.endswith((".jsonl", ".ndjson")) else "txt"


def text_items(df: DataFrame, key: str, content: str, split: str = "paragraph", role: str = "user", base_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of whole texts: paragraphs or lines, trimmed; empty ones are rejected."""
    pattern = r"\r?\n" if split == "line" else r"\r?\n(?:\s*\r?\n)+"
    x = df.select(F.col(key).cast("string").alias("source"), F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), pattern)).alias("_i", "_raw"))
    x = x.withColumn("text", trimmed(F.col("_raw"))).withColumn("_ok", F.col("text") != "")
    order = Window.partitionBy("source").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("ordinal", F.coalesce(F.sum(F.col("_ok").cast("long")).over(order), F.lit(0)))
    events = x.filter("_ok").select("source", "ordinal", F.concat_ws("#", "source", "ordinal").alias("event_id"), F.lit(role).alias("role"), "text", (F.col("ordinal") + base_ms).alias("ts_ms"), F.lit(None).cast("string").alias("metadata"))
    return events, x.filter("not _ok").select("source", F.col("_i").cast("long").alias("ordinal"), F.lit("empty").alias("reason"))


def _string(v: Column, key: str) -> Column:
    """Non-empty trimmed string under the key, or its array's strings joined by line ends."""
    value = F.try_variant_get(v, f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    one = F.when(kind == "STRING", trimmed(F.try_variant_get(v, f"$.{key}", "string")))
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, f"$.{key}", "array<variant>"))
    parts = F.filter(F.transform(items, lambda i: F.when(F.schema_of_variant(i) == "STRING", trimmed(F.try_variant_get(i, "$", "string")))), lambda s: s.isNotNull() & (s != ""))
    many = F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
    return F.coalesce(F.when(one != "", one), many)


def numeric_ms(x: Column) -> Column:
    """Seconds up to ten digits become milliseconds; the fraction is cut."""
    return F.when((F.abs(x) > 0) & (F.abs(x) <= 9_999_999_999), (x * 1000)).otherwise(x).cast("long")


def _time(v: Column, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    raw = F.try_variant_get(v, f"$.{key}", "string")
    number = F.when(kind.isin("BIGINT", "DOUBLE", "TINYINT", "SMALLINT", "INT") | kind.startswith("DECIMAL") | (kind == "STRING"), raw.try_cast("double"))
    date = F.when((kind == "STRING") & number.isNull(), F.unix_millis(F.try_to_timestamp(trimmed(raw))))
    return F.coalesce(F.when(~F.isnan(number) & (F.abs(number) < float("inf")), numeric_ms(number)), date)


def _unique(*keys: str) -> list[str]:
    return list(dict.fromkeys(keys))


def normalized(rows: DataFrame, text_field: str = "text", role_field: str = "role", time_field: str = "timestamp", default_role: str = "user", base_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of rows (source, ordinal from 1, v: variant; null v: malformed)."""
    v, kind = F.col("v"), F.schema_of_variant("v")
    as_text = F.when(kind == "STRING", trimmed(F.try_variant_get(v, "$", "string")))
    record = kind.startswith("OBJECT")
    text = F.coalesce(F.when(as_text != "", as_text), F.when(record, F.coalesce(*[_string(v, k) for k in _unique(text_field, "text", "content", "message")])))
    roles = [F.lower(trimmed(F.try_variant_get(v, f"$.{k}", "string"))) for k in _unique(role_field, "role")]
    role = F.coalesce(*[F.when(record & r.isin(*words.ROLES), r) for r in roles], F.lit(default_role))
    ts = F.coalesce(F.when(record, F.coalesce(*[_time(v, k) for k in _unique(time_field, "timestamp", "time", "createdAt", "created_at")])), F.col("ordinal") + base_ms)
    known = _unique(text_field, role_field, time_field, "text", "role", "timestamp")
    residue = F.map_filter(F.when(record, F.try_variant_get(v, "$", "map<string,variant>")), lambda k, _: ~k.isin(*known))
    metadata = F.when(F.size(residue) > 0, F.to_json(residue))
    reason = F.when(F.col("v").isNull(), "malformed").when(as_text == "", "empty").when(~record & as_text.isNull(), "unsupported").when(text.isNull(), "no text")
    x = rows.select("source", "ordinal", role.alias("role"), text.alias("text"), ts.alias("ts_ms"), metadata.alias("metadata"), reason.alias("reason"))
    events = x.filter("reason is null").select("source", "ordinal", F.concat_ws("#", "source", "ordinal").alias("event_id"), "role", "text", "ts_ms", "metadata")
    return events, x.filter("reason is not null").select("source", "ordinal", "reason")


def json_rows(df: DataFrame, key: str, content: str) -> DataFrame:
    """(source, ordinal, v) of whole JSON texts: the root array, its rows, records or items, or the one value."""
    v = F.try_parse_json(F.col(content))
    listed = [F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")).startswith("ARRAY"), F.try_variant_get(v, p, "array<variant>")) for p in ("$.rows", "$.records", "$.items")]
    root = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    rows = F.coalesce(root, *listed, F.array(v))
    return df.select(F.col(key).cast("string").alias("source"), F.posexplode(rows).alias("_i", "v")).select("source", (F.col("_i") + 1).cast("long").alias("ordinal"), "v")


def jsonl_rows(df: DataFrame, key: str, ordinal: str, line: str) -> DataFrame:
    """(source, ordinal, v) of lines; blank ones are left out, malformed ones have no v."""
    x = df.filter(trimmed(F.col(line)) != "")
    return x.select(F.col(key).cast("string").alias("source"), F.col(ordinal).cast("long").alias("ordinal"), F.try_parse_json(F.col(line)).alias("v"))


def read_events(spark: SparkSession, path: str, fmt: str = "auto", split: str = "paragraph", default_role: str = "user", base_ms: int = 0, limit: int | None = None, **fields) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a file or folder; events have SCHEMA.  limit keeps the first records of each file."""
    kind = format_of(path, fmt)
    file = F.col("_metadata.file_path")
    if kind == "jsonl":
        # Positions inside a file grow with the reader's row order; ranks over them number the lines.
        lines = spark.read.text(path).select(file.alias("source"), "value", F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
        order = Window.partitionBy("source").orderBy("_b", "_m")
        rows = jsonl_rows(lines.withColumn("ordinal", F.row_number().over(order)), "source", "ordinal", "value")
        events, rejects = normalized(rows, default_role=default_role, base_ms=base_ms, **fields)
    else:
        whole = spark.read.text(path, wholetext=True).select(file.alias("source"), "value")
        if kind == "json":
            events, rejects = normalized(json_rows(whole, "source", "value"), default_role=default_role, base_ms=base_ms, **fields)
        else:
            events, rejects = text_items(whole, "source", "value", split, default_role, base_ms)
    if limit is not None:
        events = events.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("ordinal"))).filter(F.col("_n") <= limit).drop("_n")
    return events, rejects


def ingest_summary(events: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row a source: records, skipped."""
    a = events.groupBy("source").agg(F.count("*").alias("records"), F.lit(0).cast("long").alias("skipped"))
    b = rejects.groupBy("source").agg(F.lit(0).cast("long").alias("records"), F.count("*").alias("skipped"))
    return a.union(b).groupBy("source").agg(F.sum("records").alias("records"), F.sum("skipped").alias("skipped"))
