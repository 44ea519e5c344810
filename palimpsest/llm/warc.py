"""WARC archives: written by Spark's text writer, read in splits with boundary-chain verification.

The reader cuts files at the record magic, wherever it stands, so splits of one file are read by many
tasks.  Every piece is a candidate record; its header gives the offset of its successor.  Tasks shorten
the chains inside their split; pointer jumping over what is left, from the start of each file, reaches the
true records only.  A magic inside a payload is jumped over, whatever stands behind it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shipping import ship

from .shared import ensure_checkpoint_dir, saved, small_or_plain

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
M = len(MAGIC)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """_id, _sha, _first of every page whose payload of at least that many bytes a page of smaller id has.

    Null payload: empty.  Null ids come last; rows that repeat the smallest id are all responses.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = saved(pages.select(F.col(id_col).alias("_id"), F.sha1(html).alias("_sha"), F.octet_length(html).alias("_n")).filter(F.col("_n") >= least))
    groups = rows.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    return rows.join(small_or_plain(saved(groups)), "_sha").filter("_first is not null and not (_id <=> _first)").select("_id", "_sha", "_first").distinct()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A record without its last line end, which the writer puts behind it."""
    kind, body = ("response", payload) if first is None else ("revisit", b"")
    name = "none" if page_id is None else str(page_id)
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Page-Id: {name}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else f"WARC-Target-URI: {url}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>", f"X-Refers-To-Page: {first}"]
    head.append(f"Content-Length: {len(body)}")
    return MAGIC + "\r\n".join(head).encode() + END + body + b"\r\n"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Writes a record per page, in as many files as there are partitions, by Spark's own commit protocol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [record(b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py() or b"", b.column(3)[i].as_py()) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    ship(pages.sparkSession)
    seen = saved(revisits(pages, id_col, html_col, least))
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"))
    other = small_or_plain(seen.select(F.col("_id").alias("_id2"), "_sha", "_first"))
    rows = rows.join(other, F.col("_id").eqNullSafe(F.col("_id2")) & (F.sha1("_html") == F.col("_sha")), "left").select("_id", "_url", "_html", "_first")
    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n").option("compression", "none").text(path)


def _parse(content: bytes) -> tuple[int, dict[str, str]] | None:
    """Length of the header with its end, and its fields; None if there is no header with a Content-Length."""
    end = content.find(END)
    if end < 0:
        return None
    fields = {}
    for line in content[:end].decode("latin-1").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return (end + len(END), fields) if fields.get("content-length", "").isdigit() else None


def _whole(content: bytes, head: int, fields: dict[str, str]) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a complete record."""
    body = content[head : head + int(fields["content-length"])]
    kind, name, first = fields.get("warc-type"), fields.get("x-page-id", ""), fields.get("x-refers-to-page")
    page = int(name) if name.lstrip("-").isdigit() else None
    if kind == "revisit":
        return page, int(fields.get("x-payload-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:"), kind, int(first) if first else None
    return page, len(body), base32_sha1(body), kind, None


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PIECE = "file string, block long, n long, at long, size long, next long, exit long, whole boolean, " + _RECORD


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece between magics; offsets count from the split's first piece.

    at: where the piece's record begins (its magic); next: where its successor does, null without a
    header; exit: the first offset of its chain that is no candidate of this split.
    """
    key, rows, place, n = None, [], 0, 0

    def flush():
        if rows:
            known = {r["at"]: r for r in rows}
            for r in reversed(rows):
                r["exit"] = known[r["next"]]["exit"] if r["next"] in known else r["next"]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    for b in batches:
        for i in range(len(b)):
            content, now = b.column(0)[i].as_py(), (b.column(1)[i].as_py(), b.column(2)[i].as_py())
            if now != key:
                yield from flush()
                key, rows, place, n = now, [], 0, 0
            row = dict.fromkeys(_ARROW.names) | {"file": key[0], "block": key[1], "n": n, "at": place - M, "size": len(content), "whole": False}
            if parsed := _parse(content):
                head, fields = parsed
                row["next"] = place + head + int(fields["content-length"]) + len(END)
                if row["next"] == place + len(content):
                    row["whole"] = True
                    row |= dict(zip(_ARROW.names[-5:], _whole(content, head, fields), strict=True))
            rows.append(row)
            place, n = place + len(content) + M, n + 1
    yield from flush()


_ARROW = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("whole", pa.bool_()),
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def _scan(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def reached(entries: DataFrame, jumps: DataFrame, longest: int) -> DataFrame:
    """Pointer jumping: all (file, at) that chains of jumps (file, at, to) reach from entries (file, at).

    Every round doubles the length of the jumps, so log2(longest) rounds see chains of that many jumps.
    """
    seen = entries
    for k in range(max(1, longest).bit_length() + 1):
        ahead = seen.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        seen = saved(seen.union(ahead).distinct())
        if 1 << k > longest:
            break
        later = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        jumps = saved(jumps.join(later, ["file", "to"]).select("file", "at", F.col("further").alias("to")))
    return seen


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives.

    Lengths and digests of responses come from their payloads, those of revisits from their headers.
    An empty folder or an archive without a valid first record gives no row of it.
    """
    ship(spark)
    pieces = saved(_scan(spark, path).mapInArrow(_pieces, _PIECE))
    # Splits are placed by the sizes of those before them in the file.
    splits = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + M).alias("_size"))
    splits = splits.selectExpr("file", "block", "sum(_size) over (partition by file order by block) - _size as base", "count(*) over (partition by file) as many")
    splits = saved(splits)
    longest = splits.agg(F.max("many")).first()[0] or 0
    placed = pieces.join(small_or_plain(splits.select("file", "block", "base")), ["file", "block"])
    # The first piece of a file stands before its first magic, so record offsets count from that magic.
    placed = placed.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "exit")})
    cands = placed.filter("next is not null")
    starts = splits.select("file").distinct().select("file", F.lit(0).cast("long").alias("at"))
    seen = reached(starts, cands.select("file", "at", F.col("exit").alias("to")), longest)
    entries = cands.join(seen, ["file", "at"]).select("file", "block", F.col("at").alias("entry"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(pdf["at"].tolist(), pdf["next"].tolist(), strict=True))
        true = set()
        for at in pdf["entry"].dropna().unique().tolist():
            while at in after and at not in true:
                true.add(at)
                at = after[at]
        return pdf[pdf["at"].isin(true)].drop(columns="entry")

    # A chain enters a split once, so the walk of a split is one pass over its offsets.
    cols = "file string, block long, n long, at long, next long, whole boolean, " + _RECORD
    names = [c.split()[0] for c in cols.split(", ")]
    firsts = entries.groupBy("file", "block").agg(F.min("entry").alias("entry"))
    walked = cands.select(names).join(firsts, ["file", "block"])
    ids = "file string, at long"
    true = saved(walked.select("file", "block", "at", "next", F.col("entry")).groupBy("file", "block").applyInPandas(lambda p: walk(p)[["file", "at"]], ids))
    records = saved(cands.select(names).join(true, ["file", "at"]))
    fields = [c.split()[0] for c in _RECORD.split(", ")]
    out = records.filter("whole").select(fields)
    if records.filter("not whole").limit(1).count():
        out = out.union(_joined(spark, path, placed, records.filter("not whole"), fields))
    return out


def _joined(spark: SparkSession, path: str, placed: DataFrame, broken: DataFrame, fields: list[str]) -> DataFrame:
    """Records whose payload holds the magic: their pieces are read once more and put together."""
    spans = broken.select("file", F.col("at").alias("start"), "next")
    wanted = saved(_owners(placed, spans).select("file", "block", "n", "at", "start"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for b in batches:
            place = []
            for i in range(len(b)):
                now = (b.column(1)[i].as_py(), b.column(2)[i].as_py())
                key, n = (now, 0) if now != key else (key, n + 1)
                place.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], ["value", "file", "block", "n"])

    texts = _scan(spark, path).mapInArrow(again, "value binary, file string, block long, n long")
    parts = texts.join(small_or_plain(wanted), ["file", "block", "n"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        content = MAGIC.join(pdf.sort_values("at")["value"].map(bytes))
        head, found = _parse(content)
        return pd.DataFrame([_whole(content, head, found)], columns=fields).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    return parts.select("file", "start", "at", "value").groupBy("file", "start").applyInPandas(build, _RECORD)


def _owners(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """Pieces inside spans (file, start, next), which do not overlap: the last start at or before each piece."""
    marks = spans.select("file", F.col("start").alias("at"), "start", "next", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("n"))
    rows = placed.select("file", "at", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("next"), F.lit(1).alias("_k"), "block", "n")
    over = "over (partition by file order by at, _k rows unbounded preceding)"
    x = rows.union(marks).selectExpr("file", "block", "n", "at", "_k", f"last_value(start, true) {over} as start", f"last_value(next, true) {over} as next")
    return x.filter("_k = 1 and start is not null and at < next")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, path: str | None = None) -> DataFrame:
    """Archives the pages in the shared folder and reads every record back: a row for each row of the input.

    Null html is an empty payload, null urls are left out of the header.  Repeated rows are records each, all
    revisits of the smallest page_id with their payload but that page's own; payloads of any length are
    whole.  An empty table gives no row.
    """
    path = path or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, id_col, url_col, html_col, least)
    return read(pages.sparkSession, path)


#: Of a digest's 40 hex digits, each 5 are 4 digits of base 32.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM s"""
