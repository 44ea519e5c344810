"""Repeated byte strings across documents, by minimizers and hashes in place of a depth-limited radix sort of suffixes.

Only the first WINDOW bytes of a suffix matter: suffixes that agree on them are one repeated window.  As
only their equality counts, suffixes are grouped and never ordered.  They are grouped by:

1. a K-gram inside the window, the one with the least hash (windows that are equal choose the same one at
   the same place), which is dealt out by hash; consecutive windows with the same K-gram are one span;
2. the bytes of the whole span: equal spans are settled at once, for all their windows;
3. for spans that share the K-gram but not all bytes, and agree on the bytes beside it on one side at
   least, the WINDOW bytes themselves.

Groups that lie in one document only end at each step.  Every task settles what repeats among its own
documents and sends a key once, so nothing that is frequent floods a partition; a K-gram with very many
different spans goes on to the windows at once, which have keys of their own.  Rows on the way to a bucket
carry many suffixes, packed; what is found comes back as a row a span.  Hashes are two independent ones of
64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import bucket_of, mixed, pack, unpack
from .shared import freed, in_small_batches, renamed, saved

WINDOW, K = 50, 20
#: Bytes hashed at a time, bytes gathered before a task sends, spans in a partition on average, windows
#: held, settled spans in a row.
CHUNK, GATHER, PART, HELD, SETTLED = 1 << 16, 2 << 20, 150_000, 200_000, 20_000
_SIDE = 15
_SHIFT = 6  # a span has at most WINDOW - K + 1 windows


@lru_cache(maxsize=4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of a base and their inverses modulo 2 ** 64."""
    base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which]
    inverse = pow(base, -1, 1 << 64)
    run = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64)
    return np.random.default_rng(which).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), run(base), run(inverse)


class _Hashes:
    """Hash of any stretch of a buffer, by prefix sums."""

    def __init__(self, b: np.ndarray, which: int):
        n = 1 << (len(b) + 1).bit_length()
        table, power, self.inverse = _powers(which, n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(table[b] * power[: len(b)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def _buffers(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text index of each byte, offset in its text of each byte, whether a window may begin there).

    Short texts share a buffer; a long one comes in pieces that overlap by a window less one byte.
    """
    held, size = [], 0

    def flush(held):
        b = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        sizes = [len(x) for _, _, x in held]
        text = np.repeat([i for i, _, _ in held], sizes)
        begin = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        at = np.arange(len(b)) - begin
        ok = at + WINDOW <= np.repeat(sizes, sizes)
        return b, text, at + np.repeat([o for _, o, _ in held], sizes), ok

    for i, t in enumerate(texts):
        if len(t) < WINDOW:
            continue
        for o in range(0, len(t) - WINDOW + 1, CHUNK):
            part = t[o : o + CHUNK + WINDOW - 1]
            held.append((i, o, part))
            size += len(part)
            if size >= CHUNK:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def spans(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All spans of the texts: h (K-gram), s (bytes), text, at (first window), n (windows), side (bytes on both sides)."""
    found = []
    for b, text, at, ok in _buffers(texts):
        one, two = _Hashes(b, 0), _Hashes(b, 1)
        grams = one.all(K)
        width = WINDOW - K + 1
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        best = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok = ok[: len(best)]
        new = np.concatenate([[True], (best[1:] != best[:-1]) | (text[1 : len(best)] != text[: len(best) - 1])]) | ~ok
        first = np.flatnonzero(new & ok)
        last = np.concatenate([np.flatnonzero(new)[1:], [len(best)]])[np.searchsorted(np.flatnonzero(new), first)]
        # Windows that may not begin stand alone, so a span ends before them.
        q, n = best[first], last - first
        s = mixed(two.of(first, last + WINDOW - 1) ^ ((q - first) * (1 << _SHIFT) + n).astype(np.uint64))
        left = one.of(np.maximum(q - _SIDE, 0), q) >> np.uint64(56)
        right = one.of(q + K, np.minimum(q + K + _SIDE, len(b))) >> np.uint64(56)
        found.append((grams[q], s, text[first], at[first], n, (left << np.uint64(8) | right).astype(np.uint16)))
    names = ("h", "s", "text", "at", "n", "side")
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint16)
    return {k: np.concatenate([f[i] for f in found]).astype(t) if found else np.empty(0, t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))}


def windows(text: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, other hash, place) of the windows in packed spans of one text."""
    at, n = wanted >> _SHIFT, wanted & ((1 << _SHIFT) - 1)
    place = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.unique(place)
    h, g = np.empty(len(place), np.uint64), np.empty(len(place), np.uint64)
    for o in range(0, len(text), CHUNK):
        mine = (place >= o) & (place < o + CHUNK)
        if mine.any():
            b = np.frombuffer(text[o : o + CHUNK + WINDOW - 1], np.uint8)
            start = place[mine] - o
            h[mine], g[mine] = (_Hashes(b, k).of(start, start + WINDOW) for k in (0, 1))
    return h, g, place


def _least(*keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items under equal keys: the group's number and the least document of each item's group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)
    return group, low[group] if len(order) else low


_CROWDED = -1
_again = lambda h: mixed(h ^ np.uint64(0x9E3779B97F4A7C15))  # noqa: E731  the least hash of many is small, so its range says nothing


_ITEMS = "bucket long, h binary, s binary, doc binary, th binary, at binary, side binary"


def _send(items: dict[str, np.ndarray], buckets: int, crowd: int | None = None) -> Iterator[pa.RecordBatch]:
    """Deals out what a smaller document of the same task does not cover already.

    Buckets below 0 are settled, SETTLED items each: odd ones covered, even ones open.  If over crowd
    different spans share a K-gram here, all of them are open, and its bucket gets one row that says so.
    """
    if not len(items["h"]):
        return
    span, low = _least(items["h"], items["s"], doc=items["doc"])
    covered = items["doc"] > low
    bucket = bucket_of(_again(items["h"]), buckets)
    if crowd is not None:
        gram, first = np.unique(items["h"], return_inverse=True)
        many = np.bincount(first[np.unique(span, return_index=True)[1]], minlength=len(gram)) > crowd
        open_ = many[first] & ~covered
        bucket[open_] = -2 - 2 * (np.cumsum(open_)[open_] // SETTLED)
        n, zero = int(many.sum()), np.zeros(int(many.sum()), np.int64)
        more = {"h": gram[many], "s": zero.view(np.uint64), "doc": zero, "th": zero, "at": zero + _CROWDED, "side": zero.astype(np.uint16)}
        items = {k: np.concatenate([v, more[k]]) for k, v in items.items()}
        covered, bucket = np.append(covered, np.zeros(n, bool)), np.append(bucket, bucket_of(_again(gram[many]), buckets))
    bucket[covered] = -1 - 2 * (np.cumsum(covered)[covered] // SETTLED)
    order = np.lexsort((items["h"], bucket))
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    rows = {k: [] for k in ("bucket", "h", "s", "doc", "th", "at", "side")}
    for a, z in zip(cut[:-1], cut[1:]):
        mine = order[a:z]
        rows["bucket"].append(int(bucket[a]))
        for k in ("h", "s", "doc", "th", "at", "side"):
            rows[k].append(b"" if bucket[a] < 0 and k in ("h", "s", "side") else pack(items[k][mine]))
    yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), *(pa.array(rows[k], pa.binary()) for k in list(rows)[1:])], list(rows))


_FOUND = "doc long, th long, open boolean, at long"


def _found(doc: np.ndarray, th: np.ndarray, at: np.ndarray, open_: bool) -> pa.Table:
    """A row of fixed width for each span or window, so that rows grow as what is covered does."""
    return pa.table({"doc": doc, "th": th, "open": np.full(len(doc), open_), "at": at})


def _settle(sides: bool):
    """Covered spans or windows of a bucket; with sides also the spans whose windows must be looked at one by one."""

    def run(table: pa.Table) -> pa.Table:
        kinds = {"h": np.uint64, "s": np.uint64, "doc": np.int64, "th": np.int64, "at": np.int64, "side": np.uint16}
        x = {k: np.concatenate([unpack(v.as_py(), t) for v in table.column(k)]) for k, t in kinds.items() if len(table.column(k)[0].as_py())}
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return _found(x["doc"], x["th"], x["at"], bucket % 2 == 0)
        crowded = np.unique(x["h"][x["at"] == _CROWDED])
        x = {k: v[x["at"] != _CROWDED] for k, v in x.items()}
        _, low = _least(x["h"], x["s"], doc=x["doc"])
        covered = x["doc"] > low
        out = [_found(x["doc"][covered], x["th"][covered], x["at"][covered], False)]
        if sides:
            rest = {k: v[~covered] for k, v in x.items()}
            maybe = np.isin(rest["h"], crowded)
            for side in (rest["side"] >> np.uint16(8), rest["side"] & np.uint16(255)):
                own, least = _least(rest["h"], side, doc=rest["doc"])
                if len(own):
                    most = np.full(own.max() + 1, np.iinfo(np.int64).min)
                    np.maximum.at(most, own, rest["doc"])
                    maybe |= most[own] > least
            out.append(_found(rest["doc"][maybe], rest["th"][maybe], rest["at"][maybe], True))
        return pa.concat_tables(out)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with not much more than GATHER bytes of text each."""
    for b in batches:
        start, texts, size = 0, [], 0
        for i in range(len(b)):
            texts.append(b.column(text)[i].as_py())
            size += len(texts[-1])
            if size >= GATHER or i == len(b) - 1:
                yield b.slice(start, i + 1 - start), texts
                start, texts, size = i + 1, [], 0


def covered(rows: DataFrame, part: int = PART) -> DataFrame:
    """doc, th, at (array of packed spans) for rows (_id long, _th long, _data binary): all windows that also begin in a document of smaller id."""
    total = rows.agg(F.sum(F.octet_length("_data"))).first()[0] or 0
    # Enough buckets for every partition to have some.
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(total / 16 / part))
    crowd = max(16, part // math.ceil(max(1, total) / GATHER))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _gathered(batches, 2):
            x = spans(texts)
            ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield from _send({"h": x["h"], "s": x["s"], "doc": ids[x["text"]], "th": ths[x["text"]], "at": x["at"] << _SHIFT | x["n"], "side": x["side"]}, buckets, crowd)

    usable = rows.filter(F.col("_id").isNotNull() & (F.octet_length("_data") >= WINDOW))
    # What tasks have settled already is spread by its own hash, not gathered under one bucket.
    deal = F.when(F.col("bucket") < 0, F.xxhash64("at")).otherwise(F.col("bucket"))
    spread = lambda items, n: items.withColumn("_deal", deal).repartition(n, "_deal")
    first = saved(spread(usable.mapInArrow(scan, _ITEMS), max(least, math.ceil(buckets / 2))).groupBy("_deal", "bucket").applyInArrow(lambda t: _settle(True)(t), _FOUND))

    asked = first.filter("open").groupBy("doc", "th").agg(F.collect_list("at").alias("at"))
    texts = usable.join(asked, (F.col("_id") == F.col("doc")) & (F.col("_th") == F.col("th"))).select("_id", "_th", "_data", "at")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in _gathered(batches, 2):
            found, held = [], 0
            for i, t in enumerate(data):
                h, g, place = windows(t, np.array(b.column(3)[i].values))
                found.append((h, g, np.full(len(h), b.column(0)[i].as_py()), np.full(len(h), b.column(1)[i].as_py()), place << _SHIFT | 1))
                held += len(h)
                if held >= HELD:
                    yield from _send(_items(found), parts)
                    found, held = [], 0
            if found:
                yield from _send(_items(found), parts)

    n_open = first.filter("open").agg(F.sum(F.col("at").bitwiseAND(F.lit((1 << _SHIFT) - 1)))).first()[0] or 0
    parts = max(least, math.ceil(n_open / part / 2))
    second = spread(texts.mapInArrow(look, _ITEMS), max(least, math.ceil(parts / 2))).groupBy("_deal", "bucket").applyInArrow(lambda t: _settle(False)(t), _FOUND)
    return first.filter("not open").union(second).groupBy("doc", "th").agg(F.collect_list("at").alias("at"))


def _items(found: list[tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
    h, g, doc, th, at = (np.concatenate([f[i] for f in found]) for i in range(5))
    return {"h": h, "s": g, "doc": doc, "th": th, "at": at, "side": np.zeros(len(h), np.uint16)}


def removed(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that packed spans of windows cover."""
    first = np.sort(at)
    start, end = first >> _SHIFT, (first >> _SHIFT) + (first & ((1 << _SHIFT) - 1)) + WINDOW - 1
    end = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], np.append(end[:-1][new[1:]], end[-1:])


@freed
@in_small_batches
def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, texts: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and with texts the bytes that stay (kept).

    Removed is every byte inside a WINDOW-byte string that also begins in a document of smaller id.  Null
    text counts as empty.  Rows of one id do not remove each other; rows without an id neither remove nor
    lose anything.
    """
    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), F.coalesce("_text", F.lit("")).cast("binary").alias("_data"))
    # Rows of one id are told apart by their texts, if there are such.
    again = rows.groupBy("_id").count().filter("count > 1 and _id is not null").limit(1).count() > 0
    rows = rows.select("_id", (F.xxhash64("_data") if again else F.lit(0).cast("long")).alias("_th"), "_data")
    gone = saved(covered(rows, part))
    x = rows.join(gone, (F.col("_id") == F.col("doc")) & (F.col("_th") == F.col("th")), "left").select("_id", "_data", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in _gathered(batches, 1):
            out = []
            for i, t in enumerate(data):
                at = b.column(2)[i]
                if at.is_valid and len(at):
                    start, end = removed(len(t), np.array(at.values))
                    keep = [t[a:z] for a, z in zip([0, *end], [*start, len(t)])]
                    out.append((len(t), int((end - start).sum()), len(start), keep))
                else:
                    out.append((len(t), 0, 0, [t]))
            kept = [b"".join(k) for *_, k in out]
            cols = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([hashlib.sha256(k).hexdigest() for k in kept]), *([pa.array(kept, pa.binary())] if texts else [])], names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    out = x.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))
    return saved(out).withColumnRenamed("id", id_col)
