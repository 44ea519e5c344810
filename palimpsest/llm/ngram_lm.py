"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

Documents are dealt into blocks by hash.  A block's n-grams are exploded, counted and sent, each once, to
the count table's partition that their hash belongs to; the partition adds up all blocks' counts and joins
the totals back to each block's n-grams; the block then scores its documents.  A row carries many n-grams,
packed.  An n-gram that is everywhere reaches a partition once a block, so there are no hot keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.shipping import ship

from .packing import bucket_of, mixed, pack, pack_sorted, unpack, unpack_sorted
from .shared import freed, renamed, saved

#: Bytes of text in a block, and n-grams in a partition of the count table, on average.
BLOCK, PART = 4 << 20, 1_000_000
BACKOFF, UNSEEN = 0.4, 0.5
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (ASCII lower case) and the index of its text."""
    b = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gap = _GAP[b]
    at = np.flatnonzero(~gap)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    opens = ~gap & np.concatenate([[True], gap[:-1]])
    begin = np.flatnonzero(opens)
    place = at - begin[np.cumsum(opens)[at] - 1]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(place.max(), _STEP)]), dtype=np.uint64)
    first = np.searchsorted(at, begin)
    words = mixed(np.add.reduceat(_TABLE[b[at]] * power[place], first))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(ends, begin, side="right")


def grams(words: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order n from 1: the hash of the n-gram that ends at each word, 0 where a text has none."""
    out = [words | np.uint64(1)]
    h = words
    for n in range(2, order + 1):
        longer = np.zeros_like(h)
        if len(h) >= n:
            longer[n - 1 :] = mixed(h[n - 2 : -1] * np.uint64(0xD6E8FEB86659FD93) + words[n - 1 :] + np.uint64(n))
            longer[n - 1 :][doc[n - 1 :] != doc[: 1 - n]] = 0
        h = longer
        out.append(np.where(h > 0, h | np.uint64(1), h))
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long"), F.coalesce("_text", F.lit("")).cast("binary").alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    return rows.withColumn("_block", F.pmod(F.xxhash64("_id", F.xxhash64("_text")), F.lit(n))), total


def _runs(gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending different n-grams, how often each occurs, and for each place the n-gram's number and how often its document has it."""
    order = np.argsort(gram, kind="stable")  # documents ascend within an n-gram
    g, d = gram[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    own = new.copy()
    own[1:] |= d[1:] != d[:-1]
    first = np.flatnonzero(new)
    back, mine = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
    back[order] = np.cumsum(new) - 1
    lengths = np.diff(np.append(np.flatnonzero(own), len(g)))
    mine[order] = np.repeat(lengths, lengths)
    return g[first], np.diff(np.append(first, len(g))), back, mine


def _levels(by: list[np.ndarray], doc: np.ndarray, totals: dict[int, np.ndarray], without_own: bool):
    """For each order: its number, the different n-grams to ask for, their counts here, and the count at each place (None where totals lack the order).

    An n-gram of three words or more is asked for only if both shorter ones in it occur in another document;
    else it occurs in no other document either, and its own count is all.
    """
    elsewhere = None
    for k, gram in enumerate(by, 1):
        there = gram > 0
        if k > 2:
            if elsewhere is None:
                return
            there &= elsewhere & np.concatenate([[False], elsewhere[:-1]])
        at = np.flatnonzero(there)
        keys, counts, back, mine = _runs(gram[at], doc[at])
        if k not in totals:
            elsewhere = None
            yield k, keys, counts, None
            continue
        total = totals[k][back]
        count = np.zeros(len(gram))
        if not without_own:
            every = np.flatnonzero(gram > 0)
            count[every] = _runs(gram[every], doc[every])[3]
        count[at] = total - mine if without_own else total
        elsewhere = np.zeros(len(gram), bool)
        elsewhere[at] = total > mine
        yield k, keys, counts, count


@freed
def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, without_own: bool = True, block_bytes: int = BLOCK, part: int = PART) -> DataFrame:
    """One row per input row: id, n_tokens, score (sum of natural logs), mean_score (null without a token).

    The score of a word is count(n-gram) / count(its first n - 1 words) for the longest n-gram with a count,
    times BACKOFF for each word of context given up; a single word counts against all words, one without a
    count as UNSEEN.  without_own leaves a document's own n-grams out of all counts; repeated rows, equal ids
    too, are documents of their own.  Null text is empty.  A text is never cut, so the longest bounds a
    block from below.

    Counts of one and two words are gathered in a first pass, those of longer n-grams in one pass each, as
    only those come into question whose parts occur elsewhere.
    """
    ship(docs.sparkSession)
    blocks, total = _blocks(docs, id_col, text_col, block_bytes)
    buckets = max(1, math.ceil(total / 6 * min(order, 2) / part))
    by_block = blocks.select("_block", "_text").groupBy("_block")

    def read(left: pa.Table):
        words, doc = tokens([x.as_py() for x in left.column("_text")])
        return words, doc, grams(words, doc, order)

    def answered(right: pa.Table) -> dict[int, np.ndarray]:
        rows = sorted(zip(right.column("level").to_pylist(), right.column("bucket").to_pylist(), right.column("totals")), key=lambda x: x[:2])
        return {k: np.concatenate([unpack(t.as_py(), np.int64) for j, _, t in rows if j == k]) for k in {k for k, _, _ in rows}}

    def asked(block: int, by, doc, totals) -> pa.Table:
        rows = {k: [] for k in ("bucket", "block", "level", "keys", "counts")}
        for level, keys, counts, count in _levels(by, doc, totals, without_own):
            if count is None:
                cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    for k, v in zip(rows, (int(i), block, level, pack_sorted(keys[cut[i] : cut[i + 1]]), pack(counts[cut[i] : cut[i + 1]].astype(np.uint32)))):
                        rows[k].append(v)
        kinds = {"bucket": pa.int64(), "block": pa.int64(), "level": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    def ask(left: pa.Table) -> pa.Table:
        _, doc, by = read(left)
        return asked(left.column("_block")[0].as_py(), by[:2], doc, {})

    def ask_more(left: pa.Table, right: pa.Table) -> pa.Table:
        _, doc, by = read(left)
        totals = answered(right)
        return asked(left.column("_block")[0].as_py() if left.num_rows else 0, by[: max(totals, default=0) + 1], doc, totals)

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        counts = [unpack(x.as_py(), np.uint32) for x in table.column("counts")]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        cut = np.cumsum([0, *map(len, keys)])
        return pa.table({"_block": table.column("block"), "level": table.column("level"), "bucket": table.column("bucket"), "totals": pa.array([pack(sums[back[cut[i] : cut[i + 1]]]) for i in range(len(keys))], pa.binary())})

    asks, answers = "bucket long, block long, level int, keys binary, counts binary", "_block long, level int, bucket long, totals binary"
    found = saved(by_block.applyInArrow(ask, asks).groupBy("bucket", "level").applyInArrow(answer, answers))
    for _ in range(3, order + 1):
        more = by_block.cogroup(found.groupBy("_block")).applyInArrow(ask_more, asks)
        found = found.union(saved(more.groupBy("bucket", "level").applyInArrow(answer, answers)))
    all_words = blocks.agg(F.sum(F.regexp_count(F.col("_text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        words, doc, by = read(left)
        ids, n_docs = left.column("_id"), left.num_rows
        n = np.bincount(doc, minlength=n_docs)
        s, before = np.empty(0), None
        totals = answered(right)
        for k in range(1, order + 1):
            totals.setdefault(k, np.empty(0, np.int64))  # nobody asked
        for k, _, _, count in _levels(by, doc, totals, without_own):
            if k == 1:
                s = np.maximum(count, UNSEEN) / np.maximum(all_words - (n[doc] if without_own else 0), 1)
            else:
                there = by[k - 1] > 0
                context = np.concatenate([[0.0], before[:-1]])  # the shorter n-gram that ends one word earlier
                seen = there & (count > 0) & (context > 0)
                s = np.where(seen, count / np.maximum(context, 1), np.where(there, BACKOFF * s, s))
            before = count
        logs = np.bincount(doc, np.log(s), n_docs).astype(float)
        mean = pa.array(np.where(n > 0, logs / np.maximum(n, 1), 0.0), mask=n == 0)
        return pa.table({"id": ids, "n_tokens": n.astype(np.int64), "score": logs, "mean_score": mean})

    out = blocks.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(score, "id long, n_tokens long, score double, mean_score double")
    return out.withColumnRenamed("id", id_col)


#: Order 3, own n-grams left out; a is a word, b and c the two before it, and a count of 0 gives up a word of context.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, a, lag(a) OVER o AS b, lag(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS n1,
        count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY doc_id, a, b) AS n2,
        count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) AS n3,
        count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others FROM g),
m AS (SELECT *, lag(n1) OVER o AS m1, lag(n2) OVER o AS m2 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s1 AS (SELECT *, greatest(n1, 0.5)::DOUBLE / greatest(others, 1) AS p1 FROM m),
s2 AS (SELECT *, CASE WHEN b IS NULL THEN p1 WHEN n2 > 0 AND m1 > 0 THEN n2::DOUBLE / m1 ELSE 0.4::DOUBLE * p1 END AS p2 FROM s1),
s3 AS (SELECT *, CASE WHEN c IS NULL THEN p2 WHEN n3 > 0 AND m2 > 0 THEN n3::DOUBLE / m2 ELSE 0.4::DOUBLE * p2 END AS p3 FROM s2),
z AS (SELECT doc_id, sum(ln(p3)) AS score FROM s3 GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_tokens, round(coalesce(score, 0), 4) AS score, round(score / len(ws), 8) AS mean_score FROM d LEFT JOIN z USING (doc_id)"""
