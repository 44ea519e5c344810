"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one last token with which its encoding can end: the token is
a suffix of the prefix, and the unique last token of what stands before it forms a valid pair with it.  A
pair is valid if merging its bytes from scratch gives back the pair.  The table of last tokens grows by
appending without touching what is there, and an edit leaves the table of the prefix before it as it is.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.shipping import ship

from .shared import in_small_batches, renamed, saved

#: Pieces and pairs kept in memory by a worker; beyond that the memo starts anew, results are the same.
MEMO, PAIRS, MEMO_BYTES, LONG = 400_000, 400_000, 48, 1_000_000


class Vocabulary:
    """Ranks of a tiktoken file, the pattern that cuts text into pieces, and the pair test."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        #: Every byte string with which a token ends: its rank, -1 if it is no token itself.
        self.ends = {k[i:]: -1 for k in self.ranks for i in range(len(k))} | self.ranks
        self.pairs: dict[int, bool] = {}
        self.reachable: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | tuple[()] | bool] = {}
        self.memo = _Memo(self)

    def merge(self, data: bytes) -> list[int]:
        """Plain merging: again and again the adjacent pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def stands(self, token: int) -> bool:
        """Whether merging a token's bytes gives that token alone."""
        if (x := self.reachable.get(token)) is None:
            x = self.reachable[token] = self.merge(self.bytes_of[token]) == [token]
        return x

    def valid(self, a: int, b: int) -> bool:
        if (x := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x = self.pairs[a << 32 | b] = self._valid(a, b)
        return x

    def _valid(self, a: int, b: int) -> bool:
        """Whether merging from scratch leaves a pair alone, by undoing the merges that touch its boundary, last one first.

        Where merges go by rising rank, what stands at the boundary is a chain of right parts of a and left parts of
        b; two of them would have merged if their token comes before the next merge (of equal ranks the leftmost goes
        first).  Tokens whose merges do not rise are merged in full.
        """
        x, y, limit, whole, parts, ranks = a, b, 1 << 60, self.bytes_of, self.parts, self.ranks.get
        while True:
            if ranks(whole[x] + whole[y], 1 << 60) < limit:
                return False
            if (p := parts.get(x)) is None:
                p = self.split(x)
            if (q := parts.get(y)) is None:
                q = self.split(y)
            if p is False or q is False:
                return self.merge(whole[a] + whole[b]) == [a, b]
            if p and (not q or x > y):
                limit, x = x, p[1]
            elif q:
                limit, y = y + 1, q[0]
            else:
                return True

    def split(self, token: int) -> tuple[int, int] | tuple[()] | bool:
        """The two tokens that merge into a token last; () of a single byte, False if the ranks of its merges do not rise to its own."""
        data, last, out = self.bytes_of[token], -1, ()
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60 or rank < last:
                out = False
                break
            last, out = rank, (self.ranks[parts[i]], self.ranks[parts[i + 1]])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.parts[token] = out
        return out

    def piece(self, data: bytes) -> list[int]:
        """A piece that is a token as a whole is that token; any other goes by the prefix table."""
        if (t := self.ranks.get(data)) is not None:
            return [t]
        return PrefixTable(self, data).tokens()

    def encode(self, text: str) -> list[int]:
        return [t for m in self.pattern.finditer(text) for t in self.piece(m.group().encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memo(dict):
    """Piece -> ids as little-endian 32-bit integers.  A full memo becomes the old one, which is still asked."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            ids = b"".join(map(_PACK, self.vocabulary.piece(data)))
            if len(data) > MEMO_BYTES:
                return ids
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


_PACK = struct.Struct("<I").pack


class PrefixTable:
    """last[i]: the one token with which the encoding of the first i bytes ends; start[i]: where it starts."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.start = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the entries of the old prefixes hold for the longer text."""
        v, start = self.vocabulary, len(self.data)
        self.data += more
        data, last, begin, end, pair, ranks = self.data, self.last, self.start, v.ends.get, v.pairs.get, v.ranks
        for i in range(start + 1, len(data) + 1):
            for j in range(i - 1, -1, -1):
                t = end(data[j:i])
                if t is None:
                    raise ValueError(f"no valid encoding at byte {i}")
                if t >= 0:
                    if j:
                        if data[begin[j] : i] in ranks:  # the two would merge
                            continue
                        ok = pair(last[j] << 32 | t)
                        if ok is None:
                            ok = v.valid(last[j], t)
                    else:
                        ok = v.stands(t)
                    if ok:
                        last.append(t)
                        begin.append(j)
                        break
            else:
                raise ValueError(f"no valid encoding at byte {i}")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces data[start:end]; only entries from start on are made anew."""
        rest = new + self.data[end:]
        self.data, self.last, self.start = self.data[:start], self.last[: start + 1], self.start[: start + 1]
        self.append(rest)

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i = self.start[i]
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _blobs(v: Vocabulary, text: str) -> Iterator[bytes]:
    """Ids of the text's pieces, some at a time."""
    if len(text) <= LONG:
        yield b"".join(map(v.memo.__getitem__, v.pattern.findall(text)))
        return
    found = v.pattern.finditer(text)
    while some := list(islice(found, 100_000)):
        yield b"".join(v.memo[m.group()] for m in some)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, ids (array of int): the tokens of every row's whole text; null text counts as empty, which has no token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            ids = [np.frombuffer(b"".join(_blobs(v, x.as_py() or "")), "<i4") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    path, pattern = _where(path, pattern)
    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long").alias("id"), F.col("_text").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, data (binary): the bytes of every row's tokens; null counts as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            data = [v.decode(x.as_py() or ()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "data"])

    path, pattern = _where(path, pattern)
    ship(tokens.sparkSession)
    rows = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, data binary").withColumnRenamed("id", id_col)


@in_small_batches
def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, both done in one pass over the text.

    Null texts count as empty and have no token; repeated rows each have their row; texts of any length are
    encoded to their end, and what is held of one is a stretch of its ids.  An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for b in batches:
            count, ids_hash, data_hash = [], [], []
            for x in b.column(1):
                n, ids, data = 0, hashlib.sha256(), hashlib.sha256()
                for blob in _blobs(v, x.as_py() or ""):
                    n += len(blob) // 4
                    ids.update(blob)
                    data.update(v.decode(np.frombuffer(blob, "<u4").tolist()))
                count.append(n)
                ids_hash.append(ids.hexdigest())
                data_hash.append(data.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(data_hash, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    path, pattern = _where(path, pattern)
    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long").alias("id"), F.col("_text").alias("text"))
    return saved(rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")).withColumnRenamed("id", id_col)


def _where(path: str | None, pattern: str | None) -> tuple[str, str]:
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return os.fspath(path or default_path()), pattern
