"""Vector functions: similarity, hash embeddings, sign hashes, means."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.shipping import ship_active

from . import text as T
from . import tokens, words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for empty vectors, different lengths or a zero vector."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.when(size == 0, 0.0).otherwise(dot(a, b) / size))


def is_valid(a: Column, dim: int) -> Column:
    """Exactly dim finite values."""
    return (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def unit(a: Column) -> Column:
    n = norm(a)
    # Inside a lambda the norm would be worked out again for every cell.
    return F.when(n == 0, a).otherwise(F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, y: x / y))


def token_hash(token: Column | str, seed: int = 0) -> Column:
    """Absolute value of h = 31 h + unit over UTF-16 units in 32-bit arithmetic, as a long."""
    t = F.col(token) if isinstance(token, str) else token
    code = F.encode(t, "UTF-16BE")
    n = (F.octet_length(code) / 2).cast("int")
    value = lambda i: F.conv(F.hex(F.substring(code, 2 * i + 1, F.lit(2))), 16, 10).cast("long")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, F.lit(seed).cast("long"), lambda h, i: (h * 31 + value(i)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 1 << 31, (1 << 32) - h).otherwise(h)


def hash_of(token: str, seed: int = 0) -> int:
    h = seed
    data = token.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = h * 31 + (data[i] << 8 | data[i + 1]) & 0xFFFFFFFF
    return (1 << 32) - h if h >= 1 << 31 else h


def hashes_of(tokens: list[str], seed: int = 0) -> np.ndarray:
    """hash_of for many tokens at once: one step a place, over all tokens that have it."""
    sizes = np.array([len(t) if t.isascii() else len(t.encode("utf-16-le")) // 2 for t in tokens], np.int64)
    units = np.frombuffer("".join(tokens).encode("utf-16-le"), "<u2").astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    h = np.full(len(tokens), seed, np.int64)
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -place, "left"))
        h[:n] = h[:n] * 31 + units[starts[:n] + place] & 0xFFFFFFFF
    out = np.empty_like(h)
    out[order] = np.where(h >= 1 << 31, (1 << 32) - h, h)
    return out


def hash_embedding(text: Column | str, dim: int = 256, seed: int = 0) -> Column:
    """Counts of tokens by hash modulo dim, at unit length; zeros without tokens.  An Arrow UDF counts tokens, hashes
    each different one once and sums by row, some rows at a time; texts that are FAR come as tokens of built-in expressions."""
    ship_active()

    @F.arrow_udf("array<double>")
    def run(s: pa.Array, far: pa.Array) -> pa.Array:
        return embedded(s, dim, seed, far)

    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return run(t, T.far_tokens(t))


def analysis(text: Column | str, n: int, dim: int = 256, seed: int = 0) -> Column:
    """struct(keywords, embedding): T.keywords and hash_embedding of a text from one count of its tokens."""
    ship_active()

    @F.arrow_udf("struct<keywords: array<string>, embedding: array<double>>")
    def run(s: pa.Array, far: pa.Array) -> pa.Array:
        words: list[list[str]] = []
        v = embedded(s, dim, seed, far, n, words)
        return pa.StructArray.from_arrays([pa.array(words, pa.list_(pa.string())), v], ["keywords", "embedding"])

    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return run(t, T.far_tokens(t))


def embedded(s: pa.Array, dim: int, seed: int = 0, far: pa.Array | None = None, n: int = 0, words: list[list[str]] | None = None) -> pa.Array:
    """Embeddings of texts, or of their tokens in far where these are not null; few rows at a time are Python objects.

    Texts of plain characters are cut, hashed and counted at once (functions.tokens), others one at a time.  words
    gets the n keywords of each text.
    """
    m = np.empty((len(s), dim))
    for at in range(0, len(s), T.ROWS):
        texts = s.slice(at, T.ROWS).to_pylist()
        spaced = far.slice(at, T.ROWS).to_pylist() if far is not None else [None] * len(texts)
        part, found = m[at : at + len(texts)], [None] * len(texts)
        near = [i for i, (t, x) in enumerate(zip(texts, spaced, strict=True)) if x is None and tokens.fits(t)]
        for lo, hi in tokens.runs([texts[i] for i in near]):
            some = near[lo:hi]
            cut = tokens.Tokens([texts[i] for i in some])
            part[some] = cut.bins(dim, seed)
            for i, k in zip(some, cut.keywords(n) if words is not None else [], strict=False):
                found[i] = k
        rest = sorted(set(range(len(texts))) - set(near))
        own = [T.near_counts(texts[i]) if spaced[i] is None else Counter(spaced[i].split(" ")) for i in rest]
        for c in own:
            c.pop("", None)
        if words is not None:
            for i, c in zip(rest, own, strict=True):
                found[i] = T.most_frequent(c, n) if spaced[i] is None else T.keyword_list(texts[i], n)
            words.extend(found)
        if rest:
            row = np.repeat(np.arange(len(own)), [len(c) for c in own])
            times = np.fromiter(chain.from_iterable(c.values() for c in own), float)
            part[rest] = np.bincount(row * dim + _hashes(own, seed) % dim, times, len(own) * dim).reshape(-1, dim)
        norm = np.sqrt((part * part).sum(axis=1, keepdims=True))
        part /= np.where(norm > 0, norm, 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * dim, pa.int32()), pa.array(m.ravel()))


def _hashes(rows: list[Iterable[str]], seed: int) -> np.ndarray:
    """hash_of for the tokens of some rows, none of which is empty or has a space, in order: one step a place, over all tokens that have it."""
    joined = "".join(f"{t} " for t in chain.from_iterable(rows))
    units = np.frombuffer(joined.encode("utf-16-le"), "<u2")
    ends = np.flatnonzero(units == ord(" "))
    starts = np.concatenate([[0], ends + 1])[:-1]
    order = np.argsort(starts - ends, kind="stable")
    starts, less = starts[order], (starts - ends)[order]
    h, units = np.full(len(ends), seed & 0xFFFFFFFF, np.uint32), units.astype(np.uint32)
    for place, n in enumerate(np.searchsorted(less, -np.arange(-less[0] if len(less) else 0), "left").tolist()):
        h[:n] = h[:n] * np.uint32(31) + units[starts[:n] + place]
    h = h.astype(np.int64)
    out = np.empty_like(h)
    out[order] = np.where(h >= 1 << 31, (1 << 32) - h, h)
    return out


def hybrid_embedding(hashed: Column, local: Column, dim: int, tags: Column | None = None) -> Column:
    """Hash part then local part; zeros for the latter unless it is a query (no tags) or tagged important or conflict."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    if tags is None:
        return F.concat(hashed, F.coalesce(local, zeros))
    return F.concat(hashed, F.when(F.arrays_overlap(tags, F.array(F.lit("important"), F.lit("conflict"))), F.coalesce(local, zeros)).otherwise(zeros))


def file_vector(text: Column | str) -> Column:
    """32 bins of UTF-16 units of the trimmed, lower-cased text by position, at unit length."""
    ship_active()

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            codes = np.frombuffer((t or "").encode("utf-16-le"), "<u2").astype(float)
            bins = np.bincount(np.arange(len(codes)) % 32, codes, 32) if len(codes) else np.zeros(32)
            size = math.sqrt(float(bins @ bins))
            return bins / size if size else bins

        return s.map(one)

    t = F.col(text) if isinstance(text, str) else text
    return run(F.lower(F.regexp_replace(t, f"^{T.SPACE}+|{T.SPACE}+$", "")))


@lru_cache(maxsize=8)
def hyperplanes(dim: int, tables: int = 6, bits: int = 12) -> np.ndarray:
    """(tables, bits, dim) planes of unit length from a sine of table, bit and dimension numbers."""
    out = np.empty((tables, bits, dim))
    for t in range(tables):
        for b in range(bits):
            base = _int32((t + 1) * 73856093) ^ _int32((b + 1) * 19349663)
            seed = [base ^ _int32((d + 1) * 83492791) for d in range(dim)]
            value = [math.sin(s * 12.9898 + s * 78.233) * 43758.5453 for s in seed]
            out[t, b] = [(v - math.floor(v)) * 2 - 1 for v in value]
    return out / np.linalg.norm(out, axis=2, keepdims=True)


def _int32(x: int) -> int:
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def sign_keys(v: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """For vectors a key for each table: which side of its planes they lie on, first bit highest."""
    planes = hyperplanes(v.shape[1], tables, bits).reshape(-1, v.shape[1])
    weights = 1 << np.arange(bits - 1, -1, -1)
    return ((v @ planes.T >= 0).reshape(len(v), tables, bits) * weights).sum(axis=2).astype(np.min_scalar_type((1 << bits) - 1))


def signatures(vector: Column | str, dim: int, tables: int = 6, bits: int = 12) -> Column:
    """For each table the bits of which side of its planes a vector lies on, first bit highest; null if not valid."""
    ship_active()

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            ok = [i for i, x in enumerate(s) if x is not None]
            out = [None] * len(s)
            if ok:
                v = np.vstack([np.asarray(s.iloc[i], float) for i in ok])
                for i, key in zip(ok, sign_keys(v, tables, bits).astype(np.int32)):
                    out[i] = key
            yield pd.Series(out, dtype=object)

    v = F.col(vector) if isinstance(vector, str) else vector
    return run(F.when(is_valid(v, dim), v))


def relation_vector(kind: str, dim: int) -> list[float]:
    """Unit vector of a relation type: sines seeded by its number, or by a hash of an unknown name."""
    if kind in words.RELATION_TYPES:
        seed = words.RELATION_TYPES.index(kind) + 1
    else:
        h = 0
        data = kind.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = h * 31 + (data[i] << 8 | data[i + 1]) & 0xFFFFFFFF
        seed = h % 10_000 + 1 if kind else 1
    v = np.array([math.sin(seed * (i + 1) / 17) * 0.1 for i in range(dim)])
    return (v / np.linalg.norm(v)).tolist() if v.any() else v.tolist()


def vector_sum(df: DataFrame, by: list[str], vector: str, weight: Column | None = None, mean: bool = False, name: str = "vector") -> DataFrame:
    """Element-wise (weighted) sum or mean of equally long vectors by keys; partial sums before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    w = weight if weight is not None else F.lit(1.0)
    # A vector a key and task is shuffled, not its cells.
    x = df.filter(F.col(vector).isNotNull()).select(*by, w.alias("_w"), F.col(vector).cast("array<double>").alias("_v"))
    x = x.groupBy(*by).agg(F.count("*").alias("_n"), vector_to_array(Summarizer.sum(array_to_vector("_v"), F.col("_w"))).alias("_s"))
    return x.select(*by, (F.transform("_s", lambda e: e / F.col("_n")) if mean else F.col("_s")).alias(name))
