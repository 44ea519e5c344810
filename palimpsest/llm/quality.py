"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages: its lines, longer ones cut every PASSAGE bytes.  Each passage of the whole
text is encoded from its content, the words and the byte trigrams by hash, and from measures of its form;
gated attention, learned from document labels alone, weighs the encoded passages, and the weighted sum is
scored.  A text is read piece by piece and its passages are pooled as they come; words end with their
passage, and what is carried from piece to piece is a hash for each different passage so far, so pieces of any
size give the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.shipping import ship

from .shared import in_small_batches, renamed, saved

PASSAGE, CHUNK = 600, 1 << 20
#: Of each class, labelled rows that a fit reads at most, and passages that these rows have at most in all.
PER_CLASS, PER_CLASS_PASSAGES = 2500, 300_000

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _BANG, _BAR, _MARK, _STOP, _PUNCT, _HIGH_UPPER, _HIGH_LOWER, _CONTROL = range(13)
_CLASS = np.full(256, _CONTROL, np.uint8)
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t\r\x0b\x0c", _SPACE), (b"\n", _LINE), (b"!", _BANG), (b"|", _BAR), (b"%$&#*@^~=+<>_\\/{}[]", _MARK), (b".,;:?", _STOP), (b"\"'()-`", _PUNCT)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _c
_CLASS[0x80:0x9F], _CLASS[0x9F:0xC0], _CLASS[0xC0:] = _HIGH_UPPER, _HIGH_LOWER, _CONTROL
_MIX = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
N_CLASSES, N_FORM, N_WORDS, N_GRAMS = 13, 22, 64, 64
N_FEATURES = N_FORM + N_WORDS + N_GRAMS
_GRAM = np.random.default_rng(9).integers(0, N_GRAMS, (3, 256), dtype=np.uint8)
_GRAM[:, 65:91] = _GRAM[:, 97:123]  # in lower case


def passages(data: bytes, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of a piece of text, and the hashes of all different passages so far.

    before: those of the pieces before it.  An empty text is one passage of zeros.
    """
    before = np.empty(0) if before is None else before
    if not data:
        return np.zeros((1, N_FEATURES), np.float32), before
    b = np.frombuffer(data, np.uint8)
    kind = _CLASS[b]
    cut = np.concatenate([[0], np.flatnonzero(b[:-1] == 10) + 1, [len(b)]])
    gaps = np.diff(cut)
    more = (gaps - 1) // PASSAGE
    starts = np.repeat(cut[:-1], more + 1)
    starts = starts + PASSAGE * (np.arange(len(starts)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
    n, size = len(starts), np.diff(np.concatenate([starts, [len(b)]]))
    own = np.repeat(np.arange(n), size)
    out = np.zeros((n, N_FEATURES))
    inside = own[2:] == own[:-2]
    gram = (_GRAM[0][b[:-2]] ^ _GRAM[1][b[1:-1]] ^ _GRAM[2][b[2:]])[inside]
    out[:, N_FORM + N_WORDS :] = np.bincount(own[2:][inside] * N_GRAMS + gram, minlength=n * N_GRAMS).reshape(n, N_GRAMS) / size[:, None]
    counts = np.bincount(own * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    out[:, :N_CLASSES] = counts / size[:, None]
    letters = counts[:, [_LOWER, _UPPER, _HIGH_UPPER, _HIGH_LOWER]].sum(axis=1)
    out[:, 13] = (counts[:, _UPPER] + counts[:, _HIGH_UPPER]) / np.maximum(1, letters)
    gap = (kind == _SPACE) | (kind == _LINE)
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1] | (own[1:] != own[:-1])]))
    if len(begin):
        at = np.flatnonzero(~gap)
        opens = np.zeros(len(b), bool)
        opens[begin] = True
        word = np.cumsum(opens)[at] - 1
        length = np.bincount(word, minlength=len(begin))
        place = (at - begin[word]).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        hashed = np.add.reduceat(_MIX[b[at]] * _POWER[place & np.uint64(1023)], first)
        home = own[begin]
        words = np.bincount(home, minlength=n).astype(float)
        many = np.maximum(1, words)
        bucket = (hashed >> np.uint64(40)).astype(np.int64) % N_WORDS
        out[:, N_FORM : N_FORM + N_WORDS] = np.bincount(home * N_WORDS + bucket, minlength=n * N_WORDS).reshape(n, N_WORDS) / many[:, None]
        out[:, 14] = np.log1p(words) / 5
        out[:, 15] = np.bincount(home, length, n) / many / 10
        out[:, 16] = np.sqrt(np.bincount(home, length.astype(float) ** 2, n) / many) / 10
        for k, back in ((17, 1), (18, 2), (19, 3)):
            same = (hashed[back:] == hashed[:-back]) & (home[back:] == home[:-back])
            out[:, k] = np.bincount(home[back:], same, n) / many
        order = np.lexsort((hashed, home))
        h, o = hashed[order], home[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
        out[:, 20] = np.bincount(o, new, n) / many
        whole = np.bincount(home, (hashed >> np.uint64(11)).astype(float) * (1 + np.arange(len(home)) - np.searchsorted(home, home)), n)
        told = np.flatnonzero(words > 0)
        different, first = np.unique(whole[told], return_index=True)
        out[told, 21] = 1
        out[told[first[~np.isin(different, before)]], 21] = 0  # the first of its kind in the text
        before = np.union1d(before, different)
    return out.astype(np.float32), before


def pieces(data: bytes | None) -> Iterator[np.ndarray]:
    """Passages of a whole text, piece by piece of about CHUNK bytes, cut between passages."""
    data, at, before = data or b"", 0, None
    while at < len(data) or not at:
        end = at + max(PASSAGE, CHUNK - CHUNK % PASSAGE)
        if end < len(data) and (line := data.rfind(b"\n", at, end)) > at:
            end = line + 1
        x, before = passages(data[at:end], before)
        yield x
        at = end


class Attention:
    """Encoder, gated attention and linear score over bags of passages."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {
            "W": r.normal(0, 0.3, (N_FEATURES, hidden)), "b": np.zeros(hidden), "V": r.normal(0, 0.3, (hidden, gate)), "v": np.zeros(gate),
            "U": r.normal(0, 0.3, (hidden, gate)), "u": np.zeros(gate), "w": r.normal(0, 0.3, gate), "c": r.normal(0, 0.3, hidden), "o": np.zeros(1),
        }

    def encoded(self, x: np.ndarray) -> dict:
        """Scaled features, code, both factors of the gate, and attention before it is normalised."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"] + p["v"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        return {"x": x, "h": h, "a": a, "g": g, "s": (a * g) @ p["w"]}

    def output(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["o"], -30, 30)))

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighed log loss over some bags."""
        f, p, sizes = self.encoded(x), self.p, np.diff(np.append(starts, len(x)))
        h, a, g, s = f["h"], f["a"], f["g"], f["s"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        t = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(t[:, None] * h, starts, axis=0)
        do = (self.output(z) - y) * weight
        dz = np.repeat(do[:, None] * p["c"], sizes, axis=0)
        dt = (dz * h).sum(axis=1)
        ds = t * (dt - np.repeat(np.add.reduceat(t * dt, starts), sizes))
        dag = ds[:, None] * p["w"]
        da, dg = dag * g * (1 - a * a), dag * a * g * (1 - g)
        dh = (t[:, None] * dz + da @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ da, "v": da.sum(axis=0), "U": h.T @ dg, "u": dg.sum(axis=0), "w": (a * g).T @ ds, "c": z.T @ do, "o": do.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, steps: int = 600, batch: int = 256, rate: float = 0.01, decay: float = 1e-3) -> Attention:
        """Adam over batches of documents, classes weighed alike, the rate falling to nothing."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0, dtype=float), every.std(axis=0, dtype=float) + 1e-3
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        r, m, v = np.random.default_rng(5), {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        order: list[int] = []
        for i in range(1, steps + 1):
            if not order:
                order = list(r.permutation(len(bags)))
            take, order = sorted(order[:batch]), order[batch:]
            some = [bags[j] for j in take]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in some])[:-1]]).astype(int)
            grad = self.gradient(np.concatenate(some).astype(float), starts, y[take], weight[take] / len(take))
            for k, d in grad.items():
                d = d + decay * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                self.p[k] = self.p[k] - rate * (1 - (i - 1) / steps) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-9)
        return self

    def scores(self, texts: Iterable[bytes | None], held: int = 4000) -> np.ndarray:
        """Scores of whole texts; passages are pooled some at a time, with running maxima of the attention."""
        top, total, z = [], [], []
        waiting: list[tuple[int, np.ndarray]] = []
        rows = 0

        def pool():
            x = np.concatenate([x for _, x in waiting]).astype(float)
            f = self.encoded(x)
            starts = np.concatenate([[0], np.cumsum([len(x) for _, x in waiting])[:-1]]).astype(int)
            most = np.maximum.reduceat(f["s"], starts)
            e = np.exp(f["s"] - np.repeat(most, [len(x) for _, x in waiting]))
            sums, codes = np.add.reduceat(e, starts), np.add.reduceat(e[:, None] * f["h"], starts, axis=0)
            for (i, _), m, t, c in zip(waiting, most, sums, codes, strict=True):
                both = max(top[i], m)
                old, new = np.exp(top[i] - both), np.exp(m - both)
                top[i], total[i], z[i] = both, total[i] * old + t * new, z[i] * old + c * new
            waiting.clear()

        for i, data in enumerate(texts):
            top.append(-np.inf)
            total.append(0.0)
            z.append(np.zeros(len(self.p["c"])))
            for x in pieces(data):
                waiting.append((i, x))
                rows += len(x)
                if rows >= held:
                    pool()
                    rows = 0
        if waiting:
            pool()
        # Rounded, as the last digits of a product of matrices depend on a row's place in it.
        return np.round(self.output(np.array(z) / np.array(total)[:, None]), 9) if z else np.empty(0)


@in_small_batches
def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Attention | None:
    """A model from at most per_class labelled rows of each class, taken by hash of id; None if there is no label.

    Null labels and ids do not count; of several labels of an id the least counts.  Different texts under one id
    are each an example, repeated rows one.  Rows are read whole; of a class they are taken by hash as long as
    there are per_class at most and they have PER_CLASS_PASSAGES passages at most in all (the first one in any case).
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y"))
    sample = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(saved(sample[0].union(sample[1])))  # 2 * per_class ids at most
    rows = renamed(docs, id_col, text_col).join(picked, "_id").select("_id", F.coalesce("_text", F.lit("")).cast("binary").alias("_text"), "_y")
    rows = saved(rows.withColumn("_h", F.sha2("_text", 256)).dropDuplicates(["_id", "_h"]))
    lines = F.length("_text") - F.length(F.replace(F.decode("_text", "ISO-8859-1"), F.lit("\n"), F.lit(""))) + 1
    size = (lines + F.floor(F.length("_text") / PASSAGE)).alias("_n")  # as many passages at most
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_id", "_h"), "_id", "_h")
    sized = rows.select("_id", "_h", "_y", size).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_class)
    taken = sized.withColumn("_n", F.sum("_n").over(order)).filter((F.col("_r") == 1) | (F.col("_n") <= PER_CLASS_PASSAGES))
    rows = rows.join(F.broadcast(saved(taken.select("_id", "_h"))), ["_id", "_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [np.concatenate(list(pieces(x.as_py()))).astype(np.float16).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bags, pa.binary())], ["_id", "_y", "bag"])

    found = sorted((r[0], r[1], r[2]) for r in rows.select("_id", "_text", "_y").mapInArrow(run, "_id long, _y int, bag binary").collect())
    if not found:
        return None
    return Attention().fit([np.frombuffer(x, np.float16).reshape(-1, N_FEATURES).astype(np.float32) for _, _, x in found], np.array([y for _, y, _ in found], float))


@in_small_batches
def score(docs: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row; null text counts as empty, which is one passage of zeros.

    Repeated rows score alike, each for itself; texts of any length are read to their end.  Without a model
    every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)), pa.float64())], ["_id", "score"])

    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long"), F.col("_text").cast("binary"))
    return saved(rows.mapInArrow(run, "_id long, score double")).withColumnRenamed("_id", id_col)


def _scores(model: Attention | None, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.scores(x.as_py() for x in texts)


def held_out(id_col: str = "doc_id"):
    """Rows that no fit sees: crc32 of the id as text leaves 1 modulo 3 (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@in_small_batches
def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without those that score below one half, in one pass; without labels all stay."""
    model = fit(docs, labels.filter(~held_out(id_col)), id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(at).cast(pa.binary())) >= 0.5))

    ship(docs.sparkSession)
    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
