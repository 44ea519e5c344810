"""Language identification: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of WINDOW bytes, from its first to its last.  In each window one
gated recurrence runs forward and one backward; at every byte both states give probabilities of the
languages, and a document has the mean over all of its bytes.  The network is trained by backpropagation
through time; every byte of a training window has the language of its document as target.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_small_batches, renamed, saved

WINDOW, HIDDEN, HELD = 128, 10, 2048
#: What a fit reads at most: languages (the most frequent), labelled rows of each by hash of the id, and windows of these rows by hash.
LANGS, PER_LANG, WINDOWS = 200, 1000, 1500
#: The answer for texts without a letter.
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit sees: crc32 of the id as text leaves 2 modulo 4 (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of some bytes, zeros after the last byte, and the number of bytes of each."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    sizes = np.full(n, WINDOW)
    if n:
        sizes[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), sizes


class Network:
    """Both recurrences and the layer that labels positions.  Arrays are (units, windows), windows by falling size.

    A direction has X (what a byte adds to the reset, update and new-state gates) and U (what the state adds).
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11, dtype: type = np.float32):
        r, self.langs, self.hidden = np.random.default_rng(seed), langs, hidden
        p = {"o": np.zeros((len(langs), 1))}
        for d in "fb":
            p |= {f"X{d}": r.normal(0, 0.3, (3 * hidden, 256)), f"U{d}": r.normal(0, hidden**-0.5, (3 * hidden, hidden)), f"O{d}": r.normal(0, hidden**-0.5, (len(langs), hidden))}
        self.p = {k: v.astype(dtype) for k, v in p.items()}

    def steps(self, d: str, sizes: np.ndarray) -> list[tuple[int, int]]:
        """(position, windows that reach it) in the order of a direction."""
        active = [(t, int(np.searchsorted(-sizes, -t, "left"))) for t in range(int(sizes[0]))]
        return active if d == "f" else active[::-1]

    def states(self, d: str, x: np.ndarray, sizes: np.ndarray, keep: bool = False) -> Iterator[tuple]:
        """position, windows, states after it; with keep also the gates and the states before."""
        h, (inward, own) = np.zeros((self.hidden, len(sizes)), self.p["o"].dtype), (self.p[f"X{d}"], self.p[f"U{d}"])
        k, half = self.hidden, self.p["o"].dtype.type(0.5)
        for t, n in self.steps(d, sizes):
            a, g, old = np.take(inward, x[t, :n], axis=1), own @ h[:, :n], h[:, :n]
            gates = a[: 2 * k]
            gates += g[: 2 * k]
            gates *= half
            np.tanh(gates, out=gates)  # the logistic function, by the tangent
            gates *= half
            gates += half
            new = a[2 * k :]
            new += gates[:k] * g[2 * k :]
            np.tanh(new, out=new)
            if keep:
                before = old.copy()
            old -= new
            old *= gates[k:]
            old += new
            yield (t, n, old.copy(), gates, new, g[2 * k :], before) if keep else (t, n, old)

    def label(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums over the positions of each window of the languages' probabilities, windows by falling size; x is (position, window)."""
        logits = np.empty((int(sizes[0]), len(self.langs), len(sizes)), self.p["o"].dtype)
        for t, n, h in self.states("f", x, sizes):
            np.matmul(self.p["Of"], h, out=logits[t, :, :n])
        total = np.zeros((len(self.langs), len(sizes)))
        for t, n, h in self.states("b", x, sizes):
            y = logits[t, :, :n]
            y += self.p["Ob"] @ h
            y += self.p["o"]
            y -= y.max(axis=0)
            np.exp(y, out=y)
            y /= y.sum(axis=0)
            total[:, :n] += y
        return total

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over all positions, and its gradient, by backpropagation through time."""
        p, k, m = self.p, self.hidden, float(sizes.sum())
        kept = {d: list(self.states(d, x, sizes, True)) for d in "fb"}
        behind = {s[0]: s for s in kept["b"]}
        grad, errors, loss = {name: np.zeros_like(v) for name, v in p.items()}, {}, 0.0
        for t, n, h, *_ in kept["f"]:
            z = p["Of"] @ h + p["Ob"] @ behind[t][2] + p["o"]
            z -= z.max(axis=0)
            e = np.exp(z)
            e /= e.sum(axis=0)
            at = y[:n], np.arange(n)
            loss -= float(np.log(np.maximum(e[at], 1e-30)).sum())
            e[at] -= 1
            e /= m
            errors[t] = e
            grad["Of"] += e @ h.T
            grad["Ob"] += e @ behind[t][2].T
            grad["o"] += e.sum(axis=1, keepdims=True)
        for d in "fb":
            carry, bytes_, inward = np.zeros((k, len(sizes)), p["o"].dtype), [], []
            for t, n, _, gates, new, pull, before in reversed(kept[d]):
                reset, keep = gates[:k], gates[k:]
                dh = carry[:, :n] + p[f"O{d}"].T @ errors[t]
                dnew = dh * (1 - keep) * (1 - new * new)
                dkeep = dh * (before - new) * keep * (1 - keep)
                dreset = dnew * pull * reset * (1 - reset)
                both = np.concatenate([dreset, dkeep, dnew * reset])
                grad[f"U{d}"] += both @ before.T
                carry[:, :n] = dh * keep + p[f"U{d}"].T @ both
                bytes_.append(x[t, :n])
                inward.append(np.concatenate([dreset, dkeep, dnew]))
            at, flow = np.concatenate(bytes_), np.concatenate(inward, axis=1)
            for i in range(3 * k):
                grad[f"X{d}"][i] = np.bincount(at, flow[i], 256)
        return loss / m, grad

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 350, batch: int = 128, rate: float = 0.02) -> Network:
        """Adam; languages come in equal shares, the rate falls to nothing, steep gradients are shortened."""
        r = np.random.default_rng(13)
        pools = [list(r.permutation(np.flatnonzero(y == c))) for c in range(len(self.langs))]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in "mv")
        turn = 0
        for i in range(1, steps + 1):
            take = []
            for _ in range(batch):
                pool = pools[turn % len(pools)]
                take.append(pool[(turn // len(pools)) % len(pool)])
                turn += 1
            take = np.array(take)[np.argsort(-sizes[take], kind="stable")]
            _, grad = self.gradient(np.ascontiguousarray(x[take].T), sizes[take], y[take])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                step = rate * (1 - (i - 1) / steps) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
                self.p[k] = (self.p[k] - step).astype(self.p[k].dtype)
        return self

    def probabilities(self, texts: Iterable[bytes | None], held: int = HELD) -> np.ndarray:
        """Of each text the mean over its bytes, (texts, languages); zeros for one without bytes.

        Windows are labelled some at a time, from short and long texts alike, so a text of any length takes bounded memory.
        """
        total: list[np.ndarray] = []
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            own = np.repeat([i for i, _, _ in waiting], [len(s) for _, _, s in waiting])
            x, sizes = np.concatenate([x for _, x, _ in waiting]), np.concatenate([s for _, _, s in waiting])
            waiting.clear()
            order = np.argsort(-sizes, kind="stable")
            found = self.label(np.ascontiguousarray(x[order].T), sizes[order])
            for i, column in zip(own[order], found.T, strict=True):
                total[i] += column

        lengths, rows = [], 0
        for i, text in enumerate(texts):
            data = np.frombuffer(text or b"", np.uint8)
            total.append(np.zeros(len(self.langs)))
            lengths.append(max(1, len(data)))
            for at in range(0, len(data), held * WINDOW):
                x, sizes = windows(data[at : at + held * WINDOW])
                waiting.append((i, x, sizes))
                rows += len(sizes)
                if rows >= held:
                    flush()
                    rows = 0
        if waiting:
            flush()
        return np.array(total).reshape(-1, len(self.langs)) / np.array(lengths)[:, None] if total else np.zeros((0, len(self.langs)))


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


@in_small_batches
def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most: int = WINDOWS) -> Network | None:
    """A network from rows with a language and a letter; None if there is none.

    Ids pick the rows, by hash, and all windows of the picked rows' whole texts stand for choice; of a language's different
    windows the first by hash are taken, so repeated rows, also millions of one id, count once.  Null ids do not count.
    """
    rows = renamed(docs, id_col, text_col, lang_col).filter("_lang IS NOT NULL AND _id IS NOT NULL").withColumn("_h", F.xxhash64("_id"))
    counted = rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(LANGS)
    share = (2 * per_lang + 100) / F.col("n")  # of the range of hashes: some more rows than are taken, so that no language is sorted whole
    first = Window.partitionBy("_lang").orderBy("_h")
    low = rows.select("_lang", "_h").join(F.broadcast(saved(counted)), "_lang").filter(F.col("_h") / 2.0**64 + 0.5 <= share)
    cut = low.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_lang).groupBy("_lang").agg(F.max("_h").alias("_cut"))
    cut = F.broadcast(saved(cut))  # LANGS rows at most
    picked = rows.join(cut, "_lang").filter((F.col("_h") <= F.col("_cut")) & has_letter("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                for at in range(0, len(text), 1000 * WINDOW):
                    piece = [text[i : i + WINDOW] for i in range(at, min(len(text), at + 1000 * WINDOW), WINDOW)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(piece)), pa.array(piece, pa.binary())], ["lang", "x"])

    cuts = picked.select("_lang", F.col("_text").cast("binary")).mapInArrow(run, "lang string, x binary").distinct()
    w = Window.partitionBy("lang").orderBy(F.xxhash64("x"), "x")
    found = cuts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select("lang", "x").collect()  # LANGS * most windows at most
    if not found:
        return None
    found = sorted((r[0], bytes(r[1])) for r in found)
    langs = sorted({lang for lang, _ in found})
    x, sizes = (np.concatenate(a) for a in zip(*[windows(np.frombuffer(piece, np.uint8)) for _, piece in found], strict=True))
    return Network(langs).fit(x, sizes, np.array([langs.index(lang) for lang, _ in found]))


@in_small_batches
def identify(docs: DataFrame, model: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row, from its whole text alone.

    lang_pred is the language of the highest mean probability, ties by the first in order, and score that
    probability.  Null texts, texts without a letter, and all texts when there is no model are "und" with score 0.
    Repeated rows each have their row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None:
                asked = np.flatnonzero(b.column(1).to_numpy(zero_copy_only=False))
                texts = b.column(2)
                # Rounded, as the last digits of a product of matrices depend on a row's place in it.
                found = np.round(model.probabilities(texts[int(i)].as_py() for i in asked), 5)
                best = found.argmax(axis=1)
                lang[asked], score[asked] = np.array(model.langs, object)[best], found[np.arange(len(asked)), best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["_id", "lang_pred", "score"])

    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), has_letter("_text").alias("_some"), F.col("_text").cast("binary").alias("_text"))
    return saved(rows.mapInArrow(run, "_id long, lang_pred string, score double")).withColumnRenamed("_id", id_col)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row, by a network fit on the rows that are not held out."""
    model = fit(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    return identify(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
