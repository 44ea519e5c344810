"""Toxicity by a classifier chain.

Categories come from the labels: "prose" (toxic, of good quality), "junk" (toxic, of bad quality), and last
"toxic", the decision.  Each link is a linear (logistic) model over the terms chosen for it, a few measures
of the text, and the probabilities of the categories before it.  For training those are predicted out of
fold, by models whose terms were also chosen without the fold, so that a later model sees them as noisy as
it will in use.

Terms are lower-cased words and their prefixes of 4 to 8 letters, chosen by how much the label depends on
them.  Scoring looks at every word of every whole text and keeps nothing of it but counts of chosen terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_small_batches, renamed, saved

#: Conditions over the columns of labels, in the order of the chain; the last is the decision.
CATEGORIES = {"prose": "toxic = 1 and quality = 1", "junk": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}
#: Labelled rows of each class that a fit reads at most, terms that it keeps at most, folds.
PER_CLASS, TERMS, FOLDS = 3000, 1500, 5
PREFIXES = (4, 5, 6, 7, 8)
_HEAD = min(PREFIXES)
_WORD = regex.compile(r"\p{L}+")
_PIECE, _HELD = 1 << 20, 100_000


def terms(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n))


def words(text: str) -> Iterator[list[str]]:
    """Lower-cased words of a whole text, piece by piece; pieces end between words."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            while end < len(text) and text[end].isalpha():
                end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


class Index(dict):
    """Term -> number.  A word whose first letters begin no term is passed over at once."""

    def __init__(self, chosen: Iterable[str]):
        super().__init__((t, i) for i, t in enumerate(chosen))
        self.heads = frozenset(t.rstrip("*")[:_HEAD] for t in self)

    def features(self, text: str | None) -> tuple[dict[int, int], list[float]]:
        """Counts of the chosen terms; number of words, of letters, of characters and of different words, all of the whole text."""
        counts, n, letters, heads, different = {}, 0, 0, self.heads, None
        for some in words(text or ""):
            n += len(some)
            letters += sum(map(len, some))
            own = set(some)
            if different is None and len(text) <= _PIECE:
                different = own
            else:  # of a long text a hash for each different word so far
                hashes = np.fromiter(map(hash, own), np.int64, len(own))
                different = np.union1d(hashes if different is None else different, hashes)
            for w in some:
                if w[:_HEAD] in heads:
                    for t in terms(w):
                        if (i := self.get(t)) is not None:
                            counts[i] = counts.get(i, 0) + 1
        return counts, [n, letters, len(text or ""), 0 if different is None else len(different)]


class Bags:
    """Term counts of many texts as (row, col, count) and the measures of each text."""

    def __init__(self, found: list[tuple[dict[int, int], list[float]]]):
        self.n = len(found)
        self.row = np.repeat(np.arange(self.n), [len(c) for c, _ in found])
        self.col = np.fromiter((i for c, _ in found for i in c), np.int64, len(self.row))
        self.count = np.fromiter((k for c, _ in found for k in c.values()), float, len(self.row))
        self.size = np.array([m for _, m in found], float).reshape(self.n, 4)

    def only(self, rows: np.ndarray) -> Bags:
        """The rows of a mask."""
        new = object.__new__(Bags)
        keep = rows[self.row]
        new.n, new.size = int(rows.sum()), self.size[rows]
        new.row, new.col, new.count = (np.cumsum(rows) - 1)[self.row[keep]], self.col[keep], self.count[keep]
        return new


class Link:
    """A logistic model over the presence of some terms, measures of the text and earlier probabilities."""

    def __init__(self, known: np.ndarray, earlier: int):
        self.known = known  # mask over all terms: those that this model may look at
        self.w, self.v = np.zeros(len(known)), np.zeros(8 + earlier)

    def dense(self, x: Bags, before: np.ndarray) -> np.ndarray:
        """One; any term, different ones, occurrences and their rate, damped; other characters, word length, new words; earlier probabilities."""
        mine = self.known[x.col]
        kinds = np.bincount(x.row[mine], minlength=x.n)
        total = np.bincount(x.row[mine], x.count[mine], x.n)
        n, letters, chars, new = np.maximum(x.size, 1).T
        rest = np.where(x.size[:, 2] > 0, 1 - x.size[:, 1] / chars, 0)
        return np.column_stack([np.ones(x.n), kinds > 0, np.log1p(kinds), np.log1p(total), np.log1p(1000 * total / n), rest, x.size[:, 1] / n / 10, x.size[:, 3] / n, before])

    def predict(self, x: Bags, before: np.ndarray) -> np.ndarray:
        z = np.bincount(x.row, (self.w * self.known)[x.col], x.n) + self.dense(x, before) @ self.v
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, x: Bags, before: np.ndarray, y: np.ndarray, decay: float = 0.003, steps: int = 300) -> Link:
        """Adam on the mean log loss; rows weigh alike, so that a rare class needs evidence."""
        dense, k = self.dense(x, before), len(self.w)
        mine = self.known[x.col]
        row, col = x.row[mine], x.col[mine]
        p, m, v = np.zeros(k + dense.shape[1]), 0.0, 0.0
        held = np.concatenate([np.full(k, decay), [0.0], np.full(dense.shape[1] - 1, decay)])
        for i in range(1, steps + 1):
            z = np.bincount(row, p[:k][col], x.n) + dense @ p[k:]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / x.n
            g = np.concatenate([np.bincount(col, d[row], k), dense.T @ d]) + held * p
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p = p - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        self.w, self.v = p[:k], p[k:]
        return self


class Chain:
    """Links of the categories in order; link k also sees the probabilities of categories before k."""

    def __init__(self, names: list[str], chosen: list[str]):
        self.names, self.index, self.links = names, Index(chosen), []

    def fit(self, x: Bags, targets: np.ndarray, fold: np.ndarray, known: dict[int, np.ndarray]) -> Chain:
        """known: for each fold the terms chosen without its rows, at -1 those chosen on all rows."""
        before = np.zeros((x.n, 0))
        for k in range(targets.shape[1]):
            self.links.append(Link(known[-1], k).fit(x, before, targets[:, k]))
            outside = np.zeros(x.n)
            for f in np.unique(fold):
                own, rest = fold == f, fold != f
                link = Link(known[f], k).fit(x.only(rest), before[rest], targets[rest, k]) if rest.any() else self.links[-1]
                outside[own] = link.predict(x.only(own), before[own])
            before = np.column_stack([before, outside])
        return self

    def predict(self, x: Bags) -> np.ndarray:
        before = np.zeros((x.n, 0))
        for link in self.links:
            before = np.column_stack([before, link.predict(x, before)])
        return before


def hash_fold(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 >> 17) % FOLDS


def choose(sample: DataFrame, n_terms: int = TERMS, support: int = 3) -> dict[int, list[str]]:
    """For each fold, the terms that speak most for label 1 in the other folds' rows (_text, _y, _id); at -1 in all rows.

    A term counts once a document.  The counts are a table; the driver gets n_terms of them a fold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen):
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in keys], pa.string()), pa.array([f for _, f, _ in keys], pa.int32()), pa.array([y for _, _, y in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["t", "f", "y", "n"])

        seen: dict[tuple, int] = {}
        for b in batches:
            for x, y, i in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                f, told = hash_fold(i), set()
                for some in words(x.as_py() or ""):
                    told.update(t for w in set(some) for t in terms(w))
                for t in told:
                    seen[t, f, y] = seen.get((t, f, y), 0) + 1
                    if len(seen) >= _HELD:
                        yield out(seen)
                        seen = {}
        yield out(seen)

    totals: dict[tuple[int, int], int] = {}
    for r in sample.select("_id", "_y").collect():  # as many as the sample has
        totals[hash_fold(r[0]), r[1]] = totals.get((hash_fold(r[0]), r[1]), 0) + 1
    counts = sample.mapInArrow(run, "t string, f int, y int, n long").groupBy("t").agg(*[F.coalesce(F.sum(F.when((F.col("f") == f) & (F.col("y") == y), F.col("n"))), F.lit(0)).alias(f"n{y}_{f}") for f in range(FOLDS) for y in (0, 1)])
    counts = saved(counts.filter(sum(F.col(f"n1_{f}") for f in range(FOLDS)) >= support))
    chosen = {}
    for without in range(-1, FOLDS):
        folds = [f for f in range(FOLDS) if f != without]
        n0, n1 = (sum(F.col(f"n{y}_{f}") for f in folds) for y in (0, 1))
        all0, all1 = (sum(totals.get((f, y), 0) for f in folds) for y in (0, 1))
        odds = F.log((n1 + 0.5) / (all1 + 1)) - F.log((n0 + 0.5) / (all0 + 1))
        best = counts.select("t", n1.alias("n1"), odds.alias("odds")).filter((F.col("n1") >= support) & (F.col("odds") > 2))
        chosen[without] = [r.t for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "t").limit(n_terms).collect()]
    return chosen


@in_small_batches
def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", categories: dict[str, str] | None = None, per_class: int = PER_CLASS) -> Chain | None:
    """A chain from at most per_class labelled rows of each class, by hash of id; None without both classes.

    Labels that are null do not count; of several labels of an id the one with the greatest values counts.
    categories: name -> condition over the columns of labels, the decision last; where labels have no
    "quality" the decision is the only one.  Different texts under one id are each an example, repeated rows one.
    """
    if categories is None:
        categories = CATEGORIES if "quality" in labels.columns else {"toxic": f"{label_col} = 1"}
    names = list(categories)
    told = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    told = told.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"), F.array(*[F.coalesce(F.expr(c), F.lit(False)).cast("int") for c in categories.values()]).alias("_c"))
    known = told.groupBy("_id").agg(F.max(F.struct("_y", "_c")).alias("_t")).select("_id", "_t._y", "_t._c")
    some = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    picked = saved(some[0].union(some[1]))
    if picked.select("_y").distinct().count() < 2:
        return None
    # The texts are read once, spread over tasks, and kept; of each class per_class different rows at most.
    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), "_text")
    rows = rows.join(F.broadcast(picked), "_id").withColumn("_h", F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256))
    rows = saved(rows.dropDuplicates(["_id", "_h"]))
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_id", "_h"), "_id", "_h")
    taken = rows.select("_id", "_h", "_y").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_class)
    sample = saved(rows.join(F.broadcast(saved(taken.select("_id", "_h"))), ["_id", "_h"]).select("_text", "_y", "_id", "_c"))
    chosen = choose(sample.select("_text", "_y", "_id"))
    chain = Chain(names, sorted(set().union(*chosen.values())))
    index = chain.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [index.features(x.as_py()) for x in b.column(0)]
            cols = [pa.array([list(c) for c, _ in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int64())), pa.array([m for _, m in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *cols], ["_id", "_c", "terms", "counts", "size"])

    got = sorted(sample.select("_text", "_id", "_c").mapInArrow(run, "_id long, _c array<int>, terms array<int>, counts array<long>, size array<double>").collect(), key=str)
    if not got:
        return None
    x = Bags([(dict(zip(r.terms, r.counts, strict=True)), r["size"]) for r in got])
    masks = {f: np.isin(np.arange(len(index)), [index[t] for t in own]) for f, own in chosen.items()}
    return chain.fit(x, np.array([r._c for r in got], float), np.array([hash_fold(r._id) for r in got]), masks)


@in_small_batches
def score(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", names: Iterable[str] = tuple(CATEGORIES)) -> DataFrame:
    """id, p_<category> for each link, toxic (1 if the last link's probability is 0.5 or more) of every row.

    Null and empty texts have no term and score as such.  Repeated rows score alike, each for itself.  Texts
    of any length are read to their end, a piece at a time.  Without a chain (no labels of one class) every
    probability is 0 and the columns are those of names.
    """
    names = chain.names if chain else list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.predict(Bags([chain.index.features(x.as_py()) for x in b.column(1)])) if chain else np.zeros((len(b), len(names)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(len(names)))], ["_id", *(f"p_{n}" for n in names)])

    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long"), "_text")
    out = saved(rows.mapInArrow(run, "_id long, " + ", ".join(f"p_{n} double" for n in names)))
    return out.select(F.col("_id").alias(id_col), *(f"p_{n}" for n in names), (F.col(f"p_{names[-1]}") >= 0.5).cast("int").alias("toxic"))
