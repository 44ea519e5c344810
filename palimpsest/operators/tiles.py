"""Products of two tables of vectors, block by block: packing, pairing of blocks, and the k best so far of each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.shipping import ship
from palimpsest.storage import durable, setting

#: Most components of a block, bytes of blocks that are broadcast at most, and what a row counts there at least.
BLOCK_CELLS, BROADCAST_BYTES, ROW_BYTES = 1 << 18, 48 << 20, 512
#: What the state of a left block takes besides its entries, as a number of entries.
STATE_CELLS = 256
#: Bytes of pairs of blocks that go to Python at a time.
BATCH_BYTES = 12 << 20
#: Tasks a core that blocks of a saved table are read by at most, as each finds the k best of every row for itself.
TASKS = 2
#: Of so many scores in float32 one may come near enough to be worked out in float64 by itself; else a whole pair of blocks is.
FEW = 16
#: Scores that are worked out by themselves at a time.
EXACT = 1 << 14


def packed(df: DataFrame, vector: str, rows: int, unit: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame in blocks of at most rows rows: m (row-major float64), width, and each other column as an array.

    Vectors (array<double>) of unlike lengths are filled up with zeros to the longest of a block; with unit each
    is divided by its norm.  by: whole-number columns by which a partition is sorted; a block has one value of
    each, which stays a column.
    """
    ship(df.sparkSession)
    others = [f for f in df.schema.fields if f.name != vector and f.name not in by]
    plain = df.select(vector, *[f.name for f in others], *by)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column(0).combine_chunks()
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        width = max(1, int(sizes.max()))
        m = np.zeros((len(sizes), width))
        m[np.arange(width) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
        if unit:
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m /= np.where(norm > 0, norm, 1)
        ends = pa.array([0, len(sizes)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, t.column(i + 1).combine_chunks()) for i in range(len(others))]
        keys = [t.column(c).combine_chunks().slice(0, 1) for c in by]
        return pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()), pa.array([width], pa.int32()), *lists, *keys], ["m", "width", *[f.name for f in others], *by])

    def runs(b: pa.RecordBatch, last: tuple | None) -> Iterator[tuple[pa.RecordBatch, bool]]:
        """Parts of a batch with the same by, and whether a part goes on with what came before."""
        if not by:
            yield b, True
            return
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in by], axis=1)
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(b)]])
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            yield b.slice(lo, hi - lo), lo == 0 and tuple(keys[lo]) == last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, cells, last = [], 0, 0, None
        for b in batches:
            for some, goes_on in runs(b, last):
                if held and not goes_on:
                    yield block(held)
                    held, n, cells = [], 0, 0
                last = tuple(some.column(c)[0].as_py() for c in by) if by and len(some) else last
                at = 0
                while at < len(some):
                    part = some.slice(at, min(rows - n, len(some) - at))
                    at += len(part)
                    held.append(part)
                    n, cells = n + len(part), cells + len(part.column(0).flatten())
                    if n >= rows or cells >= BLOCK_CELLS:
                        yield block(held)
                        held, n, cells = [], 0, 0
        if held:
            yield block(held)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return plain.mapInArrow(run, ", ".join(["m binary", "width int", *[f"`{f.name}` array<{kinds[f.name]}>" for f in others], *[f"`{c}` {kinds[c]}" for c in by]]))


def numbered(left: DataFrame) -> DataFrame:
    """Blocks of a saved table with a number each, and the prefix l_ on all columns."""
    left = left.withColumn("number", F.monotonically_increasing_id())
    return left.withColumnsRenamed({c: f"l_{c}" for c in left.columns})


def _slices(left: DataFrame) -> int:
    """In how many slices of BROADCAST_BYTES at most a saved table goes to all tasks."""
    bytes_of = F.greatest(F.length("m"), F.length("m") / (8 * F.col("width")) * ROW_BYTES)
    size, blocks = left.agg(F.sum(bytes_of).cast("long"), F.count("*")).first()
    return min(blocks, -(-(size or 0) // BROADCAST_BYTES)) or 1


def paired(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ()) -> list[DataFrame]:
    """Frames that together have each block of left beside each block of right (with on: of equal by columns) once.

    Left is a saved table; its columns come numbered and with the prefix l_.  It is cut into slices of
    BROADCAST_BYTES at most, a frame each, which is broadcast; right stays where it is and is read once a slice,
    and of its blocks a task holds one at a time.  With on and more than one slice both sides are dealt out by on
    instead, as a block meets few others and reading right once a slice would grow with the square.
    """
    slices = _slices(left)
    if on and slices > 1:
        return [right.join(numbered(left), reduce(and_, [F.col(c) == F.col(f"l_{c}") for c in on]))]
    left = numbered(left).withColumn("l__s", F.pmod(F.xxhash64("l_m"), F.lit(slices)).cast("int"))
    out = []
    for i in range(slices):
        part, rows = left.filter(F.col("l__s") == i), right.withColumn("_s", F.pmod("width", F.lit(1)) + i)
        out.append(rows.join(F.broadcast(part), reduce(and_, [F.col(c) == F.col(f"l_{c}") for c in ("_s", *on)])).drop("_s", "l__s"))
    return out


def beside(left: DataFrame, right: DataFrame, schema: str, sides: tuple[Side, Side], run: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]]) -> list[DataFrame]:
    """Frames of what run makes of (number of the left block, left, right), each block of left beside each block of right once; saved.

    As paired(), but no pair is a row: a slice of left goes to the Python workers once, and a block of right is read
    once a slice, so that what is passed on grows with right and not with the pairs.  left and right are saved
    tables; sides: which columns each needs, and what run gets of row i of a batch.
    """
    sc, slices, own, other = left.sparkSession.sparkContext, _slices(left), *sides
    right = right.select(*other.columns).coalesce(TASKS * sc.defaultParallelism)
    x, out = left.withColumn("_s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices))), []
    for k in range(slices):
        sink = pa.BufferOutputStream()
        part = x.filter(F.col("_s") == k).select(*own.columns).toArrow()
        with pa.ipc.new_stream(sink, part.schema) as w:
            w.write_table(part)
        held = sc.broadcast(sink.getvalue().to_pybytes())

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            lefts = [own.of(b, i) for b in pa.ipc.open_stream(held.value) for i in range(len(b))]
            blocks = (other.of(b, i) for b in batches for i in range(len(b)))
            return run((number, a, b) for b in blocks for number, a in enumerate(lefts))

        with setting(left.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
            out.append(durable(right.mapInArrow(task, schema)))
        held.destroy()
    return out


def matrix(batch: pa.RecordBatch, i: int, prefix: str = "") -> np.ndarray:
    width = batch.column(f"{prefix}width")[i].as_py()
    return np.frombuffer(batch.column(f"{prefix}m")[i].as_buffer(), np.float64).reshape(-1, width)


def values(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both; missing components count as zeros."""
    w = min(a.shape[1], b.shape[1])
    return a[:, :w] @ b[:, :w].T


class Side(NamedTuple):
    """Columns of a table of blocks, and what is made of row i of a batch of them."""

    columns: tuple[str, ...]
    of: Callable[[pa.RecordBatch, int], object]


class Best:
    """The k entries of each of n rows with the highest score so far, ties by the smaller id (numbers, or strings as objects)."""

    def __init__(self, n: int, k: int, kind: type = np.int64):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), 0 if kind is np.int64 else "", kind)

    def add(self, rows: np.ndarray, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some rows against columns whose ids ascend, where ok.  Rows are distinct."""
        k = self.k
        good = ok & (scores >= self.score[rows, -1:])
        if good.sum() > 4 * k * len(rows) and scores.shape[1] > k:  # many: of the columns no more than k a row
            m = np.where(good, scores, -np.inf)
            kth = -np.partition(-m, k - 1, axis=1)[:, k - 1 : k]
            tie = good & (m == kth)
            good = (m > kth) | (tie & (np.cumsum(tie, axis=1) <= k))
        r, c = np.nonzero(good)
        self.add_some(rows[r], scores[r, c], ids[c])

    def add_some(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A score and an id each of some rows, which may come more than once."""
        k = self.k
        some = scores >= self.score[rows, -1]
        r, scores, ids = rows[some], scores[some], ids[some]
        if not len(r):
            return
        own, back = np.unique(r, return_inverse=True)
        row = np.concatenate([back, np.repeat(np.arange(len(own)), k)])
        score = np.concatenate([scores, self.score[own].ravel()])
        ident = np.concatenate([ids, self.id[own].ravel()])
        place_of = ident if ident.dtype != object else np.unique(ident, return_inverse=True)[1]
        order = np.lexsort((place_of, -score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        first = order[place < k].reshape(len(own), k)
        self.score[own], self.id[own] = score[first], ident[first]


def kept(pairs: Iterator[tuple], feed: Callable[..., None], out: Callable[[Best, object], pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """What feed(*pair, state) keeps of all pairs in state, {left block: (Best, more)}, made rows by out."""
    state: dict = {}
    held = 0
    for pair in pairs:
        had = len(state)
        feed(*pair, state)
        if len(state) > had:
            held += next(reversed(state.values()))[0].score.size + STATE_CELLS
        if held > most and len(state) > 1:
            yield from (out(best, more) for best, more in state.values())
            state, held = {}, 0
    yield from (out(best, more) for best, more in state.values())


def best_pairs(pairs: list[DataFrame], schema: str, feed: Callable[[pa.RecordBatch, int, dict], None], out: Callable[[Best, object], pa.RecordBatch], most: int = 1 << 22, then: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """What each task keeps of its pairs of blocks; feed updates the task's state, {left block: (Best, more)}, by a pair, out makes its rows.

    What is held is passed on in between once it comes to most entries.  Run at once, frame by frame, as the
    pairs go to Python some megabytes at a time, and kept as then leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kept(((b, i) for b in batches for i in range(len(b))), feed, out, most)

    with setting(pairs[0].sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        return reduce(DataFrame.unionByName, [durable(then(x.mapInArrow(run, schema))) for x in pairs])


def best_beside(left: DataFrame, right: DataFrame, schema: str, sides: tuple[Side, Side], feed: Callable[[int, object, object, dict], None], out: Callable[[Best, object], pa.RecordBatch], most: int = 1 << 22) -> DataFrame:
    """As best_pairs, of each block of left beside each block of right (beside); feed gets them as sides makes them."""
    return reduce(DataFrame.unionByName, beside(left, right, schema, sides, lambda pairs: kept(pairs, feed, out, most)))


class Unit:
    """A block of unit vectors (m, width, id, dim), in float32 too."""

    COLUMNS = ("m", "width", "id", "dim")

    def __init__(self, b: pa.RecordBatch, i: int):
        self.m, self.id, self.dim = matrix(b, i), values(b, i, "id"), values(b, i, "dim")
        self.narrow = self.m.astype(np.float32)
        self.alike = len(self.dim) > 0 and self.dim.min() == self.dim.max()


UNITS = (Side(Unit.COLUMNS, Unit),) * 2


def cosine_feed(k: int, digits: int) -> Callable[[int, Unit, Unit, dict], None]:
    """For pairs of blocks of unit vectors: the k best cosines of each left row among vectors of its length.

    Products in float32 say which may be among them, by a bound of their error; these are worked out in float64.
    """

    def feed(number: int, a: Unit, b: Unit, state: dict) -> None:
        if number not in state:
            state[number] = Best(len(a.id), k, object if b.id.dtype == object else np.int64), a.id
        best = state[number][0]
        width = min(a.m.shape[1], b.m.shape[1])
        off = (width + 8) * 2.0**-24 * 1.01 + 10.0**-digits  # of a product of unit vectors, a rounding, and what is compared
        s = product(a.narrow, b.narrow)
        good = s >= (best.score[:, -1:] - off).astype(np.float32)
        alike = a.alike and b.alike and a.dim[0] == b.dim[0]
        if not alike:
            good &= a.dim[:, None] == b.dim
        n = np.count_nonzero(good)
        if n > 4 * k * len(good) and s.shape[1] > k:
            kth = -np.partition(-np.where(good, s, -np.inf), k - 1, axis=1)[:, k - 1 : k]
            good &= s >= kth - np.float32(2 * off)
            n = np.count_nonzero(good)
        if n * FEW > good.size:
            order = np.argsort(b.id, kind="stable")
            s = np.round(product(a.m, b.m), digits)[:, order]
            best.add(np.arange(len(s)), s, a.dim[:, None] == b.dim[order], b.id[order])
            return
        row, col = np.divmod(np.flatnonzero(good), s.shape[1])
        exact = [np.einsum("ij,ij->i", a.m[row[at : at + EXACT], :width], b.m[col[at : at + EXACT], :width]) for at in range(0, n, EXACT)]
        if n:
            best.add_some(row, np.round(np.concatenate(exact), digits), b.id[col])

    return feed


def entries(names: list[str]) -> Callable[[Best, np.ndarray], pa.RecordBatch]:
    """Rows of (left key, id, score) under these names."""

    def out(best: Best, keys: np.ndarray) -> pa.RecordBatch:
        at = np.nonzero(best.score > -np.inf)
        typed = lambda a: pa.array(a, pa.string()) if a.dtype == object else pa.array(a)  # noqa: E731  also if there is none
        return pa.RecordBatch.from_arrays([typed(keys[at[0]]), typed(best.id[at]), pa.array(best.score[at])], names)

    return out
