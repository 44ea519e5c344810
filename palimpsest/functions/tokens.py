"""Tokens of many texts at once: cut, hashed and counted in arrays, without a Python object for a token."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from . import words

#: UTF-16 units of texts that are cut at a time; a longer text is not cut here.
UNITS = 1 << 19
#: Bases of the hash that embeddings use, and of one that tells tokens apart.
BASE, KEY_BASE = 31, 0x9E6D3F5A7C41B2E5
#: Keeps equal tokens of different texts apart.
ROW = np.uint64(0xD1B54A32D192ED03)


@cache
def _word() -> np.ndarray:
    """For each UTF-16 unit whether re's \\w has it; no half of a pair is one."""
    return np.array([c == 0x5F or chr(c).isalnum() for c in range(1 << 16)])


def _powers(base: int, n: int, kind: type) -> np.ndarray:
    p = np.full(n, base & np.iinfo(kind).max, kind)
    p[:1] = 1
    return np.cumprod(p, dtype=kind)


@cache
def _tables(base: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2^32 or 2^64, and of its inverse."""
    return _powers(base, UNITS + 1, kind), _powers(pow(base, -1, int(np.iinfo(kind).max) + 1), UNITS + 1, kind)


def _size(text: str) -> int:
    return len(text) + 1 if text.isascii() else 3 * len(text) + 1  # lower() makes three units of one at most


def fits(text: str) -> bool:
    """Whether Tokens takes it: no character is a pair of units, and it is not too long."""
    return _size(text) <= UNITS and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text))


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Places from and to of texts that are cut together; each fits."""
    lo = size = 0
    for i, n in enumerate(map(_size, texts)):
        if size + n > UNITS and i > lo:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


class Tokens:
    """The lower-cased tokens of some texts, in order: row, start and end in the units of all texts."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.n, self.joined = len(low), "".join(f"{t}\n" for t in low)
        self.units = np.frombuffer(self.joined.encode("utf-16-le"), "<u2")
        word = _word()[self.units]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        edge = np.concatenate([[0], edge]) if len(word) and word[0] else edge
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
        self.row = np.repeat(np.arange(self.n), np.diff(np.searchsorted(self.start, ends), prepend=0))

    def hashes(self, base: int, kind: type, seed: int = 0) -> np.ndarray:
        """h = base h + unit over the units of each token, from sums over all units: the base has an inverse."""
        up, down = _tables(base, kind)
        total = np.zeros(len(self.units) + 1, kind)
        np.cumsum(self.units * down[: len(self.units)], dtype=kind, out=total[1:])
        h = (total[self.end] - total[self.start]) * up[self.end - 1]
        return h + kind(seed & int(np.iinfo(kind).max)) * up[self.end - self.start] if seed else h

    def bins(self, dim: int, seed: int = 0) -> np.ndarray:
        """(texts, dim): tokens by the absolute value of their 32-bit hash modulo dim."""
        h = np.abs(self.hashes(BASE, np.uint32, seed).view(np.int32).astype(np.int64))
        return np.bincount(self.row * dim + h % dim, minlength=self.n * dim).reshape(self.n, dim)

    def keywords(self, n: int) -> list[list[str]]:
        """As text.most_frequent of each text.  Tokens are told apart by 64-bit hashes."""
        out: list[list[str]] = [[] for _ in range(self.n)]
        h = self.hashes(KEY_BASE, np.uint64)
        key = h + self.row.astype(np.uint64) * ROW
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([np.ones(len(key[:1]), bool), key[1:] != key[:-1]]))
        if not len(at):
            return out
        first, count = np.minimum.reduceat(order, at), np.diff(at, append=len(key))
        fit = self.end[first] - self.start[first] > 1
        often = np.flatnonzero(fit & (count > 1))
        often = often[~np.isin(h[first[often]], _stop())]
        few = np.bincount(self.row[first[often]], minlength=self.n) < n  # tokens that occur once are looked at only there
        once = np.flatnonzero(fit & (count == 1) & few[self.row[first]])
        some = np.concatenate([often, once[~np.isin(h[first[once]], _stop())]])
        first, count = first[some], count[some]
        row = self.row[first]
        order = np.lexsort((first, -count, row))
        row, first = row[order], first[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < n
        for r, s, e in zip(row[top].tolist(), self.start[first[top]].tolist(), self.end[first[top]].tolist(), strict=True):
            out[r].append(self.joined[s:e])
        return out


@cache
def _stop() -> np.ndarray:
    return Tokens([w for w in words.STOP if fits(w)]).hashes(KEY_BASE, np.uint64)
