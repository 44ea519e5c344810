"""Arrays of integers as bytes, byte plane by byte plane, so that Spark's codecs shrink their zeros."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.large_binary() if sum(map(len, rows)) > 1 << 30 else pa.binary())


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By range of the hash, so that sorted hashes are sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
