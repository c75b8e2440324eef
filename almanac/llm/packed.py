"""Compact binary forms of number arrays that travel between tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_HEAD = 8
#: Keys that a row sent from a chunk to a range should hold at least.
ROW_KEYS = 64


def chunk_plan(keys: int, chunk: int, part: int) -> tuple[int, int]:
    """Keys of a chunk, and the number of ranges, for ``keys`` in all.

    Each chunk sends each range one row, so chunks and ranges, ``chunk`` and ``part`` keys at least, grow with the
    square root of the keys: rows then grow no faster than the keys do.
    """
    side = math.isqrt(ROW_KEYS * keys)
    return max(chunk, side), max(16, -(-keys // max(part, side)))


def squeeze(values: np.ndarray, kind: str) -> bytes:
    """Byte planes of the values as little-endian ``kind``, compressed: planes of equal bytes cost next to nothing."""
    raw = np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()
    return len(values).to_bytes(_HEAD, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:_HEAD], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(data[_HEAD:], n * width, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys, "<u8")


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, "<u8"), dtype=np.uint64)


def range_edges(ranges: int, bits: int = 64) -> np.ndarray:
    """The first key of each range but the first, of keys below 2 ** bits."""
    return np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)
