"""Vectorised hashing of words and windows over Arrow string columns (numpy, bounded slices)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 18

_G = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_BASE = 0xD6E8FEB86659FD93  # odd, 3 modulo 8
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values for a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_G) + np.uint64((seed * 0x632BE59BD9B4E019 + 1) & _M64))


_BYTE = stream(11, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=np.uint64)
    return _pow[0][:n], _pow[1][:n]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    n = len(column)
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word [^\\x20\\x09-\\x0D]+, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up, out=total[1:])
    hashed = mix((total[stop] - total[start]) * down[start])
    return hashed, np.searchsorted(start, offsets)


def shingles(hashed: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row its sorted distinct width-word shingles; with fewer words the whole sequence as one; none without words."""
    n = len(hashed)
    factor = stream(width * 7 + 5, width) | np.uint64(1)
    out: list[np.ndarray] = []
    joined = np.zeros(0, np.uint64)
    if n >= width:
        joined = hashed[: n - width + 1] * factor[0]
        for k in range(1, width):
            joined += hashed[k : n - width + 1 + k] * factor[k]
        joined = mix(joined)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            h = np.uint64((b - a) * _G & _M64)
            for w in hashed[a:b]:
                h = mix(np.array([(int(h) * 31 + int(w)) & _M64], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(joined[:0])
    return out
