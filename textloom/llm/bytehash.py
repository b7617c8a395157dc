"""Hashes of words and word shingles, computed over whole buffers of UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed in one go, but for a longer word.
PIECE = 1 << 18
#: Words of a shingle.
WIDTH = 5

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_MUL = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, r, np.uint64), dtype=np.uint64)]) for r in (_R, _RINV))


_POWERS: list = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to n; those of a piece are kept."""
    if n > PIECE + 1:
        return _power_table(n)
    if not _POWERS:
        _POWERS.append(_power_table(PIECE + 1))
    return _POWERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit hash: each bit depends on all."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Ranges of rows of about size bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows, and the first word of each row.  Bytes are read in pieces that end where words do."""
    a, last = int(offsets[0]), int(offsets[-1])
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while a < last:
        z = min(a + PIECE, last)
        while z < last and not sep[data[z]]:
            gap = np.flatnonzero(sep[data[z : min(z + 4096, last)]])
            z = z + int(gap[0]) if len(gap) else min(z + 4096, last)
        h, start = _words(data[a:z], offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z)] - a, sep)
        hashes.append(h)
        starts.append(start + a)
        a = z
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _words(b: np.ndarray, borders: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one piece, in which rows begin at borders."""
    n = len(b)
    power, inverse = _powers(n + 1)
    inside = ~sep[b]
    first = np.zeros(n + 1, bool)
    first[borders] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[:n], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start]), start


def grams(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of width words, over row borders too."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        m = len(h) - width + 1
        g = h[:m] * _MUL[0]
        for k in range(1, width):
            g += h[k : k + m] * _MUL[k]
        return mix(g)


def shingle_sets(column: pa.Array):
    """For each row the sorted distinct hashes of its shingles of five words; of all its words if it has fewer; empty without words."""
    data, offsets = buffers(column)
    for i, j in pieces(offsets):
        h, at = words(data, offsets[i : j + 1])
        g = grams(h)
        for k in range(j - i):
            a, z = int(at[k]), int(at[k + 1])
            if z - a >= WIDTH:
                s = np.sort(g[a : z - WIDTH + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif z > a:
                with np.errstate(over="ignore"):
                    yield mix((h[a:z] * _MUL[: z - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(z - a))
            else:
                yield np.zeros(0, np.uint64)
