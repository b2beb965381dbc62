"""Vectorised byte-level helpers over Arrow string columns.

A batch's texts are one contiguous UTF-8 buffer with offsets; words, their
64-bit hashes and shingle sets are computed on that buffer with numpy, so no
Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLAB = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and lower-case letters, applied after lower-casing A-Z.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_STEP = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _pow.get(key)
    if have is None or len(have) < n:
        base = np.full(max(n, SLAB + 1), _PINV if inverse else _P, np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if n <= 4 * SLAB:  # a huge text gets its own table, which is not kept
            _pow[key] = have
    return have[:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slabs(data: np.ndarray, off: np.ndarray, size: int = SLAB):
    """Runs of whole texts of about `size` bytes: (first, last, bytes, offsets)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:], dtype=np.uint64)
    return out


def ranges_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, equal for equal bytes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix((sums[end] - sums[start]) * powers(int(start.max()) + 1, True)[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray):
    """(start, end) of each word and the first word of each text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def hashed_words(data: np.ndarray, off: np.ndarray, separator: np.ndarray):
    """Lower-cased words' hashes, starts, ends, and the first word of each text."""
    data = LOWER[data]
    s, e, first = words(data, off, separator)
    return ranges_hash(prefix_sums(data), s, e), s, e, first


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5):
    """The sorted distinct k-word shingle hashes of each text, one array a text."""
    h, _, _, first = hashed_words(data, off, WHITE)
    none = np.zeros(0, np.uint64)
    grams = none
    if len(h) >= k:
        m = len(h) - k + 1
        total = h[:m] * _STEP[0]
        for j in range(1, k):
            total = total + h[j : j + m] * _STEP[j]
        grams = mix(total)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            x = np.sort(grams[a : b - k + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            total = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for j in range(b - a):
                    total = total + h[a + j] * _STEP[j]
            yield mix(np.array([total], np.uint64))
        else:
            yield none
