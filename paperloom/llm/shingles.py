"""Vectorised word shingles over Arrow string buffers.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; ``A-Z`` are lower-cased, all
other bytes stay.  A shingle is ``n`` consecutive words; a text of one to ``n - 1`` words is one
shingle as a whole; null, empty and blank texts have none.  Words and shingles are 64-bit hashes
(a polynomial in a fixed odd base over per-byte random values, then a mixing finaliser), equal in
every process and on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C55
_INV = pow(_BASE, -1, 2**64)
_SLAB = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _IPOW = _powers(_BASE, _SLAB), _powers(_INV, _SLAB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and validity of a string column."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0], np.asarray(col.is_valid())


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each row."""
    rows = len(off) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    text = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start = text.copy()
    start[1:] &= ~text[:-1] | first[1:-1]
    end = text.copy()
    end[:-1] &= ~text[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    # The polynomial is taken per slab so that powers stay in one small table.
    value = _BYTE[data]
    value *= np.resize(_POW, len(data)) if len(data) > _SLAB else _POW[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    same = s // _SLAB == (e - 1) // _SLAB
    h = (total[e] - total[s]) * _IPOW[s % _SLAB]
    for k in np.flatnonzero(~same):
        part = _BYTE[data[s[k] : e[k]]]
        h[k] = np.sum(part * np.resize(_POW, len(part)))
    h = mix(h ^ (e - s).astype(np.uint64))
    return h, np.searchsorted(s, off[1:]) - np.searchsorted(s, off[:-1])


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order (with repeats), and the number of shingles of each row."""
    rows = len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    k = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    total = int(k.sum())
    if total == 0:
        return np.zeros(0, np.uint64), k
    at = np.arange(total) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts, k)
    width = np.repeat(np.minimum(counts, n), k)
    h = np.full(total, n, np.uint64) * np.uint64(0) + width.astype(np.uint64)
    for i in range(n):
        use = i < width
        w = words[np.minimum(at + i, len(words) - 1)]
        h = np.where(use, mix(h * np.uint64(0xD6E8FEB86659FD93) + w), h)
    assert len(k) == rows
    return h, k


def distinct_sets(col, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, off, _ = string_buffers(col)
    h, k = shingles(*word_hashes(data, off), n)
    ends = np.cumsum(k)
    return [np.unique(h[b - c : b]) for b, c in zip(ends, k)]
