"""Encoding by distinct word: a batch's words are hashed together, and only new ones are encoded.

Tokenizers that split a text into words before merging give a word the same ids wherever it stands,
so each worker keeps the ids of the words it has met.  The cache is emptied when it holds
``MOST`` words.  It saves work; words are taken as equal by their 64-bit hashes, so a result would only change if two
of the words that a worker holds at once had one hash (for a million words, a chance of 3 in 10^8).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import _BASE, _INV, _RNG, _SLAB, _powers, mix

_VALUE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_POW, _IPOW = _powers(_BASE, _SLAB), _powers(_INV, _SLAB)
MOST = 1_000_000
BITS, PROBES = 21, 8


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span; equal bytes give equal hashes."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    value = _VALUE[data]
    value *= np.resize(_POW, len(data)) if len(data) > _SLAB else _POW[: len(data)]
    np.cumsum(value, out=total[1:])
    h = (total[e] - total[s]) * _IPOW[s % _SLAB]
    for k in np.flatnonzero(s // _SLAB != (e - 1) // _SLAB):
        part = _VALUE[data[s[k] : e[k]]]
        h[k] = np.sum(part * np.resize(_POW, len(part)))
    return mix(h ^ (e - s).astype(np.uint64))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class WordCache:
    """Rows of ids by word hash, in an open-addressed table.  encode: new words -> all their ids, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(1 << BITS, np.uint64), np.full(1 << BITS, -1, np.int32)
        self.start, self.length, self.words = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (h >> np.uint64(64 - BITS)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.slots[at], -1)
        open_ = np.flatnonzero(out < 0)
        for k in range(1, PROBES):
            if not len(open_):
                break
            there = (at[open_] + k) & ((1 << BITS) - 1)
            hit = self.keys[there] == h[open_]
            out[open_[hit]] = self.slots[there[hit]]
            open_ = open_[~hit]
        return out

    def _add(self, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
        flat, k = self.encode(words)
        need, n = self.used + len(flat), self.words + len(words)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.int32)])
        if n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.start, self.length))
        self.flat[self.used : need] = flat
        self.start[self.words : n] = self.used + np.cumsum(k) - k
        self.length[self.words : n] = k
        slots = np.arange(self.words, n)
        self.used, self.words = need, n
        left = np.arange(len(keys))
        at = (keys >> np.uint64(64 - BITS)).astype(np.int64)
        for p in range(PROBES):  # a word that finds no place is only encoded again next time
            there = (at[left] + p) & ((1 << BITS) - 1)
            free = self.slots[there] < 0
            self.keys[there[free]], self.slots[there[free]] = keys[left[free]], slots[left[free]]
            placed = free & (self.keys[there] == keys[left])
            left = left[~placed]
        return slots

    def ids(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words data[s:e], one word after the other, and each word's number of ids."""
        if len(s) == 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.words > MOST:
            self.clear()
        h = span_hashes(data, s, e)
        slots = self._find(h)
        new = np.flatnonzero(slots < 0)
        if len(new):
            uniq, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            raw = data.tobytes()
            slots[new] = self._add(uniq, [raw[s[i] : e[i]] for i in new[first]])[back]
        k = self.length[slots].astype(np.int64)
        return self.flat[spread(self.start[slots], k)], k
