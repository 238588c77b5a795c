"""Runs of bytes of a class in Arrow string buffers."""

from __future__ import annotations

import numpy as np

#: A-Z become a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*outside: tuple[int, int]) -> np.ndarray:
    """A lookup table: true for the bytes outside all of these ranges (ends included)."""
    table = np.ones(256, bool)
    for a, b in outside:
        table[a : b + 1] = False
    return table


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of true bytes, none over a row's border, and the row of each."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(inside) + 1, bool)
    first[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1
