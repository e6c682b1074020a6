"""Hilbert-curve positions of points with whole-number coordinates."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` (n x d whole numbers below 2^bits, d x bits at most 63) along
    the d-dimensional Hilbert curve, as int64: undo the rotations from the coarsest bit on, Gray-code
    the axes, and interleave their bits."""
    x = [c.astype(np.int64) for c in cells.T]
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(d):
            inside = (x[i] & level) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn, level = np.zeros(len(cells), dtype=np.int64), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[d - 1] & level) != 0, level - 1, 0)
        level >>= 1
    key = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] ^ turn) >> b & 1)
    return key
