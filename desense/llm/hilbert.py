"""Positions of points along a Hilbert curve, for whole arrays of points at a time."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each row of ``cells``, whole coordinates of ``bits`` bits.

    Skilling's transform: coordinates become the transposed index by undoing excess
    rotations from the top bit down, then a Gray code; interleaving gives the position.
    The dimensions times ``bits`` must be below 64.
    """
    x = [np.ascontiguousarray(c) for c in cells.T.astype(np.int64)]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | ((c >> b) & 1)
    return key
