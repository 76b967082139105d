"""Hilbert order of points on a grid, vectorised."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (unsigned, below ``2**bits``) on the Hilbert
    curve through the grid; ``bits * columns`` must be below 63. After Skilling,
    "Programming the Hilbert curve" (2004): undo the turns of each finer level,
    then Gray-decode and interleave."""
    x = cells.astype(_U, copy=True)
    n = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = _U(level - 1)
        for i in range(n):
            turn = (x[:, i] & _U(level)) != 0
            swap = np.where(turn, _U(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turn, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), _U)
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[:, n - 1] & _U(level)) != 0, _U(level - 1), _U(0))
        level >>= 1
    x ^= flip[:, None]
    out = np.zeros(len(x), _U)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << _U(1)) | ((x[:, i] >> _U(b)) & _U(1))
    return out.astype(np.int64)
