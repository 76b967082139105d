"""SuperMinHash signatures, vectorised over documents.

Every element of a set owns a permutation of the ``m`` signature places and shows
up at its rank-0 place first, then at its rank-1 place, and so on; a place keeps
the least ``rank + random fraction`` it sees. Ranks of one element at different
places differ by construction, which lowers the variance against independent
hash functions, above all for small sets. All sets are worked through rank by
rank: once every place of a set is taken, higher ranks cannot win and it stops.

The permutations are random shuffles: at rank j an element swaps its place j with
place ``j + hash(element, j) mod (m - j)``, and place j is its place of that rank.
Large sets need few ranks, and the place is found by going back through the swaps
made so far; small sets need many, and each element keeps its whole shuffle. Both
give the same places. (Cheaper maps, such as affine ones, make the ranks of places
depend on each other, and bands of such places lose links between small sets.)
"""

from __future__ import annotations

import numpy as np

from netsieve.llm.shingles import mix

_U = np.uint64
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SMALL = 128  # sets below this many elements keep whole shuffles
WHOLE = 40_000  # elements whose shuffles are kept at once


def _draws(elements: np.ndarray, rank: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The place each element swaps with at a rank, and its random fraction."""
    with np.errstate(over="ignore"):
        h = mix(elements + _U(rank + 1) * _U(0x9E3779B97F4A7C15))
    return rank + ((h & _U(0xFFFFFFFF)) * _U(m - rank) >> _U(32)).astype(np.int64), h >> _U(32)


class _Whole:
    """Shuffles kept place by place."""

    def __init__(self, n: int, m: int):
        self.order = np.tile(np.arange(m, dtype=np.int32), (n, 1))

    def place(self, rank: int, swap: np.ndarray) -> np.ndarray:
        rows = np.arange(len(swap))
        got = self.order[rows, swap]
        self.order[rows, swap] = self.order[:, rank]
        self.order[:, rank] = got
        return got.astype(np.int64)

    def keep(self, going: np.ndarray) -> None:
        self.order = self.order[going]


class _Traced:
    """Shuffles kept as their swaps."""

    def __init__(self, n: int, m: int):
        self.swaps: list[np.ndarray] = []

    def place(self, rank: int, swap: np.ndarray) -> np.ndarray:
        at = swap.copy()
        for j in range(rank - 1, -1, -1):
            back = self.swaps[j]
            at = np.where(at == back, j, np.where(at == j, back, at))
        self.swaps.append(swap)
        return at

    def keep(self, going: np.ndarray) -> None:
        self.swaps = [s[going] for s in self.swaps]


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """(len(sets), m) signature values, rank in the upper 32 bits. Two sets agree
    at a place with probability their Jaccard similarity. Empty sets stay NONE."""
    lengths = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), m), NONE, _U)
    large, small = np.flatnonzero(lengths >= SMALL), np.flatnonzero((lengths > 0) & (lengths < SMALL))
    for part in [large, *np.split(small, np.flatnonzero(np.diff(np.cumsum(lengths[small]) // WHOLE)) + 1)]:
        if len(part):
            out[part] = _ranked([sets[k] for k in part.tolist()], lengths[part], m, _Whole if part is not large else _Traced)
    return out


def _ranked(sets: list[np.ndarray], lengths: np.ndarray, m: int, kind) -> np.ndarray:
    out = np.full((len(sets), m), NONE, _U)
    flat = out.reshape(-1)
    elements = mix(np.concatenate(sets))
    base = np.repeat(np.arange(len(sets), dtype=np.int64) * m, lengths)
    owner = np.repeat(np.arange(len(sets)), lengths)
    shuffles = kind(len(elements), m)
    open_places = np.full(len(sets), m)
    for rank in range(m):
        swap, fraction = _draws(elements, rank, m)
        at = base + shuffles.place(rank, swap)
        free = flat[at] == NONE  # lower ranks have won the others
        at, value = at[free], (_U(rank) << _U(32)) | fraction[free]
        np.minimum.at(flat, at, value)
        open_places = open_places - np.bincount(np.unique(at) // m, minlength=len(sets))
        going = open_places[owner] > 0
        if not going.any():
            break
        if 4 * np.count_nonzero(going) < 3 * len(going):
            elements, base, owner = elements[going], base[going], owner[going]
            shuffles.keep(going)
    return out
