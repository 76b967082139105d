"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch."""

from __future__ import annotations

import numpy as np

PART_BYTES = 2_000_000  # bytes hashed at once

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's final step)."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def _stream(n: int, start: int = 0) -> np.ndarray:
    return mix((np.arange(start, start + n, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _stream(256, 1 << 20) * (~_SPACE)  # white space adds nothing
_PLACE = _stream(4096) | _U(1)


def _words(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of ``raw`` and the number of words before each of the
    ``ends`` of texts. A word's hash sums a factor per byte times one per place."""
    buf = np.frombuffer(raw, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    longest = int((stops - starts).max())
    place = _PLACE if longest <= len(_PLACE) else _stream(longest) | _U(1)
    inside = np.zeros(len(buf), np.int64)
    inside[starts] = starts
    inside = np.arange(len(buf)) - np.maximum.accumulate(inside)
    np.minimum(inside, longest - 1, out=inside)  # white space after a word, where the factor is 0
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[buf] * place[inside], dtype=_U)))
        hashes = mix(total[stops] - total[starts] + (stops - starts).astype(_U))
    return hashes, np.searchsorted(starts, ends)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are what white space
    (space, \\t to \\r) separates, A-Z lower-cased; a text of fewer than ``width``
    words has its whole word sequence as one shingle, an empty text none."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        part.append(b)
        size += len(b) + 1
        if size >= PART_BYTES or k == len(texts) - 1:
            out += _sets(part, width)
            part, size = [], 0
    return out


def _sets(part: list[bytes], width: int) -> list[np.ndarray]:
    ends = np.cumsum([len(b) + 1 for b in part])
    words, upto = _words(b" ".join(part) + b" ", ends)
    factor = _stream(width, 1 << 30) | _U(1)
    with np.errstate(over="ignore"):
        n = max(len(words) - width + 1, 0)
        windows = np.zeros(n, _U)
        for i in range(width):
            windows += words[i:i + n] * factor[i]
        windows = mix(windows)
        out, lo = [], 0
        for hi in upto.tolist():
            if hi - lo >= width:
                s = np.sort(windows[lo:hi - width + 1])
                out.append(s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif hi > lo:
                out.append(mix((words[lo:hi] * factor[:hi - lo]).sum(dtype=_U, keepdims=True) + _U(hi - lo)))
            else:
                out.append(np.empty(0, _U))
            lo = hi
    return out
