"""Periodic runs of words: suffix automaton, link-cut access on its link tree.

A run is a stretch of consecutive words with smallest period q, as long as 2q and
``MIN_WORDS`` at least, that neither neighbour extends. For each stretch of text

1. the suffix automaton of its words is built, word by word;
2. its words are appended once more in order: word i accesses the path from the
   state of the prefix that ends at i to the root, and recolours it to i. The path
   falls into segments of one colour e, the place where their strings last ended.
   The deepest state of a segment has length L, the longest suffix common to the
   prefixes that end at e and at i. If ``q = i - e <= L``, the words up to i hold a
   square of period q, and the stretch of ``L + q`` words that ends at i has it;
3. such stretches of one start and period grow with i: the last one is the run.

A multiple of the smallest period never comes up, since the smaller distance has
recoloured its states. All accesses of n words cost O(n log n): segments live in
splay trees, one per colour.

The automaton is built for the parts of a text in which runs can lie: every word of
a run lies in a sequence of ``GRAM`` words that comes twice within it, so words that
lie in no such sequence divide the text, and parts without any hold no run. This
sieve is exact; ``sieve=False`` takes whole texts.

Defined results: NULL text has no words; words are compared byte by byte; a row
with NULL doc_id keeps its words as they are (their digest rule needs an id);
repeated rows give a row each; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import read, task, with_workers
from netsieve.llm.shingles import mix

MIN_WORDS = 12
GRAM = MIN_WORDS // 2
PART_WORDS = 1_000_000  # words sieved at once

Run = tuple[int, int, int]  # start, length, period


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths, and the state of each prefix (state 0: the root)."""
    link, length, ends = [-1], [0], []
    step: list[dict[int, int]] = [{}]
    last = 0
    for w in words:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(step[q].copy())
                link[q] = link[cur] = copy
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
        ends.append(cur)
        last = cur
    return link, length, ends


class Paths:
    """The link tree's states, divided into downward paths of one colour each.
    Every path is a splay tree by depth; its root holds the colour."""

    def __init__(self, link: list[int]):
        n = len(link)
        # node 0 stands for none; state s is node s + 1
        self.left, self.right = [0] * (n + 1), [0] * (n + 1)
        self.up = [0] + [p + 1 for p in link]  # in a splay tree: its parent there; at its root: the state above the path
        self.colour = [-1] * (n + 1)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def _splay(self, x: int) -> None:
        left, right, up, rotate = self.left, self.right, self.up, self._rotate
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            top = p
            if g and (left[g] == p or right[g] == p):
                top = g
                rotate(p if (left[p] == x) == (left[g] == p) else x)
            rotate(x)
            # the colour goes with the tree's root, should that have been it
            self.colour[x] = self.colour[top]

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from ``state`` to the root; the (old colour, deepest
        state) of its segments, from the state up."""
        found, x, below = [], state + 1, 0
        left, right, up = self.left, self.right, self.up
        while x:
            self._splay(x)
            if self.colour[x] >= 0:
                found.append((self.colour[x], x - 1))
            deeper = right[x]
            if deeper:
                self.colour[deeper] = self.colour[x]
            right[x] = below
            if below:
                up[below] = x
            below, x = x, up[x]
        self.colour[below] = colour
        return found


def runs_of(words: list[int], min_words: int = MIN_WORDS) -> list[Run]:
    """All runs of a sequence, by start, then period."""
    link, length, ends = suffix_automaton(words)
    paths, last = Paths(link), {}
    for i, state in enumerate(ends):
        for e, deepest in paths.access(state, i):
            common, q = length[deepest], i - e
            if q <= common:
                last[i - common - q + 1, q] = i
    return [(s, e - s + 1, q) for (s, q), e in sorted(last.items()) if e - s + 1 >= max(min_words, 2 * q)]


def repetitive_parts(codes: np.ndarray, bounds: np.ndarray, gram: int = GRAM) -> list[tuple[int, int]]:
    """(begin, end) of the parts of the stretches between ``bounds`` that words in
    no repeated sequence of ``gram`` words divide; parts are sieved again until
    they stay as they are."""
    hashed = mix(codes.astype(np.uint64) + np.uint64(1))
    n = max(len(codes) - gram + 1, 0)
    windows = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            windows += hashed[k:k + n] * mix(np.array([k + 1], np.uint64))
    spans = np.column_stack((bounds[:-1], bounds[1:]))
    done: list[np.ndarray] = []
    while True:
        spans = spans[spans[:, 1] - spans[:, 0] >= 2 * gram]
        if not len(spans):
            break
        # windows that lie in one span, with the span's number in their hash
        sizes = spans[:, 1] - spans[:, 0] - gram + 1
        upto = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(spans)), sizes)
        at = np.arange(upto[-1]) - (upto - sizes)[owner] + spans[owner, 0]
        with np.errstate(over="ignore"):
            key = mix(windows[at] ^ mix(owner.astype(np.uint64) + np.uint64(77)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        repeated = np.zeros(len(key), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        # words covered by repeated windows
        cover = np.zeros(len(codes) + 1, np.int64)
        hit = at[repeated]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + gram, -1)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = np.cumsum(cover[:-1]) > 0
        edge = np.diff(inside.view(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # spans that touch are divided where the old ones are
        cut_at = np.unique(np.concatenate((begin, spans[inside[spans[:, 0]] & inside[spans[:, 0] + 1], 0])))
        stop = np.minimum(end[np.searchsorted(end, cut_at, side="right")], np.append(cut_at[1:], len(codes)))
        new = np.column_stack((cut_at, stop))
        kept = (new[:, None] == spans[np.minimum(np.searchsorted(spans[:, 0], new[:, 0]), len(spans) - 1)][:, None]).all(axis=2)[:, 0]
        done.append(new[kept])
        spans = new[~kept]
    parts = np.concatenate(done) if done else np.empty((0, 2), np.int64)
    return [(int(a), int(b)) for a, b in parts[np.argsort(parts[:, 0])]]


def text_runs(codes: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, sieve: bool = True) -> list[list[Run]]:
    """Runs of each of the texts whose words lie one after the other in ``codes``."""
    bounds = np.concatenate(([0], ends)).astype(np.int64)
    parts = repetitive_parts(codes, bounds, max(min_words // 2, 1)) if sieve else [(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:])]
    out: list[list[Run]] = [[] for _ in ends]
    for a, b in parts:
        k = int(np.searchsorted(bounds, a, side="right")) - 1
        out[k] += [(s + a - int(bounds[k]), n, q) for s, n, q in runs_of(codes[a:b].tolist(), min_words)]
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words without those that any run repeats after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def with_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a document, of which every tenth gets a periodic tail."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def document_runs(docs: DataFrame, min_words: int = MIN_WORDS, change=None, sieve: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the text
    without repeated periods, its words joined by one space. ``change`` may give
    a document other words: (doc_id, words) -> words."""
    @task
    def run(batches):
        for batch in batches:
            for ids, words, found in _searched(batch, min_words, change, sieve):
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = [r for f in found for r in f]
                struct = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
                texts = [b" ".join(kept_words(w, f)).decode("utf-8", "surrogatepass") for w, f in zip(words, found)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), struct), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    src = with_workers(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return src.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _searched(batch: pa.RecordBatch, min_words: int, change, sieve: bool):
    """(ids, words, runs) of the rows of a batch, about ``PART_WORDS`` at a time."""
    ids, words, size = [], [], 0

    def part():
        code: dict[bytes, int] = {}
        codes = np.fromiter(map(code.setdefault, chain.from_iterable(words), count()), np.int64, size)
        return ids, words, text_runs(codes, np.cumsum([len(w) for w in words]), min_words, sieve)

    for k in range(batch.num_rows):
        text = batch.column(1)[k].as_py()
        # bytes.split() parts at just the white space that words are parted by
        own = (text or "").encode("utf-8", "surrogatepass").split()
        ids.append(batch.column(0)[k].as_py())
        words.append(change(ids[-1], own) if change else own)
        size += len(own)
        if size >= PART_WORDS:
            yield part()
            ids, words, size = [], [], 0
    if ids:
        yield part()


def run_digests(docs: DataFrame, min_words: int = MIN_WORDS, change=with_tail, sieve: bool = True) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run, and digests of all runs and
    of the words that stay. Texts are searched where they are read."""
    @task
    def run(batches):
        for batch in batches:
            for ids, words, found in _searched(batch, min_words, change, sieve):
                best = [min(f, key=lambda r: (-r[1], r[0], r[2])) if f else (None,) * 3 for f in found]
                power = [None if r[0] is None else 1000 * r[1] // r[2] for r in best]
                of_runs = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in f).encode()).hexdigest() for f in found]
                of_kept = [hashlib.sha256(b" ".join(kept_words(w, f))).hexdigest() for w, f in zip(words, found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(f) for f in found], pa.int64()), *(pa.array([b[k] for b in best], pa.int64()) for k in range(3)),
                     pa.array(power, pa.int64()), pa.array(of_runs, pa.string()), pa.array(of_kept, pa.string())],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    src = with_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return src.mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digests(read(spark, sf_dir, "documents"))
