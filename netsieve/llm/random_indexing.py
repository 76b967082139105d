"""Random-indexing vectors of word units, pooled per document.

A text's words give two streams of units: the *core* (its letters, lower-cased)
and the *shape* (runs of upper, lower, digit and each other character, and whether
the word repeats the one before or a word pair seen earlier in the text). Units
are hashed to a fixed number of buckets, so every table has a size known in
advance. A bucket's index vector is sparse and ternary; its context vector is the
sum of the index vectors of the units next to it anywhere in the corpus; its word
vector is the sum of the index vector and the normalised context vector. A document
is the mean of its units' vectors.

All documents count towards the context vectors. Tasks add up their own part in
a table of fixed size; only those tables are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import task, with_workers
from netsieve.llm.shingles import _stream, mix

_U = np.uint64
DIM = 32
NONZERO = 4  # entries of an index vector
CORE_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 10
WINDOW = 2  # units on either side
PART_BYTES = 1_000_000
RARE = 1e-3  # words more frequent than this weigh less in the mean

FEATURES = 2 * DIM + 1


def index_entries(buckets: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every bucket's index vector."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(buckets * NONZERO, dtype=_U) + _U((salt << 20) + 1)).reshape(buckets, NONZERO)
    return (h % _U(DIM)).astype(np.int64), np.where((h >> _U(32)) & _U(1), 1.0, -1.0)


def index_vectors(buckets: int, salt: int) -> np.ndarray:
    out = np.zeros((buckets, DIM))
    place, sign = index_entries(buckets, salt)
    np.add.at(out, (np.arange(buckets)[:, None], place), sign)
    return out


# byte classes: white space 0, upper 1, lower and non-ASCII 2, digit 3, others their own
_CLASS = np.arange(256, dtype=np.int16) + 10
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LETTER = _stream(256, 1 << 21)[_LOWER] * ((_CLASS == 1) | (_CLASS == 2))
_SHAPE = _stream(300, 1 << 22)
_FACTOR = _stream(64, 1 << 23) | _U(1)


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core bucket, shape bucket and text number of every word of the texts."""
    raw = b" ".join(texts) + b" "
    buf = np.frombuffer(raw, np.uint8)
    kind = _CLASS[buf]
    edge = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=1, append=1))
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.zeros(len(buf), np.int32)
    first[starts] = starts
    place = np.arange(len(buf), dtype=np.int32) - np.maximum.accumulate(first)
    # starts of runs of one class; all of a word's runs lie between its ends
    run = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])) & (kind > 0))
    from_, to = np.searchsorted(run, starts), np.searchsorted(run, stops)
    nth = np.arange(len(run)) - np.repeat(from_, to - from_)
    with np.errstate(over="ignore"):
        letters = np.concatenate((np.zeros(1, _U), np.cumsum(_LETTER[buf] * _FACTOR[place & 63], dtype=_U)))
        core = mix(letters[stops] - letters[starts])
        runs = np.concatenate((np.zeros(1, _U), np.cumsum(_SHAPE[kind[run]] * _FACTOR[nth & 63], dtype=_U)))
        shape = runs[to] - runs[from_]
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends), prepend=0))
        same = np.zeros(len(core), bool)
        same[1:] = (core[1:] == core[:-1]) & (text[1:] == text[:-1])
        pair = core.copy()
        pair[1:] += core[:-1] * _FACTOR[1] + text[1:].astype(_U) * _FACTOR[2]
        again = np.ones(len(core), bool)
        order = np.argsort(pair, kind="stable")
        again[order[np.concatenate(([True], pair[order[1:]] != pair[order[:-1]]))]] = False
        shape = mix(shape + _SHAPE[298] * same + _SHAPE[299] * (again & ~same))
    return (core % _U(CORE_BUCKETS)).astype(np.int64), (shape % _U(SHAPE_BUCKETS)).astype(np.int64), text


def parts(column: pa.Array):
    """Texts of a column in lists of about ``PART_BYTES`` bytes."""
    part, size = [], 0
    for lo in range(0, len(column), 256):
        for t in column.slice(lo, 256).to_pylist():
            part.append((t or "").encode("utf-8", "surrogatepass"))
            size += len(part[-1])
            if size >= PART_BYTES:
                yield part
                part, size = [], 0
    if part:
        yield part


class Contexts:
    """What one task has seen: sums of neighbours' index vectors per core bucket,
    and how often each two shape buckets were neighbours (few enough to count)."""

    def __init__(self):
        self.place, self.sign = index_entries(CORE_BUCKETS, 1)
        self.core = np.zeros(CORE_BUCKETS * DIM)
        self.shape = np.zeros(SHAPE_BUCKETS * SHAPE_BUCKETS, np.int64)
        self.count = np.zeros(CORE_BUCKETS + SHAPE_BUCKETS, np.int64)

    def add(self, core: np.ndarray, shape: np.ndarray, text: np.ndarray) -> None:
        self.count[:CORE_BUCKETS] += np.bincount(core, minlength=CORE_BUCKETS)
        self.count[CORE_BUCKETS:] += np.bincount(shape, minlength=SHAPE_BUCKETS)
        for k in range(1, WINDOW + 1):
            same = text[k:] == text[:-k]
            a, b = core[k:][same], core[:-k][same]
            for unit, near in ((a, b), (b, a)):
                for j in range(NONZERO):
                    self.core += np.bincount(unit * DIM + self.place[near, j], weights=self.sign[near, j], minlength=len(self.core))
            self.shape += np.bincount((shape[k:] * SHAPE_BUCKETS + shape[:-k])[same], minlength=len(self.shape))

    def table(self) -> np.ndarray:
        """(buckets, DIM + 1): context sums and counts, core before shape."""
        pairs = self.shape.reshape(SHAPE_BUCKETS, SHAPE_BUCKETS)
        shape = (pairs + pairs.T) @ index_vectors(SHAPE_BUCKETS, 2)
        return np.rint(np.column_stack([np.concatenate([self.core.reshape(CORE_BUCKETS, DIM), shape]), self.count])).astype(np.int64)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(core, shape) vectors from all documents. What comes to the driver is one
    row per bucket."""
    names = [f"v{i}" for i in range(DIM + 1)]

    @task
    def run(batches):
        seen = Contexts()
        for batch in batches:
            for part in parts(batch.column(0)):
                core, shape, text = units(part)
                if len(core):
                    seen.add(core, shape, text)
        table = seen.table()
        some = np.flatnonzero(table[:, DIM])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, i]) for i in range(DIM + 1))], names=["bucket", *names])

    own = with_workers(docs.select("text")).mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    rows = own.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).collect()
    total = np.zeros((CORE_BUCKETS + SHAPE_BUCKETS, DIM + 1))
    for r in rows:
        total[r["bucket"]] = r[1:]
    out = []
    for rows_, salt, rare in ((total[:CORE_BUCKETS], 1, RARE), (total[CORE_BUCKETS:], 2, None)):
        context, count = rows_[:, :DIM], rows_[:, DIM]
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        v = index_vectors(len(rows_), salt) + np.sqrt(NONZERO) * context / np.maximum(norm, 1)
        if rare:
            v *= (rare / (rare + count / max(count.sum(), 1)))[:, None]
        out.append(v.astype(np.float32))
    return out[0], out[1]


def pooled(texts: list[bytes], core_vectors: np.ndarray, shape_vectors: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text; all 0 for a text without words."""
    core, shape, text = units(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    if len(core):
        at = np.flatnonzero(np.diff(text, prepend=-1))
        n = np.diff(np.append(at, len(text)))
        out[text[at], :DIM] = np.add.reduceat(core_vectors[core], at, axis=0) / n[:, None]
        out[text[at], DIM:2 * DIM] = np.add.reduceat(shape_vectors[shape], at, axis=0) / n[:, None]
        out[text[at], 2 * DIM] = np.log1p(n)
    return out


def document_vectors(docs: DataFrame, vectors: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the pooled features of each document."""
    @task
    def run(batches):
        for batch in batches:
            x = np.concatenate([pooled(part, *vectors) for part in parts(batch.column(0))] or [np.zeros((0, FEATURES), np.float32)])
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], values], names=[*keep, "features"])

    kinds = dict(docs.dtypes)
    return with_workers(docs.select("text", *keep)).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", features array<float>")
