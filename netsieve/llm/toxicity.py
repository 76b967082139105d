"""Toxicity by a classifier chain.

A lexicon of words and word beginnings that occur in toxic documents many times
more often than in clean ones is learned from labelled documents. Each text is
described by its hits in the lexicon, and a chain of logistic models predicts one
category after the other:

* ``insult``: toxic, with a lexicon hit
* ``severe``: toxic, with hits of at least ``SEVERE`` different words
* ``saturated``: toxic, where at least ``SATURATED`` of the words are hits
* ``toxic``: the label itself, for which the document is rejected or kept

Each model sees the probabilities of the categories before it. While it is
trained, these come from models that had not seen the row (out of fold).

At most ``SAMPLE_ROWS`` labelled documents of either label are learned from, those
with the least id hashes outside the held-out rows; copies of one text count once
(one document for each least shingle hash). The chain's training rows are described
by a lexicon learned from the other half of them, so that their hits are as good as
those of new rows; the lexicon of all of them serves afterwards.

Defined results: NULL or empty text has no hits; labels other than 0 and 1 teach
nothing; without both labels in the sample nothing is toxic (score 0); one row per
row of ``docs``; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import cut, held_out, read, task, with_workers
from netsieve.llm.random_indexing import parts
from netsieve.llm.shingles import _stream, mix

_U = np.uint64
SAMPLE_ROWS = 6_000  # labelled rows of either label
LEXICON = 4_000  # entries at most, the strongest
BEGINNINGS = (4, 5)  # bytes of a word's beginning that are entries of their own
LIFT = 20.0  # times more frequent in toxic documents
SHARE = 0.004  # of the toxic documents that an entry must occur in, 3 at least
SEVERE, SATURATED = 4, 0.015
FOLDS = 5
THRESHOLD = 0.5
CATEGORIES = ("insult", "severe", "saturated", "toxic")
SIGNS = 6  # numbers that describe a text

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_CODE = _stream(256, 1 << 24)[_FOLD] * _LETTERS
_AT = _stream(64, 1 << 25) | _U(1)


def entries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Entry hashes of every word (a column for the word and one for each of its
    beginnings) and the word's text number. Words are runs of letters."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_LETTERS[buf].view(np.int8), prepend=0, append=0))
    starts, stops = edge[0::2], edge[1::2]
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), _U)
    if not len(starts):
        return out, np.empty(0, np.int64)
    first = np.zeros(len(buf), np.int64)
    first[starts] = starts
    place = np.arange(len(buf)) - np.maximum.accumulate(first)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(_CODE[buf] * _AT[place & 63], dtype=_U)))
        out[:, 0] = mix(total[stops] - total[starts])
        for k, n in enumerate(BEGINNINGS, 1):
            # words that end before are entries as whole words only
            out[:, k] = np.where(stops - starts > n, mix(total[np.minimum(starts + n, stops)] - total[starts] + _U(n)), out[:, 0])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out, np.searchsorted(ends, starts, side="right")


def signs(texts: list[bytes], lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of ``SIGNS`` numbers per text: different words hit, different
    entries hit, share of words hit, greatest and summed weight, length. The
    first is the count itself, the rest are damped."""
    ent, text = entries(texts)
    out = np.zeros((len(texts), SIGNS))
    if not len(text):
        return out
    words = np.bincount(text, minlength=len(texts))
    out[:, 5] = np.log1p(words)
    if not len(lexicon):
        return out
    at = np.searchsorted(lexicon, ent)
    at[at == len(lexicon)] = 0
    hit = lexicon[at] == ent
    word_hit = np.flatnonzero(hit.any(axis=1))
    if not len(word_hit):
        return out
    out[:, 2] = np.bincount(text[word_hit], minlength=len(texts)) / np.maximum(words, 1)
    kinds = np.unique(np.stack([text[word_hit].astype(_U), ent[word_hit, 0]]), axis=1)
    out[:, 0] = np.bincount(kinds[0].astype(np.int64), minlength=len(texts))
    rows, cols = np.nonzero(hit)
    pairs = np.unique(np.stack([text[rows], at[rows, cols]]), axis=1)
    out[:, 1] = np.log1p(np.bincount(pairs[0], minlength=len(texts)))
    np.maximum.at(out[:, 3], pairs[0], weight[pairs[1]])
    out[:, 4] = np.log1p(np.bincount(pairs[0], weights=weight[pairs[1]], minlength=len(texts)))
    return out


def _damped(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[:, 0] = np.log1p(x[:, 0])
    out[:, 2] = np.log1p(100 * x[:, 2])
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, y, half (0 or 1), text: at most ``sample_rows`` rows of either label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = pick(0).unionAll(pick(1))  # a bounded number of ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def described(sample: DataFrame) -> DataFrame:
    """doc_id, y, sketch (the least hash of three neighbouring words) and the
    text's distinct entries."""
    @task
    def run(batches):
        for batch in batches:
            lo = 0
            for part in parts(batch.column(2)):
                ent, text = entries(part)
                bounds = np.searchsorted(text, np.arange(len(part) + 1))
                lists, sketch = [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    lists.append(np.unique(ent[a:b]).view(np.int64))
                    w = ent[a:b, 0]
                    with np.errstate(over="ignore"):
                        three = mix(w[:-2] + w[1:-1] * _AT[1] + w[2:] * _AT[2]) if len(w) > 2 else mix(w.sum(keepdims=True) + _U(len(w)))
                    sketch.append(int(three.min().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), batch.column(1).slice(lo, len(part)), pa.array(sketch, pa.int64()),
                                                  pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "y", "sketch", "entries"])
                lo += len(part)

    return with_workers(sample.select("doc_id", "y", "text")).mapInArrow(run, "doc_id long, y int, sketch long, entries array<long>")


def learn_lexicon(rows: DataFrame, limit: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """Entries (sorted hashes) and weights (log lift) from (y, entries)."""
    n1, n0 = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not n1 or not n0:
        return np.empty(0, _U), np.empty(0)
    e = rows.select("y", F.explode("entries").alias("entry")).groupBy("entry").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    lift = (F.col("n1") / n1) / ((F.col("n0") + 0.5) / n0)
    need = max(3, SHARE * n1)
    # a clean occurrence or two must not hide an entry, few toxic ones not make one
    got = e.where(f"n1 >= {need}").withColumn("lift", lift).where(F.col("lift") >= min(LIFT, n0 / 2)).orderBy(F.desc(F.col("n1") * F.log("lift")), "entry").limit(limit).collect()
    hashes = np.array([r["entry"] for r in got], np.int64).view(_U)
    order = np.argsort(hashes)
    return hashes[order], np.log(np.array([r["lift"] for r in got], float))[order]


class Logistic:
    """Linear model on standardised inputs, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.w, self.share = None, float(y.mean()) if len(y) else 0.0
        if self.share in (0.0, 1.0):
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._inputs(x)
        self.w = np.zeros(z.shape[1])
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def _inputs(self, x):
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -20, 20)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._inputs(x) @ self.w, -30, 30)))


class Chain:
    """One logistic model per category; each also sees the earlier probabilities."""

    def __init__(self, x: np.ndarray, targets: np.ndarray, fold: np.ndarray, folds: int = FOLDS):
        self.models, earlier = [], np.zeros((len(x), 0))
        for k in range(targets.shape[1]):
            inputs = np.column_stack([x, earlier])
            self.models.append(Logistic(inputs, targets[:, k]))
            out = np.zeros(len(x))
            for f in range(folds):
                rest = fold != f
                out[~rest] = Logistic(inputs[rest], targets[rest, k]).predict(inputs[~rest]) if rest.any() else self.models[-1].share
            earlier = np.column_stack([earlier, out])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories) probabilities."""
        p = np.zeros((len(x), 0))
        for m in self.models:
            p = np.column_stack([p, m.predict(np.column_stack([x, p]))])
        return p


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(lexicon, weights, chain) learned from the labelled sample; the driver
    sees one short row per sampled document."""
    sample = cut(labelled_sample(docs, labels, sample_rows))
    rows = cut(described(sample))
    single = rows.groupBy("sketch", "y").agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id")).select("doc_id").distinct()
    rows = rows.join(single, "doc_id", "left_semi").withColumn("half", F.pmod(F.xxhash64("sketch", F.lit(7)), F.lit(2)))
    rows = cut(rows.drop("y", "sketch").join(sample, "doc_id"))
    lexicon, weight = learn_lexicon(rows)
    other = [learn_lexicon(rows.where(f"half = {1 - h}")) for h in (0, 1)]

    @task
    def run(batches):
        for batch in batches:
            for h in (0, 1):
                own, lo = batch.filter(pa.compute.equal(batch.column(3), h)), 0
                for part in parts(own.column(2)):
                    x = signs(part, *other[h])
                    yield pa.RecordBatch.from_arrays([own.column(0).slice(lo, len(part)), own.column(1).slice(lo, len(part)), *(pa.array(x[:, i]) for i in range(SIGNS))],
                                                     names=["doc_id", "y", *(f"x{i}" for i in range(SIGNS))])
                    lo += len(part)

    train = rows.select("doc_id", "y", "text", "half")
    t = with_workers(train).mapInArrow(run, "doc_id long, y int, " + ", ".join(f"x{i} double" for i in range(SIGNS))).orderBy("doc_id").toArrow()
    x = np.column_stack([t[f"x{i}"].to_numpy() for i in range(SIGNS)]) if len(t) else np.zeros((0, SIGNS))
    y = t["y"].to_numpy().astype(float)
    targets = np.column_stack([y * (x[:, 0] >= 1), y * (x[:, 0] >= SEVERE), y * (x[:, 2] >= SATURATED), y])
    fold = (mix(t["doc_id"].to_numpy().view(_U)) % _U(FOLDS)).astype(int)
    return lexicon, weight, Chain(_damped(x), targets, fold)


def _probabilities(texts: pa.Array, lexicon: np.ndarray, weight: np.ndarray, chain: Chain) -> np.ndarray:
    p = [chain.predict(_damped(signs(part, lexicon, weight))) for part in parts(texts)]
    return np.concatenate(p) if p else np.zeros((0, len(CATEGORIES)))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, p_insult, p_severe, p_saturated,
    score (of ``toxic``), predicted (1: toxic), kept."""
    model = fit(docs, labels, sample_rows)

    @task
    def run(batches):
        for batch in batches:
            p = _probabilities(batch.column(1), *model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(CATEGORIES)))], names=["doc_id", *CATEGORIES])

    src = with_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    p = src.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))
    toxic = F.col("toxic") >= threshold
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *(F.col(c).alias(f"p_{c}") for c in CATEGORIES[:-1]),
                    F.col("toxic").alias("score"), toxic.cast("int").alias("predicted"), (~toxic).alias("kept"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` with all their columns that are not toxic."""
    model = fit(docs, labels, sample_rows)
    at = docs.columns.index("text")

    @task
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(batch.column(at), *model)[:, -1] < threshold, pa.bool_()))

    return with_workers(docs).mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
