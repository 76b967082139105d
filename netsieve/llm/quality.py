"""Quality classifier: random-indexing document vectors and a two-layer network.

Word vectors come from all documents (``random_indexing``). The network (one
hidden layer) learns from at most ``SAMPLE_ROWS`` labelled documents, those with
the least id hashes; labels of held-out rows, and lang, source and doc_id as
inputs, are never used. A fifth of the sample sets the temperature that calibrates
the probabilities.

Defined results: NULL or empty text scores as a text without words; rows of
``labels`` with NULL or other values than 0 and 1 teach nothing; without both
labels in the sample every score is the share of label 1 (0.5 without any); one
row per row of ``docs``, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import held_out, read, task, with_workers
from netsieve.llm.random_indexing import FEATURES, document_vectors, parts, pooled, word_vectors

SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.7


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """Input, tanh layer, logistic output; trained with Adam on log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 0):
        self.share = float(y.mean()) if len(y) else 0.5
        self.temperature = 1.0
        self.w = None
        if len(y) < 10 or self.share in (0.0, 1.0):
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        tune, train = order[:len(y) // 5], order[len(y) // 5:]
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for epoch in range(epochs):
            rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for lo in range(0, len(train), 256):
                rows = train[lo:lo + 256]
                h = np.tanh(z[rows] @ self.w[0] + self.w[1])
                g = (_sigmoid(h @ self.w[2] + self.w[3]) - y[rows]) / len(rows)
                gh = g[:, None] * self.w[2] * (1 - h * h)
                grads = [z[rows].T @ gh + 1e-4 * self.w[0], gh.sum(0), h.T @ g + 1e-4 * self.w[2], g.sum(keepdims=True)]
                t += 1
                for k, gr in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr * gr
                    self.w[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
            rng.shuffle(train)
        if len(tune):
            self.temperature = self._fit_temperature(self.logits(x[tune]), y[tune])

    @staticmethod
    def _fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
        """The temperature with the least log loss, by golden section on its log.
        Targets are those of a count of one more row of the other label, so that
        a set without errors does not call for certainty."""
        n1 = y.sum()
        y = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        def loss(log_t):
            p = z / np.exp(log_t)
            return np.mean(np.logaddexp(0, p) - y * p)
        lo, hi, ratio = np.log(0.02), np.log(50.0), (5 ** 0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        return float(np.exp((lo + hi) / 2))

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.share)
        return _sigmoid(self.logits(x) / self.temperature)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, text and label y of at most ``sample_rows`` labelled documents
    outside the held-out part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # a bounded number of ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


class Scorer:
    """Word vectors of a corpus and the network learned on them."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
        self.vectors = word_vectors(docs)
        sample = labelled_sample(docs, labels, sample_rows)
        t = document_vectors(sample, self.vectors, ["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("features", "y").toArrow()
        x = pa.concat_arrays(t["features"].chunks).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64) if len(t) else np.zeros((0, FEATURES))
        self.network = Network(x, np.asarray(t["y"].to_numpy(), np.float64))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        x = [pooled(part, *self.vectors) for part in parts(texts)]
        return self.network.scores(np.concatenate(x).astype(np.float64)) if x else np.empty(0)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scorer = Scorer(docs, labels, sample_rows)

    @task
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(batch.column(1)))], names=["doc_id", "score"])

    scored = with_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` with all their columns whose score reaches the threshold."""
    scorer = Scorer(docs, labels, sample_rows)
    at = docs.columns.index("text")

    @task
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at)) >= threshold, pa.bool_()))

    return with_workers(docs).mapInArrow(run, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
