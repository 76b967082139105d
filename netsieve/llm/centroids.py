"""Centroid clustering of integer vectors with ns-bounds.

Every vector keeps, for each centroid, a bound and the round in which its distance
was last evaluated: an exact distance to its own centroid then, lower bounds to the
others. The driver keeps the history of all centroids (``rounds + 1`` tables of
``k`` rows). A bound is loosened by how far its centroid has moved in all since
that round, the norm of the total displacement, which the triangle inequality makes
never more than the sum of its moves. Centroids whose lower bound then lies above
the upper bound to the vector's own cannot be nearest; the distances to all others
are evaluated exactly, in integers, and their bounds start anew.

One pass over the vectors is a round: it reads the written table of the last one,
writes the next, and the sums of the clusters are added up per task, then by Spark,
so that no step sees a cluster whole. Only sums, counts and centroids (``k`` rows)
reach the driver.

Vectors are integers, ``floor(scale * x)``. Distances are exact: in double precision
while every number is below 2**53, else in whole numbers of any size. Bounds are
widened by more than their own rounding can be off, and ties are never pruned.

Defined results: vectors that are NULL, of another length, or that hold NULL or
non-finite components are left out, and so are those with a component whose scaled
value does not fit 62 bits; rows that repeat a vec_id, or have none, are vectors of
their own (rows without vec_id come last as starting centroids; ties by the vector);
fewer vectors than ``k`` make fewer centroids; sums of distances and distances
beyond a long are NULL; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import cut, read, task, with_workers

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
COMPONENTS = 64
SEED = 1
SLACK = 1e-9  # share by which bounds are widened
LONG = 2 ** 63 - 1
STATE = "vec_id long, v array<long>, cluster int, distance decimal(38,0), bound array<double>, evaluated array<int>, exact int"


def whole_vectors(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v, the components as integers, of the vectors that take part."""
    v = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(1 << 62)))
    return v.where((F.size("x") == components) & fits).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def start(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least sha256 of ``<seed>:<vec_id>``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select("v", key.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each row of ``c``: int64, or
    Python integers where they would not fit."""
    most = max(abs(int(m)) for a in (x, c) for m in (a.min(initial=0), a.max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # all sums below are whole numbers a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.array([[((p - q) ** 2).sum() for q in b] for p in a], object).reshape(len(x), len(c))


def lengths(sq: np.ndarray) -> np.ndarray:
    return np.sqrt(sq.astype(np.float64))


def displacement(history: list[np.ndarray]) -> np.ndarray:
    """[round, k]: how far each centroid is now from where it was then, rounded up."""
    now = history[-1].astype(object)
    out = [[float(((a - b) ** 2).sum()) for a, b in zip(now, then.astype(object))] for then in history]
    return np.sqrt(np.array(out, np.float64).reshape(len(history), -1)) * (1 + SLACK)


def assign(x: np.ndarray, history: list[np.ndarray], state: tuple | None) -> tuple:
    """(cluster, squared distance, bound, round evaluated, distances evaluated) of
    the rows of ``x`` for the newest centroids. ``state`` is that of an earlier
    round; without one all distances are evaluated."""
    c, now = history[-1], len(history) - 1
    n, k = len(x), len(c)
    rows = np.arange(n)
    if state is None:
        sq = squared(x, c)
        cluster = sq.argmin(axis=1) if sq.dtype != object else np.array([min(range(k), key=r.__getitem__) for r in sq], np.int64)
        return cluster, sq[rows, cluster], lengths(sq) * (1 - SLACK), np.full((n, k), now, np.int32), np.full(n, k)
    cluster, sq_own, bound, evaluated = state
    moved = displacement(history)
    lower = bound - moved[evaluated, np.arange(k)]
    # the own centroid's bound was exact up to SLACK when it was evaluated
    upper = bound[rows, cluster] * (1 + 3 * SLACK) + moved[evaluated[rows, cluster], cluster]
    rival = lower <= upper[:, None]
    rival[rows, cluster] = False
    cluster, sq_own, bound, evaluated = cluster.copy(), sq_own.copy(), bound.copy(), evaluated.copy()
    cost = np.zeros(n, np.int64)

    def evaluate(who: np.ndarray, which: int) -> np.ndarray:
        d = squared(x[who], c[which:which + 1])[:, 0]
        bound[who, which], evaluated[who, which] = lengths(d) * (1 - SLACK), now
        cost[who] += 1
        return d

    # the distance to the own centroid is part of the result, and makes the upper bound exact
    best = np.empty(n, object) if sq_own.dtype == object else np.empty(n, np.int64)
    for j in range(k):
        mine = np.flatnonzero(cluster == j)
        if len(mine):
            d = evaluate(mine, j)
            best = best.astype(object) if d.dtype == object else best
            best[mine] = d
    upper = lengths(best) * (1 + SLACK)
    rival &= lower <= upper[:, None]
    for j in range(k):
        failed = np.flatnonzero(rival[:, j])
        if len(failed):
            d = evaluate(failed, j)
            best = best.astype(object) if d.dtype == object else best
            nearer = (d < best[failed]) | ((d == best[failed]) & (j < cluster[failed]))
            best[failed[nearer]], cluster[failed[nearer]] = d[nearer], j
    return cluster, best, bound, evaluated, cost


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(a: np.ndarray) -> pa.Array:
    flat = pa.array(a.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), flat)


def assigned(rows: DataFrame, history: list[np.ndarray], first: bool) -> DataFrame:
    """One round: the state of every vector for the newest centroids."""
    @task
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                b = batch.slice(lo, 4000)
                x = _matrix(b.column(1), np.int64)
                state = None
                if not first:
                    sq = np.array([int(d) for d in b.column(3).to_pylist()], object)
                    state = b.column(2).to_numpy().astype(np.int64), sq, _matrix(b.column(4), np.float64), _matrix(b.column(5), np.int32)
                cluster, sq, bound, evaluated, cost = assign(x, history, state)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array([int(d) for d in sq], pa.decimal128(38, 0)), _lists(bound), _lists(evaluated.astype(np.int32)),
                     pa.array(cost.astype(np.int32))],
                    names=["vec_id", "v", "cluster", "distance", "bound", "evaluated", "exact"])

    return with_workers(rows).mapInArrow(run, STATE)


def cluster_sums(state: DataFrame) -> DataFrame:
    """cluster, n and the sums of its vectors' components, each as high * 2**31 +
    low. A task returns one row per cluster."""
    @task
    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            x, cluster = _matrix(batch.column(1), np.int64), batch.column(0).to_numpy()
            for j in np.unique(cluster).tolist():
                part = x[cluster == j]
                add = [len(part), (part >> 31).sum(axis=0), (part & ((1 << 31) - 1)).sum(axis=0)]
                total[j] = [a + b for a, b in zip(total[j], add)] if j in total else add
        some = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([total[j][0] for j in some], pa.int64()), *(pa.array([total[j][p].tolist() for j in some], pa.list_(pa.int64())) for p in (1, 2))],
            names=["cluster", "n", "high", "low"])

    parts = with_workers(state.select("cluster", "v")).mapInArrow(run, "cluster int, n long, high array<long>, low array<long>")
    one = parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "p"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return one.select("cluster", "n", "at", "p.high", "p.low").groupBy("cluster", "at").agg(F.sum("n").alias("n"), wide("high"), wide("low"))


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means of the clusters, rounded down; empty clusters keep their centroid."""
    out = centroids.copy()
    for r in cluster_sums(state).collect():  # one row per cluster and component
        out[r["cluster"], r["at"]] = ((int(r["high"]) << 31) + int(r["low"])) // r["n"]
    return out


def centroid_clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED,
                      id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray, list[DataFrame]]:
    """The vectors' last state, the final centroids, and the states of all rounds
    (vec_id, v, cluster, distance, bound, evaluated, exact: distances evaluated)."""
    vectors = cut(whole_vectors(embeddings, components, scale, id_col, vec_col))
    seeds = start(vectors, k, seed)
    history = [np.array(seeds, np.int64).reshape(len(seeds), components)]
    if not seeds:
        return vectors.sparkSession.createDataFrame([], STATE), history[0], []
    states = [cut(assigned(vectors, history, True))]
    for _ in range(rounds):
        history.append(moved_centroids(states[-1], history[-1]))
        states.append(cut(assigned(states[-1], history, False)))
    return states[-1], history[-1], states


def centroid_report(embeddings: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, cluster, distance, the distances summed over its cluster
    and over all, and a digest of its cluster's centroid."""
    state, centroids, _ = centroid_clusters(embeddings, **options)
    spark = embeddings.sparkSession
    digest = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    per = state.groupBy("cluster").agg(F.sum("distance").alias("in_cluster"))
    whole = per.agg(F.sum("in_cluster").alias("in_all"))
    small = per.crossJoin(whole).join(spark.createDataFrame(digest, "cluster int, centroid_sha256 string"), "cluster")  # k rows
    as_long = lambda c: F.when(F.col(c) <= LONG, F.col(c).cast("long"))
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", as_long("distance").alias("distance"), as_long("in_cluster").alias("cluster_inertia"), as_long("in_all").alias("inertia"), "centroid_sha256")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return centroid_report(read(spark, sf_dir, "embeddings"))
