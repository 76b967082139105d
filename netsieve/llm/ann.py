"""Approximate nearest neighbours by shifted space-filling curves.

Every curve projects the vectors to a few dimensions with a random map of its own,
shifts the grid, and orders all rows by their place on the Hilbert curve through
it. The order is cut into up to ``BLOCKS`` key ranges, and a query is compared with the
rows of its own and the two neighbouring ranges; the best of each window are merged
over the curves and ranked by the exact measure on the original vectors.

Nearness is the inner product. Rows get one more coordinate that brings all to one
norm, that of the ``LONG`` quantile, queries a zero, after which the nearest row on
the sphere is the one with the largest product. The few rows that are longer still
are compared with every query: one of them would otherwise press all others
together at the sphere's pole.

Ranges and scales are fitted on at most ``SAMPLE_ROWS`` vectors (those with the
least id hashes); every row is indexed. Ranges are worked through in tiles of at
most ``TILE`` rows and queries, so that a range that holds a third of all rows is
many tasks. A window is a fixed share of the rows: recall then does not fall as the
table grows, at a cost that follows queries times rows. ``recall`` measures it.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components take no part; only vectors of one length are compared; a query with
fewer candidates gets them all; ties go to the smaller vec_id; rows that repeat a
vec_id are one candidate with the better score; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from netsieve.llm.common import cut, read, task, with_workers
from netsieve.llm.hilbert import hilbert_index
from netsieve.llm.shingles import _stream
from netsieve.llm.vectors import gaussian, matrix, usable

CURVES = 18
BLOCKS = 48  # key ranges of a curve, each of at least RANGE_ROWS rows
RANGE_ROWS = 1000
DIMENSIONS, BITS = 12, 5  # of a curve's grid
SPREAD = 2.5  # standard deviations that the grid covers on either side
SAMPLE_ROWS = 16_384
TILE = 2048
NEAREST = 20
LONG = 0.99  # share of the rows that the curves order


def lifted(v: np.ndarray, greatest: float, query: bool) -> np.ndarray:
    """Rows on the sphere of radius 1: with the coordinate that is missing to the
    greatest norm, or, for queries, in their own direction."""
    if query:
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        return np.column_stack([u, np.zeros(len(u))])
    u = v / greatest
    return np.column_stack([u, np.sqrt(np.maximum(0, 1 - (u * u).sum(axis=1)))])


class Curves:
    """The curves for vectors of one length."""

    def __init__(self, sample: np.ndarray, greatest: float, curves: int = CURVES, blocks: int = BLOCKS):
        self.greatest, self.curves = greatest, curves
        dim = sample.shape[1] + 1
        self.maps = [gaussian(dim, DIMENSIONS, 500 + c) for c in range(curves)]
        shift = _stream(curves * DIMENSIONS, 77 << 32).astype(np.float64).reshape(curves, DIMENSIONS) / 2.0 ** 64 - 0.5
        fits = ~self.too_long(sample)
        x = lifted(sample[fits] if fits.any() else sample, greatest, False)
        self.scale = [(x @ m).std(axis=0) + 1e-12 for m in self.maps]
        self.centre = [(x @ m).mean(axis=0) + s * sc for m, s, sc in zip(self.maps, shift, self.scale)]
        keys = self._keys(x)
        self.bounds = [np.quantile(k, np.arange(1, blocks) / blocks, method="lower") for k in keys.T]

    def _keys(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.curves), np.int64)
        for c in range(self.curves):
            place = (x @ self.maps[c] - self.centre[c]) / self.scale[c] / SPREAD
            cells = np.clip((place + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            out[:, c] = hilbert_index(cells, BITS)
        return out

    def blocks(self, v: np.ndarray, query: bool) -> np.ndarray:
        """(rows, curves) numbers of key ranges."""
        keys = self._keys(lifted(v, self.greatest, query))
        return np.column_stack([np.searchsorted(b, k, side="left") for b, k in zip(self.bounds, keys.T)])

    def too_long(self, v: np.ndarray) -> np.ndarray:
        return np.linalg.norm(v, axis=1) > self.greatest * 1.001


def fit(good: DataFrame, curves: int, blocks: int, sample_rows: int) -> tuple[dict[int, Curves], int]:
    """Curves by vector length, for the lengths that the sample holds, and the
    number of ranges."""
    greatest, n = good.agg(F.percentile_approx(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), LONG, 10_000), F.count("*")).first()
    blocks = max(1, min(blocks, n // RANGE_ROWS))
    ids = good.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).distinct()
    t = good.join(F.broadcast(ids), "vec_id", "left_semi").limit(sample_rows).select("v").toArrow()
    if not len(t):
        return {}, blocks
    column = pa.concat_arrays(t["v"].chunks)
    size = np.diff(column.offsets.to_numpy())
    return {int(d): Curves(matrix(column.take(pa.array(np.flatnonzero(size == d)))), greatest, curves, blocks) for d in np.unique(size)}, blocks


def indexed(good: DataFrame, fitted: dict[int, Curves], curves: int) -> DataFrame:
    """vec_id, dim, v and per curve the key range as a row and as a query (-1: none).
    The last place is no curve: all rows too long for the curves are its one range,
    and every query asks there. Vectors of other dimensions than the fit has seen
    have one range."""
    @task
    def run(batches):
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(size).tolist():
                rows = batch.take(pa.array(np.flatnonzero(size == d)))
                for lo in range(0, len(rows), 4000):
                    part = rows.slice(lo, 4000)
                    v = matrix(part.column(1))
                    both = [fitted[d].blocks(v, query) if d in fitted else np.zeros((len(v), curves), np.int64) for query in (False, True)]
                    long = fitted[d].too_long(v) if d in fitted else np.zeros(len(v), bool)
                    both[0][long] = -1
                    both = [np.column_stack((b, last)) for b, last in zip(both, (np.where(long, 0, -1), np.zeros(len(v), np.int64)))]
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(b.astype(np.int32).reshape(-1)), curves + 1).cast(pa.list_(pa.int32())) for b in both]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d] * len(v), pa.int32()), part.column(1), *lists], names=["vec_id", "dim", "v", "own", "ask"])

    kind = dict(good.dtypes)["v"]
    return with_workers(good.select("vec_id", "v")).mapInArrow(run, f"vec_id long, dim int, v {kind}, own array<int>, ask array<int>")


def best_products(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, nearest: int):
    """(query_id, vec_id, score) of the ``nearest`` rows of each query. Products
    of pairs are summed alike wherever they are met, so equal vectors tie."""
    got = ([], [], [])
    for lo in range(0, len(queries), 256):
        about = queries[lo:lo + 256] @ rows.T
        for k, line in enumerate(about, lo):
            if len(line) > nearest + 1:
                # the query's own row may be among them; products may be off by rounding
                least = np.partition(line, len(line) - nearest - 1)[len(line) - nearest - 1]
                pick = np.flatnonzero(line >= least - 1e-9 * max(1.0, abs(least)))
            else:
                pick = np.arange(len(line))
            pick = pick[row_ids[pick] != query_ids[k]]
            score = (rows[pick] * queries[k]).sum(axis=1)
            order = np.lexsort((row_ids[pick], -score))[:nearest]
            got[0].append(np.full(len(order), query_ids[k]))
            got[1].append(row_ids[pick][order])
            got[2].append(score[order])
    return [np.concatenate(g) if g else np.empty(0, t) for g, t in zip(got, (np.int64, np.int64, np.float64))]


def window_tops(index: DataFrame, is_query: Column, blocks: int, nearest: int, tile: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every tile of every window."""
    key = ["dim", "curve", "block"]
    rows = index.select("vec_id", "dim", "v", F.posexplode("own").alias("curve", "block")).where("block >= 0")
    asks = index.where(is_query).select("vec_id", "dim", "v", F.posexplode("ask").alias("curve", "at"))
    near = F.filter(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1), lambda b: (b >= 0) & (b < blocks))
    asks = asks.select("vec_id", "dim", "v", "curve", F.explode(near).alias("block"))
    # one row per range: into how many tiles its rows and queries are dealt
    n_rows = rows.groupBy(*key).agg(F.ceil(F.count("*") / tile).alias("row_tiles"))
    n_asks = asks.groupBy(*key).agg(F.ceil(F.count("*") / tile).alias("ask_tiles"))
    tiles = cut(n_rows.join(n_asks, key))
    slot = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = (rows.join(tiles, key).select(*key, "vec_id", "v", F.lit(False).alias("query"), slot("row_tiles").alias("r"), every("ask_tiles").alias("a"))
             .unionAll(asks.join(tiles, key).select(*key, "vec_id", "v", F.lit(True).alias("query"), every("row_tiles").alias("r"), slot("ask_tiles").alias("a"))))

    def run(t: pa.Table) -> pa.Table:
        query, ids, v = t["query"].to_numpy(), t["vec_id"].to_numpy(), matrix(t["v"])
        q, r, s = best_products(v[query], ids[query], v[~query], ids[~query], nearest)
        return pa.table({"query_id": q, "vec_id": r, "score": s})

    return with_workers(dealt).groupBy(*key, "r", "a").applyInArrow(run, "query_id long, vec_id long, score double")


def nearest_neighbours(embeddings: DataFrame, is_query: Column, nearest: int = NEAREST, curves: int = CURVES, blocks: int = BLOCKS,
                       tile: int = TILE, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``is_query`` is a condition on vec_id."""
    good = cut(usable(embeddings, id_col, vec_col))
    fitted, blocks = fit(good, curves, blocks, sample_rows)
    index = cut(indexed(good, fitted, curves))
    tops = window_tops(index, is_query, blocks, nearest, tile)
    merged = tops.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(embeddings: DataFrame, queries: DataFrame, nearest: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Brute force for a small stated set of queries (vec_id): every task compares
    its rows with all queries and returns its best."""
    good = usable(embeddings, id_col, vec_col)
    asked = good.join(queries.select("vec_id"), "vec_id", "left_semi").collect()
    by_dim: dict[int, list] = {}
    for r in asked:
        by_dim.setdefault(len(r["v"]), []).append(r)

    @task
    def run(batches):
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(size).tolist():
                if d in by_dim:
                    rows = batch.take(pa.array(np.flatnonzero(size == d)))
                    q = np.array([r["v"] for r in by_dim[d]], np.float64)
                    got = best_products(q, np.array([r["vec_id"] for r in by_dim[d]]), matrix(rows.column(1)), rows.column(0).to_numpy(), nearest)
                    yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], names=["query_id", "vec_id", "score"])

    tops = with_workers(good).mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 1.0


def op9_hilbert_ann(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
