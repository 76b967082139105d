"""Near-duplicate embeddings: int8 tiles with rigorous error bounds.

Vectors that are equal bit by bit form a class and are one node. Random-hyperplane
bands send similar nodes to common buckets; buckets are worked through in tiles of
at most ``TILE`` x ``TILE`` vectors, however large they are. In a tile, unit
vectors are rounded to int8 codes with one step per vector, and all products of a
tile are taken on the codes. If ``x = step * code + e`` with ``|e| <= err``, then

    |<x, y> - step_x * step_y * <code_x, code_y>| <= err_x + err_y + err_x * err_y

for unit vectors, whatever the data. Pairs that may reach the threshold under this
bound, and only these, are recomputed in double precision from the original
components. A tile returns the number of links per vector and a forest of links,
not the links.

A pair that meets in several buckets counts in the first one only. The number of
hyperplanes in a band follows the number of vectors, so that buckets keep their
size, and the number of bands follows from ``MISS``, the chance that two vectors at
the threshold share no bucket.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components link with nothing, and so do rows without vec_id; vectors of different
length are not compared; rows that share a vec_id are one node per distinct vector;
an empty table gives an empty table; labels and other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import cut, read, task, with_workers
from netsieve.llm.components import UnionFind, components
from netsieve.llm.vectors import gaussian, matrix, usable

THRESHOLD = 0.95
TILE = 512
BUCKET = 64  # unrelated vectors wanted in a bucket
MISS = 1e-6
SLACK = 1e-9  # covers rounding of the double-precision arithmetic itself


def bands_for(vectors: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(hyperplanes in a band, bands) for a table of so many vectors."""
    planes = max(1, math.ceil(math.log2(max(vectors, 1) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log1p(-agree))


def band_keys(x: np.ndarray, planes: int, bands: int) -> np.ndarray:
    """(rows, bands) bucket keys; scale does not matter."""
    bits = (x @ gaussian(x.shape[1], planes * bands, 11) > 0).reshape(len(x), bands, planes)
    packed = bits @ (1 << np.arange(planes, dtype=np.int64))
    return packed + (np.arange(bands, dtype=np.int64) << 40)


def int8_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, step and error bound of unit rows. The bound is the length of what
    rounding left, enlarged by far more than its own arithmetic can be off."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    codes = np.rint(x / step)
    err = np.linalg.norm(x - codes * step, axis=1) * (1 + 1e-9) + 1e-12
    return codes.astype(np.int8), step[:, 0], err


def bucketed(nodes: DataFrame, planes: int, bands: int) -> DataFrame:
    """key, dim, node, copies, v for every bucket of every node."""
    @task
    def run(batches):
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(size):
                rows = batch.take(pa.array(np.flatnonzero(size == dim)))
                for lo in range(0, len(rows), 2000):
                    part = rows.slice(lo, 2000)
                    keys = band_keys(matrix(part.column(2)), planes, bands)
                    keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), keys], names=["node", "copies", "v", "keys"])

    kind = dict(nodes.dtypes)["v"]
    keyed = with_workers(nodes.select("node", "copies", "v")).mapInArrow(run, f"node long, copies long, v {kind}, keys array<long>")
    return keyed.select("node", "copies", F.size("v").alias("dim"), "v", F.explode("keys").alias("key"))


def tile_links(buckets: DataFrame, sizes: DataFrame, planes: int, bands: int, threshold: float, tile: int = TILE) -> DataFrame:
    """Rows of two kinds: (node, links, NULL) with links found for a node in one
    tile, and (a, 0, b) for the links of a tile's forest."""
    placed = buckets.join(sizes, ["dim", "key"]).withColumn("tiles", F.ceil(F.col("n") / tile))
    placed = placed.withColumn("slot", F.pmod(F.xxhash64("node", "key"), F.col("tiles")))
    # tile (s, t), s <= t, takes the vectors of both slots
    other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("slot")).alias("s"), F.greatest(k, F.col("slot")).alias("t")))
    dealt = placed.select("dim", "key", "node", "copies", "v", "slot", F.explode(other).alias("st")).select("dim", "key", "node", "copies", "v", "slot", "st.s", "st.t")

    def run(t: pa.Table) -> pa.Table:
        key = t["key"][0].as_py()
        band, s, e = key >> 40, t["s"][0].as_py(), t["t"][0].as_py()
        node, copies, slot = (t[c].to_numpy() for c in ("node", "copies", "slot"))
        v = matrix(t["v"])
        x = v / np.abs(v).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes, step, err = int8_codes(x)
        left, right = np.flatnonzero(slot == s), np.flatnonzero(slot == e)
        # products of codes are integers below 2**24: exact in float32 for up to 1040
        # dimensions; beyond that, double
        kind = np.float32 if x.shape[1] <= 1040 else np.float64
        a, b = codes[left].astype(kind), codes[right].astype(kind)
        sets, forest, count = UnionFind(), [], np.zeros(len(node), np.int64)
        for lo in range(0, len(left), 256):
            l = left[lo:lo + 256]
            about = (a[lo:lo + 256] @ b.T).astype(np.float64) * step[l][:, None] * step[right]
            bound = err[l][:, None] + err[right] + err[l][:, None] * err[right] + SLACK
            i, j = np.nonzero(about + bound >= threshold)
            i, j = l[i], right[j]
            if s == e:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 50_000):
                p, q = i[at:at + 50_000], j[at:at + 50_000]
                linked = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[linked], q[linked]
                if not len(p):
                    continue
                # count a pair in the first band in which it meets
                ends, back = np.unique(np.concatenate((p, q)), return_inverse=True)
                keys = band_keys(v[ends], planes, bands)
                first = (keys[back[:len(p)]] == keys[back[len(p):]]).argmax(axis=1) == band
                np.add.at(count, p[first], copies[q[first]])
                np.add.at(count, q[first], copies[p[first]])
                for c, d in zip(node[p].tolist(), node[q].tolist()):
                    if sets.union(c, d):
                        forest.append((c, d))
        some = np.flatnonzero(count)
        return pa.table({"a": pa.array(np.concatenate((node[some], np.array([f[0] for f in forest], np.int64)))),
                         "links": pa.array(np.concatenate((count[some], np.zeros(len(forest), np.int64)))),
                         "b": pa.array([None] * len(some) + [f[1] for f in forest], pa.int64())})

    return with_workers(dealt).groupBy("dim", "key", "s", "t").applyInArrow(run, "a long, links long, b long")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, miss: float = MISS,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept."""
    good = cut(usable(embeddings, id_col, vec_col))
    # equal vectors are one node, named by the least vec_id
    nodes = cut(good.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    planes, bands = bands_for(nodes.count(), threshold, miss)
    buckets = cut(bucketed(nodes, planes, bands))
    sizes = buckets.groupBy("dim", "key").agg(F.count("*").alias("n")).where("n > 1")
    found = cut(tile_links(buckets, sizes, planes, bands, threshold, tile))
    comp = components(found.where("b is not null").select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    per_node = (nodes.join(links, nodes["node"] == links["a"], "left").join(comp, "node", "left")
                .select("node", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component")))
    named = good.join(per_node, "v").groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id")).join(named, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.col("vec_id").eqNullSafe(component).alias("kept"))


def op2_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
