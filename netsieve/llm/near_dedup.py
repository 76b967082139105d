"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. Every whole text becomes its set of word shingles, one signature and ``BANDS``
   band keys. Documents with equal sets form a class and are one node from here on.
2. Nodes that agree in a band meet in a bucket. Each bucket links its members to
   one of them only, so a bucket of any size gives as many candidate pairs as it
   has members. Pairs are confirmed on the full sets and joined by union-find.
3. A bucket whose members then lie in several components may hold links that the
   star did not try. Such components are gathered into regions, and the members of
   a region outside its largest component are compared with all others, on full
   sets, in tiles of bounded size that return only the links that join components.

So every two documents that share a bucket are compared or known to be connected.
Two sets at the threshold share no bucket with a probability of at most ``MISS``,
more similar ones with a lesser one; the number of bands follows from it.

Defined results: a text without words has an empty set and is linked with nothing;
a text of fewer words than a shingle is one shingle; rows that share a doc_id count
as one document with several texts; rows with NULL doc_id are linked with nothing
and kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from netsieve.llm.common import cut, read, task, with_workers
from netsieve.llm.components import UnionFind, components
from netsieve.llm.shingles import mix, shingle_sets
from netsieve.llm.superminhash import signatures

SHINGLE = 5  # words
THRESHOLD = 80  # per cent of the union
ROWS = 7  # signature places in a band
MISS = 1e-6  # chance that two sets at the threshold share no band
TILE = 256  # members compared in one task


def band_count(threshold: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((threshold / 100) ** rows)))


def _prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and the band keys."""
    m = _prime_from(bands * rows)

    @task
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 2000):
                sets = shingle_sets(texts.slice(lo, 2000).to_pylist(), shingle)
                sig = signatures(sets, m)[:, :bands * rows].reshape(len(sets), bands, rows)
                keys = np.zeros((len(sets), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = mix(keys + sig[:, :, r] + np.arange(1, bands + 1, dtype=np.uint64))
                    prints = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2)
                some = pa.array([len(s) > 0 for s in sets])
                keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 2000), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)),
                     pa.compute.if_else(some, keys, pa.scalar(None, pa.list_(pa.int64())))],
                    names=["doc_id", "n_shingles", "print1", "print2", "bands"])

    src = with_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return src.mapInArrow(run, "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """node and full shingle set of the documents in ``ids`` (node)."""
    @task
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 2000):
                sets = shingle_sets(texts.slice(lo, 2000).to_pylist(), shingle)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 2000), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"])

    some = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(ids, "node", "left_semi")
    return with_workers(some).mapInArrow(run, "node long, shingles array<long>").where("size(shingles) > 0")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    # what joins the other side is the smaller part: one set per pair
    both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    na, nb = F.size("sa"), F.size("sb")
    possible = both.where(100 * F.least(na, nb) >= threshold * F.greatest(na, nb))
    common = F.size(F.array_intersect("sa", "sb"))
    return possible.where(100 * common >= threshold * (na + nb - common)).select("a", "b")


def tile_links(members: DataFrame, threshold: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join components of a region. ``members``: region, comp,
    main (is this the region's largest component), node, n_queries, n_members,
    shingles. Members outside the largest component are queries; each tile holds
    some queries and some members of one region."""
    slot = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(n / tile))
    keep = ["region", "comp", "main", "node", "shingles"]
    q_tiles, m_tiles = F.sequence(F.lit(0), F.ceil(F.col("n_queries") / tile) - 1), F.sequence(F.lit(0), F.ceil(F.col("n_members") / tile) - 1)
    as_query = members.where("not main").select(*keep, F.lit(True).alias("query"), slot(F.col("n_queries"), 1).alias("qt"), F.explode(m_tiles).alias("mt"))
    as_member = members.select(*keep, F.lit(False).alias("query"), F.explode(q_tiles).alias("qt"), slot(F.col("n_members"), 2).alias("mt"))

    def run(t: pa.Table) -> pa.Table:
        shingles = pa.concat_arrays(t["shingles"].chunks)
        ends, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy().view(np.uint64)
        node, comp = t["node"].to_numpy(), t["comp"].to_numpy()
        query, main = t["query"].to_numpy(), t["main"].to_numpy()
        size = np.diff(ends)
        members_ = np.flatnonzero(~query)
        joined, found = UnionFind(), []
        for q in np.flatnonzero(query).tolist():
            # of two queries each sees the other: the greater node asks
            other = members_[(comp[members_] != comp[q]) & (main[members_] | (node[members_] < node[q]))
                             & (100 * np.minimum(size[members_], size[q]) >= threshold * np.maximum(size[members_], size[q]))]
            other = other[[joined.find(int(c)) != joined.find(int(comp[q])) for c in comp[other]]] if len(other) else other
            if not len(other):
                continue
            own = np.sort(flat[ends[q]:ends[q + 1]])
            parts = np.concatenate([flat[ends[k]:ends[k + 1]] for k in other])
            at = np.searchsorted(own, parts)
            at[at == len(own)] = 0
            common = np.add.reduceat((own[at] == parts).astype(np.int64), np.concatenate(([0], np.cumsum(size[other])[:-1])))
            for k in other[100 * common >= threshold * (size[q] + size[other] - common)].tolist():
                if joined.union(int(comp[q]), int(comp[k])):
                    found.append((int(comp[q]), int(comp[k])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    tiles = with_workers(as_query.unionAll(as_member))
    return tiles.groupBy("region", "qt", "mt").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, rows: int = ROWS,
                    miss: float = MISS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id
    (smallest doc_id with the same set), component_id, kept."""
    sig = cut(signed(docs, shingle, band_count(threshold, rows, miss), rows))
    classes = cut(sig.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "print1", "print2")
                  .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))

    # buckets with more than one member, each member with the bucket's centre
    entries = classes.select("node", F.explode("bands").alias("key"))
    # most keys are of one member: they are counted only, and centres chosen among the rest
    shared = cut(entries.join(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key"))
    centres = shared.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("centre"))).alias("c")).select("key", "c.centre")
    buckets = cut(shared.join(centres, "key"))
    pairs = buckets.where("centre <> node").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    sets = cut(sets_of(docs, buckets.select("node").distinct(), shingle))
    comp = components(confirmed(pairs, sets, threshold))

    # components that still meet in a bucket
    placed = (buckets.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")))
    meeting = placed.select("key", "comp").distinct()
    centre = meeting.groupBy("key").agg(F.min("comp").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    touching = meeting.join(centre, "key").where("comp <> centre").select(F.col("comp").alias("a"), F.col("centre").alias("b")).distinct()
    region = components(touching)
    region = region.unionAll(region.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("comp"), F.col("component").alias("region"))
    member = placed.select("node", "comp").distinct().join(region, "comp")
    weight = member.groupBy("region", "comp").agg(F.count("*").alias("n"))
    top = weight.groupBy("region").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n_members"))
    member = member.join(top, "region").select("region", "comp", (F.col("comp") == F.col("top.comp")).alias("main"), "node",
                                               (F.col("n_members") - F.col("top.n")).alias("n_queries"), "n_members")
    more = tile_links(member.join(sets, "node"), threshold, tile)

    # the links found last are between components
    joined = components(more)
    root = joined.select(F.col("node").alias("component"), F.col("component").alias("root"))
    final = comp.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionAll(joined)
    named = sig.drop("bands").join(classes.drop("bands"), ["n_shingles", "print1", "print2"], "left")
    named = named.join(final, "node", "left")
    class_id = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("node", "doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "node", "doc_id"))
    return named.select("doc_id", "n_shingles", class_id.alias("class_id"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, one document of each group.
    Of rows that share a doc_id the one with the least hash stays; rows without
    doc_id stay."""
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    one = docs.join(kept, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*[c for c in docs.columns if c != "text"])))
    name = "_first"
    while name in docs.columns:
        name += "_"
    one = one.withColumn(name, first).where(F.col(name) == 1).drop(name)
    return one.unionAll(docs.where("doc_id is null"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, threshold=85)
