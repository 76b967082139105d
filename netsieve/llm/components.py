"""Connected components of a link table: distributed union-find.

Each task first runs union-find over its own links and keeps a forest of stars, so
what is shuffled is at most one link per node and task. Then large-star and
small-star rounds alternate until only stars are left; every round attaches each node
to the least neighbour of its neighbourhood. Links never reach the driver, and no
step groups a component's members in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from netsieve.llm.common import cut, task, with_workers

MIN_SLOTS, SLOT_LINKS = 64, 100_000


class UnionFind:
    """Sets of hashable nodes; a set's root is its least node."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        p = self.parent
        root = x
        while p.setdefault(root, root) != root:
            root = p[root]
        while p[x] != root:
            p[x], x = root, p[x]
        return root

    def union(self, a, b) -> bool:
        """Join two sets; False if they were one."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(links: DataFrame) -> DataFrame:
    @task
    def run(batches):
        sets = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets.union(a, b)
        nodes = np.fromiter(sets.parent, np.int64, len(sets.parent))
        roots = np.fromiter(map(sets.find, nodes.tolist()), np.int64, len(nodes))
        for lo in range(0, len(nodes), 50_000):
            a, b = nodes[lo:lo + 50_000], roots[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return with_workers(links.select("a", "b")).mapInArrow(run, "a long, b long")


def with_least(links: DataFrame, slots: int) -> DataFrame:
    """``links`` (a, b) with ``m``, the least b of the node a. A node's links meet
    in up to ``slots`` places, each with the node's least."""
    # dealt once, for the least of a slot and for the join with it
    dealt = links.withColumn("slot", F.pmod(F.xxhash64("b"), F.lit(slots)).cast("int")).repartition("a", "slot")
    part = dealt.groupBy("a", "slot").agg(F.min("b").alias("m"))
    least = part.withColumn("m", F.min("m").over(W.partitionBy("a")))  # at most a row per slot
    return dealt.join(least, ["a", "slot"]).select("a", "b", "m")


def _out_of_place(edges: DataFrame) -> tuple[int, int]:
    """The number of ``edges`` (a, b: b < a), and of nodes that keep them from being
    stars around the b: an a with several edges, or with one where it is the b."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(ends.alias("e")).select("e.node", "e.up").groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    loose = F.count(F.when(F.expr("ups > 1 or (ups = 1 and least = 0)"), 1))
    return tuple(nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), loose).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long) that has a link
    to another node and is not itself the least of its component; the least node
    stands for the component. NULL ends and self-links are ignored; repeated
    links change nothing; no links give an empty table."""
    edges = cut(_forest(links.where("a is not null and b is not null and a <> b")))
    for _ in range(max_rounds):
        n, loose = _out_of_place(edges)
        if not loose:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # as many places for one node's links as there are heaps of SLOT_LINKS
        slots = max(MIN_SLOTS, math.ceil(n / SLOT_LINKS))
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        large = with_least(both, slots).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        small = with_least(large, slots)
        edges = cut(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                    .select("e.a", "e.b").where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
