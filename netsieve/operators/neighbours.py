"""Exact nearest rows in feature space (M5), without all pairs.

Rows with equal features are one node. Pivot nodes divide the space into cells (a
node belongs to its nearest pivot), and a node's nearest rows are first looked up in
its own cell. The distance of the last of them bounds where others can be: by the
triangle inequality a cell whose radius ends, or whose dividing plane lies, beyond
that distance holds none. The node is sent to the remaining cells only. Nothing is
capped: a node without enough rows in its cell is sent to all.

Cells are worked through in tiles of at most ``TILE`` x ``TILE`` nodes, so that a
crowded cell is many tasks; what leaves a tile is ``k`` rows per node. A node names
its ``k + 1`` smallest ids, which is all that any list of ``k`` can hold of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.operators._prefix import _materialise
from netsieve.session import ship_package

CELL = 400  # nodes wanted in a cell
MAX_PIVOTS = 2048  # pivots that the driver collects and tasks compare with
TILE = 1024
SLACK = 1e-9  # share by which bounds are widened, far above rounding


def _matrix(column) -> np.ndarray:
    a = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, added up in the order of the columns: a pair gives the
    same number wherever it is met."""
    out = np.zeros((len(a), len(b)))
    d = np.empty_like(out)
    for x, y in zip(a.T, b.T):
        np.subtract(x[:, None], y[None, :], out=d)
        np.multiply(d, d, out=d)
        out += d
    return out


def _tops(node: np.ndarray, v: np.ndarray, asks: np.ndarray, lists: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each row that asks among the others, whose ids are in
    ``lists``: its place, the squared distance, the place in the flattened lists.
    Ties go by id; rows of the same number in ``node`` are left out."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(n) - n
    order = pc.rank(lists.flatten(), sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)
    asking, mv, mn = np.flatnonzero(asks), v[~asks], node[~asks]
    last = min(k, len(mv)) - 1
    out = []
    for lo in range(0, len(asking), 256):
        mine = asking[lo:lo + 256]
        d = squares(v[mine], mv)
        d[node[mine][:, None] == mn[None, :]] = np.inf
        row, col = np.nonzero((d <= np.partition(d, last, axis=1)[:, last:last + 1]) & (d < np.inf))
        each = n[col]
        at = np.arange(each.sum()) + np.repeat(starts[col] - (np.cumsum(each) - each), each)
        row, far = np.repeat(row, each), np.repeat(d[row, col], each)
        by = np.lexsort((order[at], far, row))
        by = by[np.arange(len(by)) - np.searchsorted(row, row) < k]  # the rows are in order before and after
        out.append((mine[row[by]], far[by], at[by]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _nodes(df: DataFrame, id_col: str, cols: list[str], k: int) -> DataFrame:
    """v, node (its smallest id), n (its rows), ids (the k + 1 smallest)."""
    v = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols])
    x = df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col(id_col).isNotNull() & F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))))
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = x.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return x.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(ids, "v").select("v", F.col("ids")[0].alias("node"), "n", "ids")


def _placed(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nodes with their cell and the distance to its pivot."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                if len(part):
                    d = squares(_matrix(part.column(part.schema.get_field_index("v"))), pivots)
                    cell = d.argmin(axis=1)
                    out = np.sqrt(d[np.arange(len(d)), cell])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(out)], names=[*part.schema.names, "cell", "out"])

    return nodes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in nodes.dtypes) + ", cell int, out double")


def _tile_tops(queries: DataFrame, members: DataFrame, k: int, id_type: str, tile: int = TILE) -> DataFrame:
    """(node, d, id): the k nearest rows of each query in every tile of a cell.
    ``queries``: node, v, cell. ``members``: node, v, ids, cell. A node's own rows
    are left out."""
    count = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias(name))
    tiles = _materialise(count(queries, "qt").join(count(members, "mt"), "cell"))  # a row per cell
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = F.lit(None).cast(f"array<{id_type}>").alias("ids")
    q = queries.join(F.broadcast(tiles), "cell").select("cell", "node", "v", none, slot("qt").alias("q"), every("mt").alias("m"))
    m = members.join(F.broadcast(tiles), "cell").select("cell", "node", "v", "ids", every("qt").alias("q"), slot("mt").alias("m"))

    def run(t: pa.Table) -> pa.Table:
        node, own = t["node"].combine_chunks(), t["ids"].combine_chunks()
        asks = np.asarray(own.is_null())
        if asks.all() or not asks.any():
            return pa.table({"node": node.slice(0, 0), "d": pa.array([], pa.float64()), "id": node.slice(0, 0)})
        lists = own.filter(pa.array(~asks))
        at, d, which = _tops(node.dictionary_encode().indices.to_numpy(), _matrix(t["v"]), asks, lists, k)
        return pa.table({"node": node.take(pa.array(at)), "d": pa.array(d), "id": lists.flatten().take(pa.array(which))})

    return q.unionByName(m).groupBy("cell", "q", "m").applyInArrow(run, f"node {id_type}, d double, id {id_type}")


def _best(tops: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("node").orderBy("d", "id"))
    return tops.withColumn("r", r).where(F.col("r") <= k)


def _reachable(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """node, v and a cell for every other cell in which a row as near as
    ``reach`` may lie. ``radius``: of each cell, -1 if it is empty."""
    def run(batches):
        between = np.sqrt(squares(pivots, pivots))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                if not len(part):
                    continue
                v, cell, reach = _matrix(part.column(1)), part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)
                sq = squares(v, pivots)
                own = sq[np.arange(len(sq)), cell]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (sq - own[:, None]) / (2 * between[cell])
                    least = np.fmax(plane, np.sqrt(sq) - radius)
                # what rounding can be off, whatever the sizes of the numbers
                off = SLACK * (np.sqrt(sq) + radius + between[cell]) + SLACK * (sq / np.where(between[cell] > 0, between[cell], 1))
                go = (least <= reach[:, None] * (1 + SLACK) + off) & (radius >= 0)
                go[np.arange(len(sq)), cell] = False
                row, to = np.nonzero(go)
                for at in range(0, len(row), 20_000):
                    take = part.take(pa.array(row[at:at + 20_000]))
                    yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array(to[at:at + 20_000].astype(np.int32))], names=["node", "v", "cell"])

    kind = dict(queries.dtypes)["node"]
    return queries.select("node", "v", "cell", "reach").mapInArrow(run, f"node {kind}, v array<double>, cell int")


def nearest_rows(df: DataFrame, id_col: str, cols: list[str], k: int = 5, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """id, rank (from 1), neighbour, d (squared distance): the ``k`` nearest other
    rows of each row, ties by id; all others where there are fewer. Rows without an
    id, or with a feature that is NULL or not finite, take no part. Ids must be
    unique."""
    ship_package(df.sparkSession)
    nodes = _materialise(_nodes(df, id_col, cols, k))
    id_type = dict(nodes.dtypes)["node"]
    total = nodes.count()
    wanted = min(max(-(-total // cell), 1), MAX_PIVOTS)
    pivots = np.array([r["v"] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("v").collect()], np.float64).reshape(-1, len(cols))
    if not total:
        return nodes.select(F.col("node").alias("id"), F.lit(1).alias("rank"), F.col("node").alias("neighbour"), F.lit(0.0).alias("d"))
    placed = _materialise(_placed(nodes, pivots))
    radius = np.full(len(pivots), -1.0)
    for r in placed.groupBy("cell").agg(F.max("out").alias("r")).collect():  # a row per cell
        radius[r["cell"]] = r["r"]
    members = placed.select("node", "v", "ids", "cell")
    # a node of more than k rows has its nearest rows in itself
    asking = placed.where(F.col("n") <= k)
    inside = _materialise(_best(_tile_tops(asking.select("node", "v", "cell"), members, k, id_type, tile), k))
    need = k + 1 - F.col("n")
    last = (inside.join(asking.select("node", "n"), "node").where(F.col("r") == need).select("node", F.sqrt("d").alias("reach")))
    open_ = asking.join(last, "node", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    more = _tile_tops(_reachable(open_, pivots, radius), members, k, id_type, tile)
    others = _best(inside.drop("r").unionByName(more), k).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("others"))
    lists = nodes.join(others, "node", "left")
    alike = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")))
    lists = lists.select("v", F.concat(alike, F.coalesce("others", F.expr(f"array_repeat(struct(0D AS d, cast(null AS {id_type}) AS id), 0)"))).alias("near"))
    v = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols])
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull()).join(lists, "v")
    mine = F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k)
    return rows.select("id", F.posexplode(mine).alias("at", "e")).select("id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("neighbour"), F.col("e.d").alias("d"))
