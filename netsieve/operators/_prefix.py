"""Global ranks and running sums without a single-task window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.
Here the rows are range-partitioned by the sort key (a distributed sort),
numbered inside each partition, and shifted by the row counts of the
partitions before them — a table of one row per partition, small by
construction, broadcast after a size check.

The sorted, numbered relation is read twice (partition totals, then the
rows), so it is checkpointed once to the shared checkpoint folder: range
bounds come from sampling and must not be drawn twice.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART_SHIFT = 33  # monotonically_increasing_id puts the partition index in the upper bits


def partition_of(mid: str) -> Column:
    """The partition in which a ``monotonically_increasing_id`` was given."""
    return F.shiftright(mid, _PART_SHIFT)


_HELD = threading.local()  # per thread the checkpoints of each open ``_released`` block


def _materialise(df: DataFrame, outlives: bool = False) -> DataFrame:
    """A checkpoint of ``df``; one that ``outlives`` the innermost ``_released`` block
    belongs to the block around it, if there is one."""
    from netsieve.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    blocks = getattr(_HELD, "blocks", [])[:-1 if outlives else None]
    if blocks:
        blocks[-1].append(out)
    return out


def _release(df: DataFrame) -> None:
    """Remove the files of a checkpoint that is not read again."""
    from netsieve.sources.datasets import _fs
    kept = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if kept.isDefined():
        fs, path = _fs(df.sparkSession, kept.get())
        fs.delete(path, True)


@contextmanager
def _released():
    """Checkpoints that this thread makes in the block are removed at its end: for work
    that ends with rows written or collected. Spark itself keeps them for ever."""
    if not hasattr(_HELD, "blocks"):
        _HELD.blocks = []
    _HELD.blocks.append([])
    try:
        yield
    finally:
        for df in _HELD.blocks.pop():
            _release(df)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Consecutive 1-based position of each row in ``order`` (which must be a
    total order, e.g. ending with a unique id)."""
    s = (df.orderBy(*order)
           .withColumn("__mid", F.monotonically_increasing_id()))
    s = s.withColumn("__pid", partition_of("__mid")) \
         .withColumn("__loc", F.col("__mid") - F.shiftleft(F.col("__pid"), _PART_SHIFT))
    s = _materialise(s)
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return (s.join(F.broadcast(offs), "__pid")
             .withColumn(name, F.col("__off") + F.col("__loc") + 1)
             .drop("__mid", "__pid", "__loc", "__off"))


def global_running_sum(df: DataFrame, order: list[Column], value, name) -> DataFrame:
    """Inclusive running sums in ``order`` (a total order). ``value`` and
    ``name`` may be lists to compute several running sums in one pass."""
    values = [value] if isinstance(value, str) else list(value)
    names = [name] if isinstance(name, str) else list(name)
    s = (df.orderBy(*order)
           .withColumn("__mid", F.monotonically_increasing_id()))
    s = s.withColumn("__pid", partition_of("__mid"))
    s = _materialise(s)
    tot = s.groupBy("__pid").agg(*[F.sum(v).alias(f"__t{i}") for i, v in enumerate(values)])
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = tot.select("__pid", *[F.coalesce(F.sum(f"__t{i}").over(w), F.lit(0)).alias(f"__off{i}")
                                 for i in range(len(values))])
    wl = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, 0)
    x = s.select("*", *[F.sum(v).over(wl).alias(f"__in{i}") for i, v in enumerate(values)])
    x = x.join(F.broadcast(offs), "__pid")
    x = x.withColumns({n: F.col(f"__off{i}") + F.col(f"__in{i}") for i, n in enumerate(names)})
    return x.drop("__mid", "__pid", *[f"__in{i}" for i in range(len(values))],
                  *[f"__off{i}" for i in range(len(values))])
