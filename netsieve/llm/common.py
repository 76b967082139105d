"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.session import checkpoint_dir, ship_package

# The white space that separates words (space and \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at ``df``: rows go to the shared checkpoint folder once
    and later jobs read them there, also after executors are lost."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        checkpoint_dir(spark)
    return df.checkpoint()


BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_workers(df: DataFrame) -> DataFrame:
    """``df``, with the package importable in the Python workers, and texts sent
    there in batches of at most ``BATCH_BYTES`` (a limit by rows would let long
    texts fill an executor)."""
    spark = df.sparkSession
    ship_package(spark)
    if int("".join(filter(str.isdigit, spark.conf.get(_LIMIT)))) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    return df


def word_count(text: Column) -> Column:
    """Number of words of a text; NULL counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash60(*parts: Column) -> Column:
    """A reproducible 60-bit number from md5, the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


IDLE_SECONDS = 25
_kept: dict[str, list] = {}  # name: when last used, what
_used: set[str] = set()  # in the present task


def _give_back() -> None:
    """Return freed memory to the system: idle workers count too."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _enter() -> None:
    for name in [n for n, (at, _) in _kept.items() if time.monotonic() - at > IDLE_SECONDS]:
        del _kept[name]


def _leave() -> None:
    for name in _used:
        _kept[name][0] = time.monotonic()
    _used.clear()
    _give_back()


def task(run):
    """Wrap a function of ``mapInArrow``. Python workers live on after a task:
    what they kept and have not used for ``IDLE_SECONDS`` is let go before, and
    freed memory is given back after. (Closures travel by value: what they share
    with the worker they reach through functions of this module.)"""
    @functools.wraps(run)
    def wrapped(batches):
        _enter()
        try:
            yield from run(batches)
        finally:
            _leave()

    return wrapped


def kept(name: str, make):
    """What ``make`` returns, once for all tasks that a worker runs in a row."""
    if name not in _kept:
        _kept[name] = [0.0, make()]
    _kept[name][0] = time.monotonic()
    _used.add(name)
    return _kept[name][1]
