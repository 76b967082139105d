"""Keyed, time-ordered scans that stay parallel when one key is hot.

A window ``PARTITION BY key`` puts every row of a key in one task; with one
key holding a third of all rows that task is the job. These helpers
partition by (key, time bucket) instead and bring in what a bucket needs
from the key's earlier buckets through a small per-(key, bucket) table (one
row per bucket, so a hot key adds bucket-count rows, not data rows):

* ``split_lag``      — the previous ``n`` rows of the key (exact).
* ``split_running``  — running sum / max / count of the key (exact).

A bucket that holds more than ``PART_ROWS`` rows, as the victim of a flood has
them within minutes, is cut again into parts of about equal rows, by counts of
its time slices (``with_buckets``).

Results equal the plain key-partitioned window for any bucket width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of a scan bucket before hot ones are cut; correctness does not depend on it.
DEFAULT_BUCKET_SEC = 3600.0
# Rows of a part of a hot bucket. The table of cuts has at most one row per
# PART_ROWS rows of the input and 2 * PART_SLICES numbers per PART_ROWS rows.
PART_ROWS = 1_000_000
PART_SLICES = 16


def time_bucket(ts: str, bucket_sec: float) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bucket_sec * 1e6)).cast("bigint")


def with_buckets(df: DataFrame, ts: str, bucket_sec: float, part_rows: int | None = None) -> DataFrame:
    """Add ``__b`` = (clock bucket, part) to rows with a key ``__kk``: it grows with
    ``ts`` within a key, and rows of one time share it.

    Buckets of at most ``part_rows`` rows have one part. The others are divided into
    equal time slices, about ``PART_SLICES`` for every ``part_rows`` rows; a part is
    a row of slices that together begin within the same ``part_rows`` rows. So a
    part has no more than that and one slice. The rows themselves are not shuffled:
    counts are aggregates with a map-side step, the cuts a broadcast table, bounded
    as stated at ``PART_ROWS``."""
    part_rows = part_rows or PART_ROWS
    width = bucket_sec * 1e6
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    d = df.withColumn("__clock", time_bucket(ts, bucket_sec))
    at = F.greatest(us - F.col("__clock") * F.lit(width), F.lit(0.0)) / width  # place in the bucket, from 0 to 1

    def slice_of(n):
        return F.least(F.floor(at * n).cast("int"), n - 1)

    hot = (d.groupBy("__kk", "__clock").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > part_rows)
            .select("__kk", "__clock", F.ceil(F.col("__n") * PART_SLICES / part_rows).cast("int").alias("__m")))
    counts = (d.select("__kk", "__clock", at.alias("__at")).join(F.broadcast(hot), ["__kk", "__clock"])
               .select("__kk", "__clock", "__m", F.least(F.floor(F.col("__at") * F.col("__m")).cast("int"), F.col("__m") - 1).alias("__s"))
               .groupBy("__kk", "__clock", "__m", "__s").agg(F.count(F.lit(1)).alias("__n")))
    before = Window.partitionBy("__kk", "__clock").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / part_rows).cast("int")
    cuts = (counts.select("__kk", "__clock", "__m", "__s", part.alias("__part"))
                  .groupBy("__kk", "__clock", "__m")
                  .agg(F.map_from_entries(F.collect_list(F.struct("__s", "__part"))).alias("__parts")))
    # slices without rows are never looked up: the array takes any number there
    cuts = cuts.select("__kk", "__clock", "__m", F.transform(F.sequence(F.lit(0), F.col("__m") - 1),
                                                             lambda i: F.coalesce(F.col("__parts")[i], F.lit(0))).alias("__parts"))
    j = d.join(F.broadcast(cuts), ["__kk", "__clock"], "left")
    p = F.when(F.col("__m").isNotNull(), F.get("__parts", slice_of(F.col("__m")))).otherwise(0)
    return j.withColumn("__b", F.struct(F.col("__clock"), F.coalesce(p, F.lit(0)).alias("__part"))).drop("__clock", "__m", "__parts")


def key_struct(keys: list[str]) -> Column:
    """One non-null surrogate for a composite key. Struct equality treats NULL
    fields as equal, so windows, aggregates and equi-joins on it keep the
    NULL-key group (as the reference's 'unknown' value does) and share one
    hash partitioning — no null-safe join expression that forces a reshuffle."""
    return F.struct(*[F.col(k) for k in keys])


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    r = right
    for k in keys + ["__b"]:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys] + [left["__b"] == r["__r___b"]]
    j = left.join(r, cond, how)
    return j.drop(*[f"__r_{k}" for k in keys + ["__b"]])


def split_lag(df: DataFrame, keys: list[str], order: list[str], cols: list[str], n: int = 1,
              bucket_sec: float = DEFAULT_BUCKET_SEC, prefix: str = "prev", part_rows: int | None = None) -> DataFrame:
    """Add ``{prefix}{k}`` (k = 1..n): struct of ``cols`` of the k-th previous
    row of the same key in ``order`` (first order column is the timestamp),
    NULL when there is none. Rows with a NULL timestamp must be filtered out
    (or given their own key) by the caller."""
    d0 = with_buckets(df.withColumn("__kk", key_struct(keys)), order[0], bucket_sec, part_rows)
    w = Window.partitionBy("__kk", "__b").orderBy(*order)
    wp = Window.partitionBy("__kk", "__b")
    rec = F.struct(*[F.col(c) for c in cols])
    # one sort, one pass: position, bucket size and the n lags together
    d = d0.select("*", F.row_number().over(w).alias("__p"), F.count(F.lit(1)).over(wp).alias("__cnt"),
                  *[F.lag(rec, k).over(w).alias(f"__l{k}") for k in range(1, n + 1)])
    if n == 1:
        # the last row of every (key, bucket) is an aggregate with a map-side
        # partial step: this branch shuffles one row per bucket per task
        last = F.max_by(rec, F.struct(*[F.col(o) for o in order]))
        tail = d0.groupBy("__kk", "__b").agg(F.array(F.struct(F.lit(1).alias("__p"), last.alias("v")))
                                             .alias("__t"))
    else:
        # the last n rows of every (key, bucket), from the windowed rows
        tail = (d.filter(F.col("__p") > F.col("__cnt") - n)
                  .groupBy("__kk", "__b")
                  .agg(F.sort_array(F.collect_list(F.struct(F.col("__p"), rec.alias("v")))).alias("__t")))
    # rows carried into a bucket: last n rows of the previous n non-empty buckets
    wb = Window.partitionBy("__kk").orderBy("__b").rowsBetween(-n, -1)
    flat = F.flatten(F.collect_list("__t").over(wb))
    carry = tail.select("__kk", "__b", flat.alias("__c"))
    carry = carry.select("__kk", "__b", F.slice("__c", F.greatest(F.size("__c") - n + 1, F.lit(1)), n)
                         .alias("__c"))
    j = d.join(carry, ["__kk", "__b"], "left")
    outs = {}
    for k in range(1, n + 1):
        back = F.greatest(F.lit(k) - F.col("__p") + 1, F.lit(1))
        from_carry = F.try_element_at(F.col("__c"), -back)["v"]
        outs[f"{prefix}{k}"] = F.when(F.col("__p") > k, F.col(f"__l{k}")).otherwise(from_carry)
    j = j.withColumns(outs)
    return j.drop("__kk", "__b", "__p", "__cnt", "__c", *[f"__l{k}" for k in range(1, n + 1)])


def split_running(df: DataFrame, keys: list[str], order: list[str],
                  sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
                  bucket_sec: float = DEFAULT_BUCKET_SEC, part_rows: int | None = None) -> DataFrame:
    """Add inclusive running sums and maxima per key in ``order``."""
    sums, maxes = sums or {}, maxes or {}
    d = with_buckets(df.withColumn("__kk", key_struct(keys)), order[0], bucket_sec, part_rows)
    d0 = d.withColumns({f"__v_{n}": e for n, e in {**sums, **maxes}.items()})
    w = Window.partitionBy("__kk", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d0.select("*", *[F.sum(f"__v_{n}").over(w).alias(f"__in_{n}") for n in sums],
                  *[F.max(f"__v_{n}").over(w).alias(f"__in_{n}") for n in maxes])
    # bucket totals: an aggregate with a map-side partial step on the input
    tot = d0.groupBy("__kk", "__b").agg(*[F.sum(f"__v_{n}").alias(f"__bt_{n}") for n in sums],
                                        *[F.max(f"__v_{n}").alias(f"__bt_{n}") for n in maxes])
    wb = Window.partitionBy("__kk").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select("__kk", "__b",
                       *[F.sum(f"__bt_{n}").over(wb).alias(f"__c_{n}") for n in sums],
                       *[F.max(f"__bt_{n}").over(wb).alias(f"__c_{n}") for n in maxes])
    j = d.join(carry, ["__kk", "__b"], "left")
    j = j.withColumns({**{n: F.coalesce(F.col(f"__c_{n}"), F.lit(0)) + F.col(f"__in_{n}") for n in sums},
                       **{n: F.greatest(F.col(f"__c_{n}"), F.col(f"__in_{n}")) for n in maxes}})
    drop = ["__kk", "__b"] + [f"__{p}_{n}" for n in {**sums, **maxes} for p in ("v", "in", "c")]
    return j.drop(*drop)
