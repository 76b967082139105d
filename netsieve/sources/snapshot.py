"""Block snapshots.

A snapshot document is ``{"version": 2, "saved_at": ..., "blocked_ips":
{"src|dst|proto": expiry_epoch, ...}}`` (version 1 keys carry a leading
``dpid|``). The writer emits one document per partition, so no task or
driver ever holds the whole block table; the reader accepts any number of
documents of either version.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("saved_at", T.StringType()),
    T.StructField("blocked_ips", T.MapType(T.StringType(), T.DoubleType())),
])


def _epoch_s(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def write_block_snapshot(blocks: DataFrame, path: str, now, saved_at: str | None = None) -> None:
    """Keep blocks unexpired at ``now`` (expiry > now) and write them as
    version-2 snapshot documents keyed ``src|dst|proto``."""
    from netsieve.session import ship_package
    ship_package(blocks.sparkSession)
    live = blocks.filter(F.col("expiry_ts") > F.lit(now))
    key = F.concat_ws("|", F.col("block_src"), F.coalesce(F.col("dst_ip"), F.lit("*")),
                      F.col("ip_proto").cast("string"))
    entries = live.select(key.alias("k"), _epoch_s("expiry_ts").alias("v"))
    saved = saved_at or "unknown"

    def docs(it):
        import pandas as pd
        for pdf in it:  # one document for each Arrow batch: bounded, whatever a partition holds
            if len(pdf):
                m = dict(zip(pdf["k"], pdf["v"].astype(float)))
                yield pd.DataFrame({"value": [json.dumps({"version": 2, "saved_at": saved,
                                                          "blocked_ips": m})]})

    entries.mapInPandas(docs, "value STRING").write.mode("overwrite").text(path)


def read_block_snapshot(spark: SparkSession, path: str, now) -> DataFrame:
    """Entries of all snapshot documents under ``path``; v1 keys drop the
    switch id, v2 keys are used as they are, other key shapes are ignored;
    entries expired at ``now`` are dropped."""
    docs = spark.read.option("wholetext", False).text(path)
    d = docs.select(F.from_json("value", SNAPSHOT_SCHEMA).alias("d")).filter(F.col("d").isNotNull())
    e = d.select(F.col("d.version").alias("version"),
                 F.explode(F.col("d.blocked_ips")).alias("k", "expiry"))
    parts = F.split("k", r"\|")
    n = F.size(parts)
    off = F.when(n == 4, 1).otherwise(0)
    get = lambda i: F.element_at(parts, off + i)
    out = e.filter((n == 3) | (n == 4)).select(
        get(1).alias("block_src"),
        F.when(get(2) != "*", get(2)).alias("dst_ip"),
        get(3).try_cast("int").alias("ip_proto"),
        F.timestamp_micros(F.round(F.col("expiry") * 1e6).cast("bigint")).alias("expiry_ts"),
    )
    return out.filter(F.col("expiry_ts") > F.lit(now).cast("timestamp"))
