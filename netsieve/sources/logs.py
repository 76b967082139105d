"""Attack log, performance log, attack-run history and switch dumps
(S6, S7, S11, S16, S17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.functions.network import sanitise_ip
from netsieve.functions.timefmt import parse_ts

# Layouts a log timestamp may take.
LOG_TS_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _read_csv_text(spark: SparkSession, path: str) -> DataFrame | None:
    """All columns as STRING (no inference pass over the data)."""
    if not _exists(spark, path):
        return None
    df = spark.read.option("header", True).option("mode", "PERMISSIVE") \
        .option("inferSchema", False).csv(path)
    if not df.columns or df.limit(1).count() == 0:
        return None
    return df


def attack_log(det: DataFrame, n_switches: int, ts: str = "ts",
               rate: str = "pps", conf: str = "attack_prob") -> DataFrame:
    """S11 row layout: 8 columns, addresses sanitised, rate with 2 decimals,
    confidence with 3, action BLOCKED, switch count."""
    c = F.col(conf) if conf in det.columns else F.lit(0.5)
    return det.select(
        F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        sanitise_ip("src_ip").alias("src_ip"),
        sanitise_ip("dst_ip").alias("dst_ip"),
        F.col("attack_type"),
        F.format_string("%.2f", F.col(rate)).alias("packet_rate"),
        F.format_string("%.3f", c).alias("confidence"),
        F.lit("BLOCKED").alias("action"),
        F.lit(n_switches).cast("int").alias("switches_blocked"),
    )


def write_attack_log(log: DataFrame, path: str) -> None:
    """S11 sink: append CSV parts with a header (idempotent per job attempt
    through the file committer)."""
    log.write.mode("append").option("header", True).csv(path)


def read_attack_log(spark: SparkSession, path: str) -> DataFrame | None:
    """Missing or empty log -> None. Adds ``ts`` parsed from the text
    timestamp (raw text kept; unparseable -> NULL ``ts``)."""
    df = _read_csv_text(spark, path)
    if df is None:
        return None
    return df.withColumn("ts", parse_ts("timestamp", LOG_TS_FORMATS))


PERF_COLUMNS = {"cpu_percent": "double", "memory_mb": "double", "active_flows": "bigint",
                "attacks_detected": "bigint", "avg_latency_ms": "double"}


def read_perf_log(spark: SparkSession, path: str) -> DataFrame | None:
    """Performance log; numeric text -> numbers (bad text -> NULL)."""
    df = _read_csv_text(spark, path)
    if df is None:
        return None
    for c, t in PERF_COLUMNS.items():
        if c in df.columns:
            df = df.withColumn(c, F.col(c).try_cast(t))
    return df.withColumn("ts", parse_ts("timestamp", LOG_TS_FORMATS))


def read_attack_history(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp | type | target | <n>s | status`` lines; '#' comment
    lines, '---' separators and blank lines are skipped."""
    t = spark.read.text(path)
    v = F.trim(F.col("value"))
    t = t.filter((F.length(v) > 0) & ~v.startswith("#") & ~v.startswith("---"))
    parts = F.split(F.col("value"), r"\|")
    part = lambda i: F.trim(F.element_at(parts, i))
    return t.select(
        parse_ts(part(1), ["yyyy-MM-dd HH:mm:ss"]).alias("ts"),
        part(2).alias("type"),
        part(3).alias("target"),
        F.regexp_replace(part(4), "s$", "").try_cast("bigint").alias("duration_sec"),
        part(5).alias("status"),
    )


def active_flow_counts(spark: SparkSession, dump_dir: str) -> DataFrame:
    """Flow entries per switch dump (non-empty lines minus the header
    line, floored at 0) and, on each row, the total over all switches."""
    t = spark.read.text(dump_dir).withColumn("file", F.input_file_name())
    per = (t.filter(F.length(F.trim("value")) > 0).groupBy("file")
             .agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("flows")))
    # switch name: a ``dpid=N`` folder of a partitioned dump, else the file name
    part_dir = F.regexp_extract("file", r"dpid=([^/]+)/", 1)
    base = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    per = per.withColumn("switch", F.when(part_dir != "", part_dir).otherwise(base))
    per = per.groupBy("switch").agg(F.sum("flows").alias("flows"))
    tot = per.agg(F.sum("flows").alias("total_flows"))
    return per.crossJoin(F.broadcast(tot)).select("switch", "flows", "total_flows")
