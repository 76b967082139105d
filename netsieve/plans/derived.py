"""Network-shaped views derived from the driver tables.

The driver tables carry no network flows, so flow statistics, switch arrival
events and monitor samples are derived from ``events``. Each view exists twice:
as DataFrame code (what runs on Spark) and as SQL text that the DuckDB oracle
puts in front of every check. Both give identical values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> F.Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


# --- flows (D3) --------------------------------------------------------------

FLOWS_SQL = """
SELECT event_id, ts, date_trunc('day', ts) AS poll_ts,
  cast(1 + user_id % 5 AS int) AS dpid,
  cast(event_id % 11 AS int) AS priority,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('10.1.',
       cast(cast(floor(user_id / 50) AS int) AS string), '.', cast(user_id % 50 + 1 AS string)) END AS src_ip,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('10.0.0.', cast(k % 10 + 1 AS string)) END AS dst_ip,
  CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 6 WHEN 'purchase' THEN 6 WHEN 'view' THEN 17 ELSE 47 END AS ip_proto,
  0 AS icmp_code, CASE WHEN event_type = 'error' THEN 8 ELSE 0 END AS icmp_type,
  cast(k % 30 AS bigint) AS duration_sec,
  cast(floor(value * 20) AS bigint) AS packet_count,
  cast(floor(value * 20) AS bigint) * (40 + k * 10) AS byte_count
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events) e
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-stat rows (D3 plus event_id/ts): one per event; the poll is the calendar day."""
    e = read_table(spark, sf_dir, "events").withColumn("k", _k())
    uid, eid, k = F.col("user_id"), F.col("event_id"), F.col("k")
    pkts = F.floor(F.col("value") * 20).cast("bigint")
    return e.select(
        "event_id",
        "ts",
        F.date_trunc("day", "ts").alias("poll_ts"),
        (1 + uid % 5).cast("int").alias("dpid"),
        (eid % 11).cast("int").alias("priority"),
        F.when(eid % 97 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("10.1."), F.floor(uid / 50).cast("int").cast("string"),
                     F.lit("."), (uid % 50 + 1).cast("string"))).alias("src_ip"),
        F.when(eid % 89 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("10.0.0."), (k % 10 + 1).cast("string"))).alias("dst_ip"),
        F.when(F.col("event_type") == "error", 1)
         .when(F.col("event_type").isin("click", "purchase"), 6)
         .when(F.col("event_type") == "view", 17).otherwise(47).cast("int").alias("ip_proto"),
        F.lit(0).cast("int").alias("icmp_code"),
        F.when(F.col("event_type") == "error", 8).otherwise(0).cast("int").alias("icmp_type"),
        (k % 30).cast("bigint").alias("duration_sec"),
        pkts.alias("packet_count"),
        (pkts * (40 + k * 10)).alias("byte_count"),
    )


# --- switch arrival events (D11) --------------------------------------------
# One packet-in per event: switch and port from the user, source MAC from the
# user, destination MAC = the host MAC of user k (broadcast for sign-ups), ethertype from the
# event type (error -> link discovery 0x88cc, signup -> ARP, else IPv4).

ARRIVALS_SQL = """
SELECT event_id, ts,
  cast(1 + user_id % 5 AS int) AS dpid,
  cast(1 + floor(user_id / 5) % 4 AS int) AS in_port,
  concat('02:00:00:00:', lpad(cast(cast(floor(user_id / 100) AS int) AS string), 2, '0'), ':',
         lpad(cast(user_id % 100 AS string), 2, '0')) AS eth_src,
  CASE WHEN event_type = 'signup' THEN 'ff:ff:ff:ff:ff:ff'
       ELSE concat('02:00:00:00:00:', lpad(cast(k AS string), 2, '0')) END AS eth_dst,
  CASE event_type WHEN 'error' THEN 35020 WHEN 'signup' THEN 2054 ELSE 2048 END AS ethertype,
  concat('10.1.', cast(cast(floor(user_id / 50) AS int) AS string), '.', cast(user_id % 50 + 1 AS string)) AS src_ip
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events) e
"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("k", _k())
    uid, k, et = F.col("user_id"), F.col("k"), F.col("event_type")
    return e.select(
        "event_id",
        "ts",
        (1 + uid % 5).cast("int").alias("dpid"),
        (1 + F.floor(uid / 5) % 4).cast("int").alias("in_port"),
        F.concat(F.lit("02:00:00:00:"),
                 F.lpad(F.floor(uid / 100).cast("int").cast("string"), 2, "0"), F.lit(":"),
                 F.lpad((uid % 100).cast("string"), 2, "0")).alias("eth_src"),
        F.when(et == "signup", F.lit("ff:ff:ff:ff:ff:ff")).otherwise(
            F.concat(F.lit("02:00:00:00:00:"), F.lpad(k.cast("string"), 2, "0"))).alias("eth_dst"),
        F.when(et == "error", 35020).when(et == "signup", 2054).otherwise(2048).cast("int").alias("ethertype"),
        F.concat(F.lit("10.1."), F.floor(uid / 50).cast("int").cast("string"),
                 F.lit("."), (uid % 50 + 1).cast("string")).alias("src_ip"),
    )


# --- monitor samples (D9) ----------------------------------------------------
# One performance sample per event; attacks_detected is a cumulative counter
# (monotone in event_id), as the monitor writes it.

PERF_SQL = """
SELECT event_id, ts,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
  round(value % 100, 2) AS cpu_percent,
  round(200 + value * 2, 2) AS memory_mb,
  cast(k * 10 AS bigint) AS active_flows,
  cast(floor(event_id / 40) AS bigint) AS attacks_detected,
  round(value * 3, 2) AS avg_latency_ms,
  cast(user_id % 3 AS int) AS monitor_id
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events) e
"""


def perf_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("k", _k())
    v = F.col("value")
    return e.select(
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.round(v % 100, 2).alias("cpu_percent"),
        F.round(200 + v * 2, 2).alias("memory_mb"),
        (F.col("k") * 10).cast("bigint").alias("active_flows"),
        F.floor(F.col("event_id") / 40).cast("bigint").alias("attacks_detected"),
        F.round(v * 3, 2).alias("avg_latency_ms"),
        (F.col("user_id") % 3).cast("int").alias("monitor_id"),
    )


VIEW_SQL = {"flows": FLOWS_SQL, "arrivals": ARRIVALS_SQL, "perf": PERF_SQL}


def with_views(sql: str, *names: str, extra: dict | None = None) -> str:
    """Prefix ``sql`` with the derived views it reads, as CTEs (oracle side)."""
    ctes = [f"{n} AS ({VIEW_SQL[n].strip()})" for n in names]
    for n, body in (extra or {}).items():
        ctes.append(f"{n} AS ({body.strip()})")
    if not ctes:
        return sql.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + sql.strip()
