"""Log analytics queries (S6, S7, S11, S16, S17, A4-A8, A19, L1, W8) on logs
derived from the driver tables: the attack log is what the detection slice
writes, the performance log one monitor sample per event."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from netsieve.operators.aggregates import (
    attack_counts, attack_summary, history_summary, monitor_summary, perf_summary, rate_stats)
from netsieve.operators.windows import timeline, top_sources
from netsieve.plans import derived as D
from netsieve.plans.catalog import register
from netsieve.plans.detection import detect_floods
from netsieve.plans.q_core import _detect_sql
from netsieve.session import checkpoint_dir
from netsieve.sources.logs import (
    active_flow_counts, attack_log, read_attack_history, read_attack_log, read_perf_log,
    write_attack_log)

N_SWITCHES = 5


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def derived_attack_log(spark, sf):
    det = detect_floods(D.flows(spark, sf), "poll_ts")
    return attack_log(det, N_SWITCHES)


_DET = _detect_sql(10, 15)
ATTACKLOG_SQL = """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
  CASE WHEN regexp_matches(src_ip, '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') THEN src_ip ELSE 'INVALID' END AS src_ip,
  CASE WHEN dst_ip IS NOT NULL AND regexp_matches(dst_ip, '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') THEN dst_ip ELSE 'INVALID' END AS dst_ip,
  attack_type, printf('%.2f', pps) AS packet_rate, '0.500' AS confidence, 'BLOCKED' AS action,
  5 AS switches_blocked, ts
FROM detections
"""


def _with_log(sql: str) -> str:
    """Oracle text: detection CTEs, then the attack-log CTE, then ``sql``."""
    head, tail = _DET.split("\nSELECT event_id, ts, dpid", 1)
    det_body = "SELECT event_id, ts, dpid" + tail
    return (head + ",\ndetections AS (" + det_body + "),\nattacklog AS (" + ATTACKLOG_SQL + ")\n"
            + sql.strip())


@register("s11_attack_log", _with_log(
    "SELECT timestamp, src_ip, dst_ip, attack_type, packet_rate, confidence, action, switches_blocked FROM attacklog"))
def s11_attack_log(spark, sf):
    return derived_attack_log(spark, sf)


@register("s6_read_attack_log", _with_log("""
SELECT timestamp, src_ip, dst_ip, attack_type, packet_rate, confidence, action,
  cast(switches_blocked AS varchar) AS switches_blocked, ts FROM attacklog"""))
def s6_read_attack_log(spark, sf):
    """S11 sink then S6 source: write the derived log as CSV, read it back."""
    path = _scratch(spark, "attack-log")
    write_attack_log(derived_attack_log(spark, sf), path)
    return read_attack_log(spark, path)


def _log_with_ts(spark, sf):
    return derived_attack_log(spark, sf).withColumn(
        "ts", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


@register("a4_attack_summary", _with_log("""
SELECT count(*) AS total, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_attack,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_attack,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) AS duration_sec,
  count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations
FROM attacklog"""))
def a4_attack_summary(spark, sf):
    return attack_summary(_log_with_ts(spark, sf))


@register("a5_attack_counts", _with_log("""
SELECT dimension, value, count, round(count * 100.0 / (SELECT count(*) FROM attacklog), 1) AS percent FROM (
  SELECT 'attack_type' AS dimension, attack_type AS value, count(*) AS count FROM attacklog GROUP BY attack_type
  UNION ALL SELECT 'src_ip', src_ip, count(*) FROM attacklog GROUP BY src_ip
  UNION ALL SELECT 'dst_ip', dst_ip, count(*) FROM attacklog GROUP BY dst_ip
  UNION ALL SELECT 'switch', cast(switches_blocked AS varchar), count(*) FROM attacklog GROUP BY switches_blocked
  UNION ALL SELECT 'action', action, count(*) FROM attacklog GROUP BY action) g"""))
def a5_attack_counts(spark, sf):
    return attack_counts(derived_attack_log(spark, sf))


@register("a6_rate_stats", _with_log("""
SELECT coalesce(round(avg(r), 2), 0.0) AS avg_packet_rate, coalesce(round(max(r), 2), 0.0) AS max_packet_rate,
  coalesce(round(min(r), 2), 0.0) AS min_packet_rate
FROM (SELECT try_cast(packet_rate AS double) AS r FROM attacklog) x"""))
def a6_rate_stats(spark, sf):
    return rate_stats(derived_attack_log(spark, sf))


@register("l1_top_sources", _with_log("""
SELECT src_ip, count(*) AS count FROM attacklog GROUP BY src_ip ORDER BY count DESC, src_ip LIMIT 10"""))
def l1_top_sources(spark, sf):
    return top_sources(derived_attack_log(spark, sf), "src_ip", 10)


@register("w8_attack_timeline", _with_log("""
SELECT s.bin, coalesce(c.events, 0) AS events FROM
  (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS bin
   FROM attacklog) s
  LEFT JOIN (SELECT date_trunc('hour', ts) AS bin, count(*) AS events FROM attacklog GROUP BY 1) c ON s.bin = c.bin"""))
def w8_attack_timeline(spark, sf):
    return timeline(_log_with_ts(spark, sf), "hour")


PERF_OUT = ["timestamp", "cpu_percent", "memory_mb", "active_flows", "attacks_detected", "avg_latency_ms"]


@register("s7_read_perf_log", D.with_views("""
SELECT timestamp, cpu_percent, memory_mb, active_flows, attacks_detected, avg_latency_ms,
  date_trunc('second', ts) AS ts FROM perf
""", "perf"))
def s7_read_perf_log(spark, sf):
    """Write the monitor samples as the monitor's CSV, read them back."""
    path = _scratch(spark, "perf-log")
    D.perf_samples(spark, sf).select(*PERF_OUT).write.option("header", True).csv(path)
    return read_perf_log(spark, path)


@register("a7_perf_summary", D.with_views("""
SELECT round(avg(cpu_percent), 2) AS avg_cpu, round(max(cpu_percent), 2) AS peak_cpu,
  round(min(cpu_percent), 2) AS min_cpu, round(avg(memory_mb), 2) AS avg_memory,
  round(max(memory_mb), 2) AS peak_memory, round(avg(active_flows), 1) AS avg_flows,
  max(active_flows) AS peak_flows, round(avg(avg_latency_ms), 2) AS avg_latency,
  round(max(avg_latency_ms), 2) AS peak_latency, cast(sum(attacks_detected) AS bigint) AS sum_attacks,
  max(attacks_detected) - min(attacks_detected) AS attacks_span, count(*) AS total_records
FROM perf""", "perf"))
def a7_perf_summary(spark, sf):
    return perf_summary(D.perf_samples(spark, sf))


@register("a8_monitor_summary", D.with_views("""
SELECT monitor_id,
  round(avg(cpu_percent), 2) AS avg_cpu_percent, round(max(cpu_percent), 2) AS peak_cpu_percent,
  round(min(cpu_percent), 2) AS min_cpu_percent,
  round(avg(memory_mb), 2) AS avg_memory_mb, round(max(memory_mb), 2) AS peak_memory_mb,
  round(min(memory_mb), 2) AS min_memory_mb,
  round(avg(active_flows), 2) AS avg_active_flows, cast(max(active_flows) AS double) AS peak_active_flows,
  cast(min(active_flows) AS double) AS min_active_flows,
  round(avg(avg_latency_ms), 2) AS avg_avg_latency_ms, round(max(avg_latency_ms), 2) AS peak_avg_latency_ms,
  round(min(avg_latency_ms), 2) AS min_avg_latency_ms,
  max(attacks_detected) AS attacks_max, max(attacks_detected) - min(attacks_detected) AS attacks_in_session,
  min(ts) AS first_sample, max(ts) AS last_sample, count(*) AS samples
FROM perf GROUP BY monitor_id""", "perf"))
def a8_monitor_summary(spark, sf):
    return monitor_summary(D.perf_samples(spark, sf), "monitor_id")


HISTORY_SQL = """
SELECT ts2 AS ts, attack_type AS type, dst_ip AS target, duration_sec, status FROM (
  SELECT date_trunc('second', ts) AS ts2,
    CASE ip_proto WHEN 1 THEN 'icmp_flood' WHEN 6 THEN 'syn_flood' WHEN 17 THEN 'udp_flood' ELSE 'mixed' END AS attack_type,
    coalesce(dst_ip, '10.0.0.1') AS dst_ip, duration_sec,
    CASE WHEN priority = 0 THEN 'failed' ELSE 'completed' END AS status
  FROM flows) h
"""


def _history_lines(spark, sf):
    f = D.flows(spark, sf)
    typ = (F.when(F.col("ip_proto") == 1, "icmp_flood").when(F.col("ip_proto") == 6, "syn_flood")
            .when(F.col("ip_proto") == 17, "udp_flood").otherwise("mixed"))
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), typ,
                       F.coalesce("dst_ip", F.lit("10.0.0.1")),
                       F.concat(F.col("duration_sec").cast("string"), F.lit("s")),
                       F.when(F.col("priority") == 0, "failed").otherwise("completed"))
    header = f.sparkSession.createDataFrame(
        [("# DDoS Attack History Log",), ("# Format: timestamp | type | target | duration | status",),
         ("---",)], "value STRING")
    return header.unionByName(f.select(line.alias("value")))


@register("s16_read_attack_history", D.with_views(HISTORY_SQL, "flows"))
def s16_read_attack_history(spark, sf):
    path = _scratch(spark, "history")
    _history_lines(spark, sf).write.text(path)
    return read_attack_history(spark, path)


@register("a19_history_summary", D.with_views(
    "SELECT type, status, count(*) AS runs, cast(sum(duration_sec) AS bigint) AS total_sec FROM history GROUP BY type, status",
    "flows", extra={"history": HISTORY_SQL}))
def a19_history_summary(spark, sf):
    path = _scratch(spark, "history")
    _history_lines(spark, sf).write.text(path)
    return history_summary(read_attack_history(spark, path))


@register("s17_active_flow_counts", D.with_views("""
SELECT cast(dpid AS varchar) AS switch, count(*) AS flows, cast(sum(count(*)) OVER () AS bigint) AS total_flows
FROM eligible GROUP BY dpid""",
    "flows", extra={"eligible": __import__("netsieve.plans.q_core", fromlist=["x"]).ELIGIBLE_SQL}))
def s17_active_flow_counts(spark, sf):
    """Switch dumps derived from the eligible flows: one text file per switch,
    a header line then one line per flow entry; S17 counts them back."""
    from netsieve.operators.filters import eligible_flows
    f = eligible_flows(D.flows(spark, sf))
    lines = f.select("dpid", F.concat_ws(", ", F.lit("cookie=0x0"), F.concat(F.lit("priority="), F.col("priority").cast("string")),
                                         F.concat(F.lit("nw_dst="), F.coalesce("dst_ip", F.lit("*")))).alias("value"))
    hdr = f.select("dpid").distinct().select("dpid", F.lit("NXST_FLOW reply (xid=0x4):").alias("value"))
    path = _scratch(spark, "dumps")
    hdr.unionByName(lines).repartition("dpid").write.partitionBy("dpid").text(path)
    return active_flow_counts(spark, path)
