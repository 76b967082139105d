"""Window / time-series queries (W1-W9, L2, P22) over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.operators.features import estimate_latency
from netsieve.operators.filters import eligible_flows
from netsieve.operators.windows import (
    arrival_rate, port_security, previous_snapshot, priority_sample, ranking, rate_of_change,
    table_state, timeline, ttl_counter, zscore_drift)
from netsieve.plans import derived as D
from netsieve.plans.catalog import register
from netsieve.plans.q_core import ELIGIBLE_SQL

EL = {"eligible": ELIGIBLE_SQL}
FLOW_W = "PARTITION BY dpid, src_ip, dst_ip, ip_proto ORDER BY ts, event_id"


@register("w1_rate_of_change", D.with_views(f"""
SELECT event_id,
  CASE WHEN live THEN pps_now - pp ELSE 0.0 END AS pps_delta,
  CASE WHEN live THEN bps_now - pb ELSE 0.0 END AS bps_delta,
  CASE WHEN live THEN (pps_now - pp) / greatest(0.001, dt) ELSE 0.0 END AS pps_acceleration
FROM (SELECT *, pt IS NOT NULL AND dt < 300 AS live FROM (
  SELECT *, (epoch_us(ts) - epoch_us(pt)) / 1e6 AS dt FROM (
    SELECT event_id, ts, pps_now, bps_now, lag(pps_now) OVER w AS pp, lag(bps_now) OVER w AS pb,
      lag(ts) OVER w AS pt
    FROM (SELECT *, packet_count / greatest(cast(duration_sec AS double), 0.001) AS pps_now,
            byte_count / greatest(cast(duration_sec AS double), 0.001) AS bps_now FROM eligible) a
    WINDOW w AS ({FLOW_W})) b) c) d
""", "flows", extra=EL))
def w1_rate_of_change(spark, sf):
    return rate_of_change(eligible_flows(D.flows(spark, sf))).select(
        "event_id", "pps_delta", "bps_delta", "pps_acceleration")


@register("w2_arrival_rate", D.with_views("""
SELECT event_id, coalesce(avg(r) OVER (PARTITION BY dst_ip ORDER BY ts, event_id
                                      ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.0) AS flow_creation_rate
FROM (SELECT *, CASE WHEN pt IS NOT NULL THEN 1.0 / greatest((epoch_us(ts) - epoch_us(pt)) / 1e6, 0.001) END AS r
      FROM (SELECT *, lag(ts) OVER (PARTITION BY dst_ip ORDER BY ts, event_id) AS pt
            FROM flows WHERE dst_ip IS NOT NULL) y) x
""", "flows"))
def w2_arrival_rate(spark, sf):
    return arrival_rate(D.flows(spark, sf)).select("event_id", "flow_creation_rate")


@register("w3_priority_sample", D.with_views("""
SELECT event_id, poll_ts, sample_pps FROM (
  SELECT event_id, poll_ts, sample_pps,
    row_number() OVER (PARTITION BY poll_ts ORDER BY sample_pps DESC, event_id) AS rn,
    count(*) OVER (PARTITION BY poll_ts) AS n
  FROM (SELECT *, packet_count / greatest(cast(duration_sec AS double), 0.001) AS sample_pps FROM eligible) a) b
WHERE n <= 50 OR rn <= 50 OR sample_pps >= 100
""", "flows", extra=EL))
def w3_priority_sample(spark, sf):
    return priority_sample(eligible_flows(D.flows(spark, sf)), "poll_ts", n=50,
                           pps_threshold=100.0).select("event_id", "poll_ts", "sample_pps")


@register("w4_port_security", D.with_views("""
SELECT a.event_id, a.dpid, a.in_port, a.eth_src, m.eth_src IS NULL AS port_violation
FROM arrivals a LEFT JOIN (
  SELECT dpid, in_port, eth_src FROM (
    SELECT dpid, in_port, eth_src,
      row_number() OVER (PARTITION BY dpid, in_port ORDER BY ft, fid) AS r
    FROM (SELECT dpid, in_port, eth_src, min(ts) AS ft, arg_min(event_id, ts) AS fid
          FROM arrivals GROUP BY dpid, in_port, eth_src) f) g WHERE r <= 5) m
ON a.dpid = m.dpid AND a.in_port = m.in_port AND a.eth_src = m.eth_src
""", "arrivals"))
def w4_port_security(spark, sf):
    return port_security(D.arrivals(spark, sf), 5).select(
        "event_id", "dpid", "in_port", "eth_src", "port_violation")


@register("w5_zscore_drift", D.with_views("""
SELECT event_id, drift, cast(sum(cast(drift AS int)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS bigint) AS drift_count
FROM (SELECT event_id, ts, event_type,
  coalesce(count(value) OVER w >= 100 AND stddev_pop(value) OVER w > 0
           AND value > avg(value) OVER w + 3 * stddev_pop(value) OVER w, false) AS drift
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
                           ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)) x
"""))
def w5_zscore_drift(spark, sf):
    e = D.read_table(spark, sf, "events")
    return zscore_drift(e, "event_type", "value").select(
        "event_id", "drift", F.col("drift_count").cast("bigint").alias("drift_count"))


def _drift_scaled_sql(scale: str) -> str:
    return f"""
SELECT event_id, coalesce(count(x) OVER w >= 100 AND max(x) OVER w > min(x) OVER w
           AND x > avg(x) OVER w + 3 * stddev_pop(x) OVER w, false) AS drift
FROM (SELECT event_id, ts, event_type, cast(value AS double) * {scale} AS x FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)"""


def _register_drift_scaled(name: str, scale: str):
    @register(f"w5_zscore_drift_{name}", D.with_views(_drift_scaled_sql(scale)))
    def q(spark, sf):
        """W5 on values of another size: probabilities, errors, large counts."""
        e = D.read_table(spark, sf, "events").withColumn("x", F.col("value").cast("double") * float(scale))
        return zscore_drift(e, "event_type", "x").select("event_id", "drift")


for _name, _scale in (("milli", "1e-3"), ("micro", "1e-6"), ("peta", "1e15")):
    _register_drift_scaled(_name, _scale)


@register("w6_previous_snapshot", D.with_views(f"""
SELECT event_id, lag(event_id) OVER w AS prev_event_id, lag(packet_count) OVER w AS prev_packet_count
FROM eligible WINDOW w AS ({FLOW_W})
""", "flows", extra=EL))
def w6_previous_snapshot(spark, sf):
    x = previous_snapshot(eligible_flows(D.flows(spark, sf)), ["dpid", "src_ip", "dst_ip", "ip_proto"],
                          cols=["event_id", "packet_count"])
    return x.select("event_id", F.col("prev.event_id").alias("prev_event_id"),
                    F.col("prev.packet_count").alias("prev_packet_count"))


@register("w7_ttl_counter", D.with_views("""
SELECT event_id, session, row_number() OVER (PARTITION BY dpid, session ORDER BY ts, event_id) AS counter
FROM (SELECT *, cast(sum(reset) OVER (PARTITION BY dpid ORDER BY ts, event_id) AS bigint) AS session FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 >= 300
                 THEN 1 ELSE 0 END AS reset
  FROM flows WINDOW w AS (PARTITION BY dpid ORDER BY ts, event_id)) a) b
""", "flows"))
def w7_ttl_counter(spark, sf):
    x = ttl_counter(D.flows(spark, sf), ["dpid"], ttl_sec=300.0)
    return x.select("event_id", F.col("session").cast("bigint").alias("session"), "counter")


@register("w8_timeline_hour", """
WITH b AS (SELECT date_trunc('hour', ts) AS bin FROM events),
r AS (SELECT min(bin) AS lo, max(bin) AS hi FROM b),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS bin FROM r),
c AS (SELECT bin, count(*) AS events FROM b GROUP BY bin)
SELECT s.bin, coalesce(c.events, 0) AS events FROM s LEFT JOIN c ON s.bin = c.bin
""")
def w8_timeline_hour(spark, sf):
    return timeline(D.read_table(spark, sf, "events"), "hour")


@register("w8_timeline_minute", """
WITH b AS (SELECT date_trunc('minute', ts) AS bin FROM events),
r AS (SELECT min(bin) AS lo, max(bin) AS hi FROM b),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS bin FROM r),
c AS (SELECT bin, count(*) AS events FROM b GROUP BY bin)
SELECT s.bin, coalesce(c.events, 0) AS events FROM s LEFT JOIN c ON s.bin = c.bin
""")
def w8_timeline_minute(spark, sf):
    return timeline(D.read_table(spark, sf, "events"), "minute")


AT = "2024-01-15 12:00:00"


@register("w9_table_state", D.with_views(f"""
SELECT dpid, eth_src, arg_max(in_port, ts) AS port, max(ts) AS learnt_ts,
  (epoch_us(TIMESTAMP '{AT}') - epoch_us(max(ts))) / 1e6 AS age_sec,
  (epoch_us(TIMESTAMP '{AT}') - epoch_us(max(ts))) / 1e6 > 300 AS evicted
FROM arrivals WHERE ts <= TIMESTAMP '{AT}' GROUP BY dpid, eth_src
""", "arrivals"))
def w9_table_state(spark, sf):
    return table_state(D.arrivals(spark, sf), F.lit(AT).cast("timestamp_ntz"), 300.0)


@register("l2_source_ranking", D.with_views("""
SELECT src_ip, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, src_ip ASC NULLS FIRST) AS rank
FROM flows GROUP BY src_ip
""", "flows"))
def l2_source_ranking(spark, sf):
    return ranking(D.flows(spark, sf), "src_ip")


@register("p22_estimate_latency", D.with_views("""
SELECT event_id, CASE WHEN lag(attacks_detected) OVER w IS NOT NULL AND attacks_detected > lag(attacks_detected) OVER w
                      THEN 2650.0 ELSE 5000.0 END AS est_latency_ms
FROM perf WINDOW w AS (PARTITION BY monitor_id ORDER BY ts, event_id)
""", "perf"))
def p22_estimate_latency(spark, sf):
    return estimate_latency(D.perf_samples(spark, sf), "monitor_id", ["ts", "event_id"]).select(
        "event_id", "est_latency_ms")
