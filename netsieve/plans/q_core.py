"""Core slice: flow eligibility, features, destination aggregates, threshold
detection, spoof verdict (F1, P1-P4, A1, J1, A3, M10, M11, J2, P17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.functions.network import attack_type
from netsieve.operators.aggregates import dst_aggregates
from netsieve.operators.detect import fast_path, threshold_detect
from netsieve.operators.features import (
    clamped_features, delta_rate_features, live_features, offline_features)
from netsieve.operators.filters import eligible_flows
from netsieve.operators.joins import spoof_verdict, with_dst_aggregates
from netsieve.plans import derived as D
from netsieve.plans.catalog import register
from netsieve.plans.detection import detect_floods, featurize

ELIGIBLE_SQL = """
SELECT * FROM flows WHERE priority <> 0 AND (src_ip IS NOT NULL OR dst_ip IS NOT NULL)
  AND duration_sec >= 0 AND packet_count >= 0 AND byte_count >= 0
"""
AGG_SQL = """
SELECT poll_ts, dst_ip, count(*) AS flows_to_dst, count(DISTINCT src_ip) AS unique_sources_to_dst
FROM eligible WHERE dpid IN (3, 4, 5) AND dst_ip IS NOT NULL GROUP BY poll_ts, dst_ip
"""
JOINED_SQL = """
SELECT e.*, coalesce(a.flows_to_dst, 0) AS flows_to_dst,
  coalesce(a.unique_sources_to_dst, 0) AS unique_sources_to_dst,
  CASE WHEN e.duration_sec > 0 THEN coalesce(a.flows_to_dst, 0) / e.duration_sec
       ELSE cast(coalesce(a.flows_to_dst, 0) AS double) END AS flow_creation_rate
FROM eligible e LEFT JOIN agg a ON e.poll_ts = a.poll_ts AND e.dst_ip = a.dst_ip
"""
LIVE_SQL = """
SELECT event_id, ts, dpid, src_ip, dst_ip, poll_ts,
  cast(duration_sec AS double) AS flow_duration_sec, packet_count, byte_count,
  CASE WHEN duration_sec > 0 THEN packet_count / duration_sec ELSE 0.0 END AS packet_count_per_second,
  CASE WHEN duration_sec > 0 THEN byte_count / duration_sec ELSE 0.0 END AS byte_count_per_second,
  CASE WHEN packet_count > 0 THEN byte_count / packet_count ELSE 0.0 END AS avg_packet_size,
  ip_proto, icmp_code, icmp_type, flows_to_dst, unique_sources_to_dst, flow_creation_rate,
  packet_count / greatest(cast(duration_sec AS double), 0.001) AS pps,
  byte_count / greatest(cast(duration_sec AS double), 0.001) AS bps
FROM joined
"""
DETECT_SQL = """
SELECT *, (pps > 10000 OR bps > 50000000) AS is_attack,
  CASE WHEN pps > 10000 OR bps > 50000000 THEN 0.5 ELSE 0.1 END AS attack_prob
FROM live
"""


def _views(min_sources=10, min_flows=15):
    return {"eligible": ELIGIBLE_SQL, "agg": AGG_SQL, "joined": JOINED_SQL, "live": LIVE_SQL,
            "scored": DETECT_SQL}


def _features_sql(name: str, pps: str, bps: str, avg: str) -> str:
    return D.with_views(f"""
SELECT event_id, cast(duration_sec AS double) AS flow_duration_sec, packet_count, byte_count,
  {pps} AS packet_count_per_second, {bps} AS byte_count_per_second, {avg} AS avg_packet_size,
  ip_proto, icmp_code, icmp_type, cast(0 AS bigint) AS flows_to_dst,
  cast(0 AS bigint) AS unique_sources_to_dst, 0.0 AS flow_creation_rate
FROM eligible""", "flows", extra={"eligible": ELIGIBLE_SQL})


def _elig(spark, sf):
    return eligible_flows(D.flows(spark, sf))


@register("f1_eligible_flows", D.with_views(ELIGIBLE_SQL, "flows"))
def f1_eligible_flows(spark, sf):
    return _elig(spark, sf)


@register("p1_offline_features", _features_sql(
    "p1", "CASE WHEN duration_sec > 0 THEN packet_count / duration_sec ELSE cast(packet_count AS double) END",
    "CASE WHEN duration_sec > 0 THEN byte_count / duration_sec ELSE cast(byte_count AS double) END",
    "CASE WHEN packet_count > 0 THEN byte_count / packet_count ELSE 0.0 END"))
def p1_offline_features(spark, sf):
    return offline_features(_elig(spark, sf), keep=["event_id"])


@register("p2_live_features", _features_sql(
    "p2", "CASE WHEN duration_sec > 0 THEN packet_count / duration_sec ELSE 0.0 END",
    "CASE WHEN duration_sec > 0 THEN byte_count / duration_sec ELSE 0.0 END",
    "CASE WHEN packet_count > 0 THEN byte_count / packet_count ELSE 0.0 END"))
def p2_live_features(spark, sf):
    return live_features(_elig(spark, sf), keep=["event_id"])


@register("p4_clamped_features", _features_sql(
    "p4", "packet_count / greatest(cast(duration_sec AS double), 0.001)",
    "byte_count / greatest(cast(duration_sec AS double), 0.001)",
    "byte_count / greatest(packet_count, 1)"))
def p4_clamped_features(spark, sf):
    return clamped_features(_elig(spark, sf), keep=["event_id"])


FLOW_KEY = ["dpid", "src_ip", "dst_ip", "ip_proto"]


@register("p3_delta_rate_features", D.with_views("""
SELECT event_id, cast(duration_sec AS double) AS flow_duration_sec, packet_count, byte_count,
  CASE WHEN prev_p IS NOT NULL THEN greatest(0, packet_count - prev_p) / 5.0
       WHEN duration_sec > 0 THEN packet_count / duration_sec ELSE 0.0 END AS packet_count_per_second,
  CASE WHEN prev_p IS NOT NULL THEN greatest(0, byte_count - prev_b) / 5.0
       WHEN duration_sec > 0 THEN byte_count / duration_sec ELSE 0.0 END AS byte_count_per_second,
  CASE WHEN packet_count > 0 THEN byte_count / packet_count ELSE 0.0 END AS avg_packet_size,
  ip_proto, icmp_code, icmp_type, cast(0 AS bigint) AS flows_to_dst,
  cast(0 AS bigint) AS unique_sources_to_dst, 0.0 AS flow_creation_rate
FROM (SELECT *, lag(packet_count) OVER w AS prev_p, lag(byte_count) OVER w AS prev_b FROM eligible
      WINDOW w AS (PARTITION BY dpid, src_ip, dst_ip, ip_proto ORDER BY ts, event_id)) x
""", "flows", extra={"eligible": ELIGIBLE_SQL}))
def p3_delta_rate_features(spark, sf):
    return delta_rate_features(_elig(spark, sf), FLOW_KEY, ["ts", "event_id"], 5.0,
                               keep=["event_id"])


@register("a1_dst_aggregates", D.with_views("SELECT * FROM agg", "flows",
                                            extra={"eligible": ELIGIBLE_SQL, "agg": AGG_SQL}))
def a1_dst_aggregates(spark, sf):
    return dst_aggregates(_elig(spark, sf), "poll_ts")


@register("j1_with_dst_aggregates", D.with_views(
    "SELECT event_id, poll_ts, dst_ip, flows_to_dst, unique_sources_to_dst, flow_creation_rate FROM joined",
    "flows", extra={"eligible": ELIGIBLE_SQL, "agg": AGG_SQL, "joined": JOINED_SQL}))
def j1_with_dst_aggregates(spark, sf):
    e = _elig(spark, sf)
    return with_dst_aggregates(e, dst_aggregates(e, "poll_ts"), "poll_ts").select(
        "event_id", "poll_ts", "dst_ip", "flows_to_dst", "unique_sources_to_dst",
        "flow_creation_rate")


@register("m10_threshold_detect", D.with_views("""
SELECT event_id, packet_count_per_second, byte_count_per_second,
  (packet_count_per_second > 10000 OR byte_count_per_second > 50000000) AS is_attack,
  CASE WHEN packet_count_per_second > 10000 OR byte_count_per_second > 50000000 THEN 0.5 ELSE 0.1 END AS attack_prob
FROM (SELECT event_id, packet_count / greatest(cast(duration_sec AS double), 0.001) AS packet_count_per_second,
        byte_count / greatest(cast(duration_sec AS double), 0.001) AS byte_count_per_second FROM eligible) c""",
    "flows", extra={"eligible": ELIGIBLE_SQL}))
def m10_threshold_detect(spark, sf):
    """M10 on the clamped raw rates (P4): the unscaled values Q6 calls for."""
    return threshold_detect(clamped_features(_elig(spark, sf), keep=["event_id"])).select(
        "event_id", "packet_count_per_second", "byte_count_per_second", "is_attack", "attack_prob")


@register("m11_fast_path", D.with_views(
    "SELECT event_id, is_attack AS caught FROM scored", "flows", extra=_views()))
def m11_fast_path(spark, sf):
    f = featurize(D.flows(spark, sf), "poll_ts")
    rated = f.withColumns({"packet_count_per_second": F.col("pps"), "byte_count_per_second": F.col("bps")})
    return fast_path(rated).select("event_id", "caught")


def _detect_sql(min_sources: int, min_flows: int) -> str:
    return D.with_views(f"""
SELECT event_id, ts, dpid, src_ip, dst_ip, poll_ts, ip_proto,
  CASE ip_proto WHEN 1 THEN 'ICMP Flood' WHEN 6 THEN 'SYN Flood' WHEN 17 THEN 'UDP Flood'
       ELSE concat('Unknown (proto=', cast(ip_proto AS varchar), ')') END AS attack_type,
  pps, flows_to_dst, unique_sources_to_dst,
  (unique_sources_to_dst >= {min_sources} AND flows_to_dst >= {min_flows}) AS is_spoofed,
  CASE WHEN unique_sources_to_dst >= {min_sources} AND flows_to_dst >= {min_flows} THEN 'dst' ELSE 'src' END AS block_scope,
  CASE WHEN unique_sources_to_dst >= {min_sources} AND flows_to_dst >= {min_flows} THEN '*' ELSE src_ip END AS block_src
FROM scored WHERE is_attack AND src_ip IS NOT NULL
""", "flows", extra=_views())


@register("j2_spoof_verdict", _detect_sql(10, 15))
def j2_spoof_verdict(spark, sf):
    return detect_floods(D.flows(spark, sf), "poll_ts", min_sources=10, min_flows=15)


@register("flagship_detect_floods", _detect_sql(3, 5))
def flagship_detect_floods(spark, sf):
    """Minimum slice with the spoof limits lowered (small tables hold few flows per group)."""
    return detect_floods(D.flows(spark, sf), "poll_ts", min_sources=3, min_flows=5)


@register("p17_attack_type", D.with_views("""
SELECT ip_proto, CASE ip_proto WHEN 1 THEN 'ICMP Flood' WHEN 6 THEN 'SYN Flood' WHEN 17 THEN 'UDP Flood'
       ELSE concat('Unknown (proto=', cast(ip_proto AS varchar), ')') END AS attack_type, count(*) AS flows
FROM flows GROUP BY ip_proto""", "flows"))
def p17_attack_type(spark, sf):
    return (D.flows(spark, sf).groupBy("ip_proto").agg(F.count(F.lit(1)).alias("flows"))
              .withColumn("attack_type", attack_type("ip_proto")))


@register("j2_spoof_verdict_joined", D.with_views("""
SELECT s.event_id, (coalesce(a.unique_sources_to_dst, 0) >= 10 AND coalesce(a.flows_to_dst, 0) >= 15) AS is_spoofed
FROM scored s LEFT JOIN agg a ON s.poll_ts = a.poll_ts AND s.dst_ip = a.dst_ip
WHERE s.is_attack AND s.src_ip IS NOT NULL""", "flows", extra=_views()))
def j2_spoof_verdict_joined(spark, sf):
    """J2 in its join form: detections meet the aggregates table directly."""
    e = _elig(spark, sf)
    agg = dst_aggregates(e, "poll_ts")
    det = threshold_detect(clamped_features(e, keep=["event_id", "poll_ts", "src_ip", "dst_ip"]))
    det = det.filter(F.col("is_attack") & F.col("src_ip").isNotNull())
    return spoof_verdict(det, agg, "poll_ts").select("event_id", "is_spoofed")


@register("p6_features_to_map")
def p6_features_to_map(spark, sf):
    """The 12 live features of each eligible flow as a name -> value map
    and as the model's dense vector (rows-only: map/vector columns)."""
    from netsieve.operators.features import assemble, features_to_map
    f = live_features(_elig(spark, sf), keep=["event_id"])
    return assemble(features_to_map(f)).select("event_id", "features", "features_vec")
