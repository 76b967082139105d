"""Join queries (J3-J8, F2, F4, S9/S10, A13-A15) on derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.operators.aggregates import eviction_candidates, health, table_usage
from netsieve.operators.filters import active_blocks, classify_frames, eligible_flows
from netsieve.operators.joins import (
    allowed_sources_df, antispoof, asof_lookup, drop_rules, suppressed_by, unblock)
from netsieve.operators.stateful import block_episodes
from netsieve.plans import derived as D
from netsieve.plans.catalog import register
from netsieve.plans.q_core import ELIGIBLE_SQL
from netsieve.plans.q_logs import _scratch
from netsieve.plans.q_stateful import BLOCKDET_CTE, block_detections
from netsieve.schema import switches_df
from netsieve.sources.snapshot import read_block_snapshot, write_block_snapshot

EPISODES_SQL = BLOCKDET_CTE + """,
ep(block_src, dst_ip, ip_proto, rn, event_id, start_us, exp_us, opens, to_s) AS (
  SELECT block_src, dst_ip, ip_proto, rn, event_id, us, us + timeout_sec * 1000000, true, timeout_sec FROM bd WHERE rn = 1
  UNION ALL
  SELECT e.block_src, e.dst_ip, e.ip_proto, e.rn, e.event_id,
    CASE WHEN e.us >= p.exp_us THEN e.us ELSE p.start_us END,
    CASE WHEN e.us >= p.exp_us THEN e.us + e.timeout_sec * 1000000 ELSE p.exp_us END,
    e.us >= p.exp_us, CASE WHEN e.us >= p.exp_us THEN e.timeout_sec ELSE p.to_s END
  FROM ep p JOIN bd e ON e.block_src = p.block_src AND e.dst_ip IS NOT DISTINCT FROM p.dst_ip
    AND e.ip_proto = p.ip_proto AND e.rn = p.rn + 1),
blocks AS (SELECT ep.block_src, ep.dst_ip, ep.ip_proto, make_timestamp(start_us) AS start_ts,
  make_timestamp(exp_us) AS expiry_ts, cast(to_s AS int) AS timeout_sec,
  CASE WHEN ep.block_src = '*' THEN 'dst' ELSE 'src' END AS block_scope,
  CASE WHEN ep.block_src = '*' THEN NULL ELSE ep.block_src END AS src_ip
  FROM ep WHERE opens)"""


_BLOCK_TABLES: dict = {}


def blocks(spark, sf):
    """The block table (one row per opened episode) from the detection slice.
    Like the detector's own block table it is built once — written to the
    shared checkpoint folder per application and source version — and read
    by the rule, suppression, snapshot and health queries."""
    from netsieve.plans.q_adapters import _source_version
    key = (spark.sparkContext.applicationId, _source_version(spark, sf))
    if key not in _BLOCK_TABLES:
        e = block_episodes(block_detections(spark, sf), ["block_src", "dst_ip", "ip_proto"])
        t = (e.filter("opens")
              .select("block_src", "dst_ip", "ip_proto", "start_ts", "expiry_ts", "timeout_sec",
                      F.when(F.col("block_src") == "*", "dst").otherwise("src").alias("block_scope"),
                      F.when(F.col("block_src") != "*", F.col("block_src")).alias("src_ip")))
        path = _scratch(spark, "block-table")
        t.write.parquet(path)
        _BLOCK_TABLES[key] = path
    return spark.read.parquet(_BLOCK_TABLES[key])


_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
_V4 = f"^{_OCT}\\.{_OCT}\\.{_OCT}\\.{_OCT}$"
RULES_SQL = f"""
SELECT b.*, s.dpid AS rule_dpid, CASE WHEN s.role = 'leaf' THEN 0 ELSE 1 END AS install_order,
  100 AS rule_priority, CASE WHEN b.block_scope = 'src' THEN 57005 ELSE 48879 END AS cookie,
  CASE WHEN b.block_scope = 'src' THEN b.src_ip END AS match_ipv4_src, b.dst_ip AS match_ipv4_dst,
  CASE WHEN b.ip_proto > 0 THEN b.ip_proto END AS match_ip_proto, b.timeout_sec AS hard_timeout,
  60 AS idle_timeout
FROM blocks b CROSS JOIN (VALUES (1, 'spine'), (2, 'spine'), (3, 'leaf'), (4, 'leaf'), (5, 'leaf')) s(dpid, role)
WHERE CASE WHEN b.block_scope = 'src'
           THEN coalesce(regexp_matches(b.src_ip, '{_V4}'), false)
                AND (b.dst_ip IS NULL OR regexp_matches(b.dst_ip, '{_V4}'))
           ELSE coalesce(regexp_matches(b.dst_ip, '{_V4}'), false) END"""

RULE_COLS = ["block_src", "dst_ip", "ip_proto", "rule_dpid", "install_order", "rule_priority", "cookie",
             "match_ipv4_src", "match_ipv4_dst", "match_ip_proto", "hard_timeout", "idle_timeout"]


def rules(spark, sf):
    return drop_rules(blocks(spark, sf), switches_df(spark))


@register("j3_drop_rules", EPISODES_SQL + ",\nrules AS (" + RULES_SQL + ")\nSELECT " +
          ", ".join(RULE_COLS) + " FROM rules")
def j3_drop_rules(spark, sf):
    return rules(spark, sf).select(*RULE_COLS)


UNBLOCK_IPS_SQL = "SELECT DISTINCT src_ip AS ip FROM flows WHERE ip_proto = 17 AND src_ip IS NOT NULL"


@register("j8_unblock", EPISODES_SQL + ",\nrules AS (" + RULES_SQL + "),\nips AS (" + UNBLOCK_IPS_SQL + ")\nSELECT " + ", ".join(RULE_COLS) + """ FROM rules r
WHERE NOT (r.cookie = 57005 AND r.match_ipv4_src IN (SELECT ip FROM ips))
  AND NOT (r.cookie = 48879 AND r.match_ipv4_dst IN (SELECT ip FROM ips))""")
def j8_unblock(spark, sf):
    ips = (D.flows(spark, sf).filter((F.col("ip_proto") == 17) & F.col("src_ip").isNotNull())
             .select(F.col("src_ip").alias("ip")))
    return unblock(rules(spark, sf), ips).select(*RULE_COLS)


@register("j4_asof_mac_lookup", D.with_views("""
SELECT p.event_id, CASE WHEN (epoch_us(p.ts) - epoch_us(f.ts)) / 1e6 <= 300 THEN f.in_port END AS port,
  CASE WHEN (epoch_us(p.ts) - epoch_us(f.ts)) / 1e6 <= 300 THEN f.ts END AS fact_ts
FROM arrivals p ASOF LEFT JOIN arrivals f ON p.dpid = f.dpid AND p.eth_dst = f.eth_src AND p.ts >= f.ts
WHERE p.eth_dst <> 'ff:ff:ff:ff:ff:ff'
""", "arrivals"))
def j4_asof_mac_lookup(spark, sf):
    a = D.arrivals(spark, sf)
    probes = a.filter(F.col("eth_dst") != "ff:ff:ff:ff:ff:ff").select(
        "event_id", "ts", "dpid", F.col("eth_dst").alias("mac"))
    facts = a.select("ts", "dpid", F.col("eth_src").alias("mac"), F.col("in_port").alias("port"))
    r = asof_lookup(probes, facts, ["dpid", "mac"], "ts", ["port"], tolerance_sec=300.0)
    return r.select("event_id", "port", "fact_ts")


@register("j5_arp_resolution", D.with_views("""
SELECT p.event_id, CASE WHEN (epoch_us(p.ts) - epoch_us(f.ts)) / 1e6 < 300 THEN f.eth_src END AS resolved_mac,
  coalesce((epoch_us(p.ts) - epoch_us(f.ts)) / 1e6 >= 300, true) AS flood
FROM flows p ASOF LEFT JOIN (SELECT ts, src_ip, eth_src FROM arrivals WHERE ethertype = 2054) f
  ON p.dst_ip = f.src_ip AND p.ts >= f.ts
WHERE p.dst_ip IS NOT NULL
""", "flows", "arrivals"))
def j5_arp_resolution(spark, sf):
    """ARP facts (ip -> mac) younger than 300 s resolve a destination; else flood."""
    probes = D.flows(spark, sf).filter(F.col("dst_ip").isNotNull()).select(
        "event_id", "ts", F.col("dst_ip").alias("ip"))
    facts = D.arrivals(spark, sf).filter(F.col("ethertype") == 2054).select(
        "ts", F.col("src_ip").alias("ip"), F.col("eth_src").alias("resolved_mac"))
    r = asof_lookup(probes, facts, ["ip"], "ts", ["resolved_mac"], tolerance_sec=299.999999)
    return r.select("event_id", "resolved_mac", F.col("resolved_mac").isNull().alias("flood"))


@register("j6_antispoof", D.with_views("""
SELECT a.event_id, a.dpid, a.in_port, a.src_ip,
  CASE WHEN l.dpid IS NULL THEN true ELSE l.ok END AS spoof_ok
FROM arrivals a LEFT JOIN (
  SELECT dpid, port, false AS ok FROM (VALUES (3,1),(3,2),(3,3),(4,1),(4,2),(4,3),(4,4),(5,1),(5,2),(5,3)) v(dpid, port)) l
  ON a.dpid = l.dpid AND a.in_port = l.port
""", "arrivals"))
def j6_antispoof(spark, sf):
    """Derived sources are 10.1.x.y and the allow list holds 10.0.0.1-10/32:
    checked ports drop them, unchecked ports pass."""
    r = antispoof(D.arrivals(spark, sf), allowed_sources_df(spark))
    return r.select("event_id", "dpid", "in_port", "src_ip", "spoof_ok")


@register("j7_suppressed_by", EPISODES_SQL + """
SELECT e.event_id, e.src_ip, e.dst_ip, e.ip_proto FROM eligible e
WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.block_scope = 'src' AND b.src_ip = e.src_ip
  AND b.dst_ip IS NOT DISTINCT FROM e.dst_ip AND b.ip_proto = e.ip_proto AND e.ts >= b.start_ts AND e.ts < b.expiry_ts)""")
def j7_suppressed_by(spark, sf):
    b = blocks(spark, sf).filter(F.col("block_scope") == "src")
    f = eligible_flows(D.flows(spark, sf)).select("event_id", "ts", "src_ip", "dst_ip", "ip_proto")
    return suppressed_by(f, b, ["src_ip", "dst_ip", "ip_proto"]).select(
        "event_id", "src_ip", "dst_ip", "ip_proto")


NOW1, NOW2 = "2024-01-01 00:00:00", "2024-01-15 00:00:00"


@register("f4_active_blocks", EPISODES_SQL + f"""
SELECT block_src, dst_ip, ip_proto, expiry_ts FROM blocks WHERE expiry_ts > TIMESTAMP '{NOW2}'""")
def f4_active_blocks(spark, sf):
    return active_blocks(blocks(spark, sf), F.lit(NOW2).cast("timestamp_ntz")).select(
        "block_src", "dst_ip", "ip_proto", "expiry_ts")


@register("s9_read_block_snapshot", EPISODES_SQL + f"""
SELECT block_src, dst_ip, ip_proto, max(expiry_ts) AS expiry_ts FROM blocks
GROUP BY block_src, dst_ip, ip_proto HAVING max(expiry_ts) > TIMESTAMP '{NOW2}'""")
def s9_read_block_snapshot(spark, sf):
    """S10 then S9: the block table (newest episode per key) saved at NOW1,
    when all entries are unexpired, then read back at NOW2."""
    path = _scratch(spark, "snapshot")
    b = blocks(spark, sf)
    table = (b.groupBy("block_src", "dst_ip", "ip_proto")
              .agg(F.max_by("expiry_ts", "start_ts").alias("expiry_ts")))
    write_block_snapshot(table, path, F.lit(NOW1).cast("timestamp_ntz"), NOW1)
    r = read_block_snapshot(spark, path, NOW2)
    return r.select("block_src", "dst_ip", "ip_proto", F.col("expiry_ts").cast("timestamp_ntz").alias("expiry_ts"))


def _table_stats(spark, sf):
    f = eligible_flows(D.flows(spark, sf))
    return (f.groupBy("poll_ts", "dpid").agg(F.count(F.lit(1)).alias("active_count"))
             .withColumn("table_id", F.lit(0))
             .withColumn("max_entries", F.when(F.col("dpid") == 5, 0).otherwise(50 + F.col("dpid") * 5)))


STATS_SQL = """SELECT poll_ts, dpid, count(*) AS active_count, 0 AS table_id,
  CASE WHEN dpid = 5 THEN 0 ELSE 50 + dpid * 5 END AS max_entries FROM eligible GROUP BY poll_ts, dpid"""
USAGE_SQL = """SELECT poll_ts, dpid, active_count,
  CASE WHEN max_entries <= 0 THEN 2000 ELSE max_entries END AS max_entries,
  active_count / CASE WHEN max_entries <= 0 THEN 2000 ELSE max_entries END AS usage,
  CASE WHEN active_count / CASE WHEN max_entries <= 0 THEN 2000 ELSE max_entries END >= 0.95 THEN 'critical'
       WHEN active_count / CASE WHEN max_entries <= 0 THEN 2000 ELSE max_entries END >= 0.80 THEN 'warning'
       ELSE 'ok' END AS level FROM stats WHERE table_id = 0"""


@register("a13_table_usage", D.with_views("SELECT * FROM usage", "flows",
                                          extra={"eligible": ELIGIBLE_SQL, "stats": STATS_SQL,
                                                 "usage": USAGE_SQL}))
def a13_table_usage(spark, sf):
    return table_usage_polls(spark, sf)


def table_usage_polls(spark, sf):
    """Per (poll, switch) usage: the stats rows keep their poll column."""
    return table_usage(_table_stats(spark, sf), keep=["poll_ts"])


@register("a14_eviction_candidates", D.with_views("""
SELECT e.event_id, e.dpid, e.poll_ts, e.priority FROM eligible e
WHERE e.priority > 0 AND e.priority <= 10
  AND EXISTS (SELECT 1 FROM usage u WHERE u.level = 'critical' AND u.dpid = e.dpid AND u.poll_ts = e.poll_ts)""",
    "flows", extra={"eligible": ELIGIBLE_SQL, "stats": STATS_SQL, "usage": USAGE_SQL}))
def a14_eviction_candidates(spark, sf):
    u = table_usage_polls(spark, sf)
    e = eligible_flows(D.flows(spark, sf))
    return eviction_candidates(e, u, ["dpid", "poll_ts"]).select("event_id", "dpid", "poll_ts", "priority")


@register("a15_health", EPISODES_SQL + """,
p AS (SELECT floor(epoch_us(ts) / 86400000000)::BIGINT AS bucket, count(DISTINCT dpid) AS switches_seen FROM flows GROUP BY 1),
bb AS (SELECT floor(epoch_us(start_ts) / 86400000000)::BIGINT AS bucket, count(*) AS active_blocks FROM blocks
       WHERE expiry_ts > make_timestamp((floor(epoch_us(start_ts) / 86400000000)::BIGINT + 1) * 86400000000)
       GROUP BY 1)
SELECT make_timestamp(p.bucket * 86400000000) AS bucket_start, p.switches_seen,
  coalesce(bb.active_blocks, 0) AS active_blocks, true AS model_loaded
FROM p LEFT JOIN bb ON p.bucket = bb.bucket""")
def a15_health(spark, sf):
    h = health(D.flows(spark, sf), blocks(spark, sf), 86400, "ts")
    return h.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


CYCLE_SEC = 5


@register("a15_health_cycles", EPISODES_SQL + f""",
p AS (SELECT floor(epoch_us(ts) / {CYCLE_SEC}000000)::BIGINT AS bucket, count(DISTINCT dpid) AS switches_seen FROM flows GROUP BY 1),
e AS (SELECT *, make_timestamp((bucket + 1) * {CYCLE_SEC}000000) AS end_ts FROM p),
bb AS (SELECT e.bucket, count(*) AS active_blocks FROM e JOIN blocks b ON b.start_ts < e.end_ts AND b.expiry_ts > e.end_ts GROUP BY 1),
m AS (SELECT ts, max_by(cast(regexp_extract(props, '([0-9]+)', 1) AS int) < 90, event_id) AS loaded FROM events GROUP BY ts)
SELECT make_timestamp(e.bucket * {CYCLE_SEC}000000) AS bucket_start, e.switches_seen,
  coalesce(bb.active_blocks, 0) AS active_blocks, coalesce(m.loaded, false) AS model_loaded
FROM e ASOF LEFT JOIN m ON e.end_ts >= m.ts LEFT JOIN bb ON e.bucket = bb.bucket""")
def a15_health_cycles(spark, sf):
    """A15 at the controller's cycle of 5 s, where a block spans many buckets; the
    model counts as loaded while the monitor's last sample is below 900 flows."""
    models = D.perf_samples(spark, sf).select("ts", "event_id", (F.col("active_flows") < 900).alias("loaded"))
    h = health(D.flows(spark, sf), blocks(spark, sf), CYCLE_SEC, "ts", models=models)
    return h.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@register("f2_classify_frames", D.with_views("""
SELECT event_id, CASE WHEN ethertype = 2054 THEN 'arp' WHEN ethertype = 2048 THEN 'ipv4' ELSE 'other' END AS frame_kind
FROM arrivals WHERE ethertype <> 35020""", "arrivals"))
def f2_classify_frames(spark, sf):
    return classify_frames(D.arrivals(spark, sf)).select("event_id", "frame_kind")
