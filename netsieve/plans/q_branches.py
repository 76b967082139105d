"""Variants whose derived rows reach both outcomes of a rule.

In the plain derived views flows of a key are minutes apart, sources lie outside
the allow list and ARP facts outside the destinations, so some rules only ever
take one branch there. Here events are 20 ms apart and addresses are drawn from
the hosts' own range.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.operators.filters import eligible_flows
from netsieve.operators.joins import allowed_sources_df, antispoof, asof_lookup, suppressed_by, unblock
from netsieve.operators.stateful import learn_macs
from netsieve.operators.windows import rate_of_change
from netsieve.plans import derived as D
from netsieve.plans.catalog import ORACLES, register
from netsieve.plans.q_core import ELIGIBLE_SQL
from netsieve.plans.q_joins import EPISODES_SQL, RULE_COLS, RULES_SQL, blocks, rules

DENSE_SQL = "make_timestamp(1704067200000000 + event_id * 20000)"


def _dense(df):
    return df.withColumn("ts", F.timestamp_micros(F.lit(1704067200000000) + F.col("event_id") * 20000).cast("timestamp_ntz"))


# the oracle of W1 reads its rows from the view ``eligible``: put denser rows in it


def _dense_w1() -> str:
    plain = ORACLES["w1_rate_of_change"]
    view = f"eligible AS ({ELIGIBLE_SQL.strip()})"
    if view not in plain:
        raise RuntimeError("the oracle of w1_rate_of_change has no view to replace")
    return plain.replace(view, f"eligible0 AS ({ELIGIBLE_SQL.strip()}),\neligible AS (SELECT * REPLACE ({DENSE_SQL} AS ts) FROM eligible0)")


def load():
    from netsieve.plans import q_windows  # noqa: F401  its oracle is extended

    @register("w1_rate_of_change_dense", _dense_w1())
    def w1_rate_of_change_dense(spark, sf):
        return rate_of_change(_dense(eligible_flows(D.flows(spark, sf)))).select("event_id", "pps_delta", "bps_delta", "pps_acceleration")


load()


_FACTS_SQL = f"""SELECT {DENSE_SQL} AS ts, concat('10.0.0.', cast(user_id % 12 + 1 AS varchar)) AS ip,
  concat('02:00:00:00:00:', lpad(cast(user_id % 100 AS varchar), 2, '0')) AS mac FROM events WHERE event_type = 'signup'"""


@register("j5_arp_resolution_local", D.with_views("""
SELECT p.event_id, CASE WHEN (epoch_us(p.ts) - epoch_us(f.ts)) / 1e6 < 1 THEN f.mac END AS resolved_mac,
  coalesce((epoch_us(p.ts) - epoch_us(f.ts)) / 1e6 >= 1, true) AS flood
FROM p ASOF LEFT JOIN f ON p.dst_ip = f.ip AND p.ts >= f.ts
""", "flows", extra={"f": _FACTS_SQL, "p": f"SELECT event_id, {DENSE_SQL} AS ts, dst_ip FROM flows WHERE dst_ip IS NOT NULL"}))
def j5_arp_resolution_local(spark, sf):
    """J5 with facts about the destinations' own addresses, one second old at most."""
    e = _dense(D.read_table(spark, sf, "events").where("event_type = 'signup'"))
    facts = e.select("ts", F.concat(F.lit("10.0.0."), (F.col("user_id") % 12 + 1).cast("string")).alias("ip"),
                     F.concat(F.lit("02:00:00:00:00:"), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0")).alias("resolved_mac"))
    probes = _dense(D.flows(spark, sf)).where("dst_ip is not null").select("event_id", "ts", F.col("dst_ip").alias("ip"))
    r = asof_lookup(probes, facts, ["ip"], "ts", ["resolved_mac"], tolerance_sec=0.999999)
    return r.select("event_id", "resolved_mac", F.col("resolved_mac").isNull().alias("flood"))


@register("j6_antispoof_local", D.with_views("""
SELECT a.event_id, a.dpid, a.in_port, concat('10.0.0.', cast(a.event_id % 12 + 1 AS varchar)) AS src_ip,
  CASE WHEN l.dpid IS NULL THEN true ELSE l.host = a.event_id % 12 + 1 END AS spoof_ok
FROM arrivals a LEFT JOIN (VALUES (3,1,1),(3,2,2),(3,3,3),(4,1,4),(4,2,5),(4,3,6),(4,4,7),(5,1,8),(5,2,9),(5,3,10)) l(dpid, port, host)
  ON a.dpid = l.dpid AND a.in_port = l.port
""", "arrivals"))
def j6_antispoof_local(spark, sf):
    """J6 with sources of the hosts' range: some are the port's own host."""
    a = D.arrivals(spark, sf).withColumn("src_ip", F.concat(F.lit("10.0.0."), (F.col("event_id") % 12 + 1).cast("string")))
    return antispoof(a, allowed_sources_df(spark)).select("event_id", "dpid", "in_port", "src_ip", "spoof_ok")


@register("j7_suppressed_by_any", EPISODES_SQL + """
SELECT e.event_id, e.src_ip, e.dst_ip, e.ip_proto FROM eligible e
WHERE EXISTS (SELECT 1 FROM blocks b WHERE e.ts >= b.start_ts AND e.ts < b.expiry_ts AND b.ip_proto = e.ip_proto
  AND b.dst_ip IS NOT DISTINCT FROM e.dst_ip AND (b.block_scope = 'dst' OR b.src_ip = e.src_ip))""")
def j7_suppressed_by_any(spark, sf):
    """J7 over all blocks: those of the source, and those of the destination
    against any source."""
    b = blocks(spark, sf)
    f = eligible_flows(D.flows(spark, sf)).select("event_id", "ts", "src_ip", "dst_ip", "ip_proto")
    by_src = suppressed_by(f, b.where("block_scope = 'src'"), ["src_ip", "dst_ip", "ip_proto"])
    by_dst = suppressed_by(f, b.where("block_scope = 'dst'"), ["dst_ip", "ip_proto"])
    return by_src.select("event_id", "src_ip", "dst_ip", "ip_proto").unionByName(by_dst.select("event_id", "src_ip", "dst_ip", "ip_proto")).distinct()


@register("j7_suppressed_by_restored", EPISODES_SQL + """,
every AS (SELECT src_ip, dst_ip, ip_proto, block_scope, start_ts, expiry_ts FROM blocks
  UNION ALL SELECT src_ip, dst_ip, ip_proto, block_scope, start_ts - INTERVAL 2 DAY, start_ts + to_days(CAST(1 + day(start_ts) % 6 AS INTEGER)) FROM blocks)
SELECT e.event_id, e.src_ip, e.dst_ip, e.ip_proto FROM eligible e
WHERE EXISTS (SELECT 1 FROM every b WHERE b.block_scope = 'src' AND b.src_ip = e.src_ip
  AND b.dst_ip IS NOT DISTINCT FROM e.dst_ip AND b.ip_proto = e.ip_proto AND e.ts >= b.start_ts AND e.ts < b.expiry_ts)""")
def j7_suppressed_by_restored(spark, sf):
    """J7 where restored blocks, which last for days, overlap the newer ones."""
    cols = ["src_ip", "dst_ip", "ip_proto", "block_scope", "start_ts", "expiry_ts"]
    b = blocks(spark, sf)
    days = F.make_dt_interval((1 + F.dayofmonth("start_ts") % 6).cast("int"))
    restored = b.withColumns({"expiry_ts": F.col("start_ts") + days, "start_ts": F.col("start_ts") - F.expr("interval 2 days")})
    every = b.select(cols).unionByName(restored.select(cols)).where("block_scope = 'src'")
    f = eligible_flows(D.flows(spark, sf)).select("event_id", "ts", "src_ip", "dst_ip", "ip_proto")
    return suppressed_by(f, every, ["src_ip", "dst_ip", "ip_proto"]).select("event_id", "src_ip", "dst_ip", "ip_proto")


UNBLOCK_DST_SQL = "SELECT DISTINCT dst_ip AS ip FROM flows WHERE event_id % 10 = 3 AND dst_ip IS NOT NULL AND dst_ip <> '10.0.0.4'"


@register("j8_unblock_destinations", EPISODES_SQL + ",\nrules AS (" + RULES_SQL + "),\nips AS (" + UNBLOCK_DST_SQL + ")\nSELECT " + ", ".join(RULE_COLS) + """ FROM rules r
WHERE NOT (r.cookie = 57005 AND r.match_ipv4_src IN (SELECT ip FROM ips))
  AND NOT (r.cookie = 48879 AND r.match_ipv4_dst IN (SELECT ip FROM ips))""")
def j8_unblock_destinations(spark, sf):
    """J8 with destination addresses, so that destination rules go."""
    ips = D.flows(spark, sf).where("event_id % 10 = 3 and dst_ip is not null and dst_ip <> '10.0.0.4'").select(F.col("dst_ip").alias("ip"))
    return unblock(rules(spark, sf), ips).select(*RULE_COLS)


@register("st4_learn_macs_dense")
def st4_learn_macs_dense(spark, sf):
    """ST4 with events 20 ms apart: ports fill up, entries age."""
    a = _dense(D.arrivals(spark, sf))
    return learn_macs(a, age_sec=2.0).select("event_id", "learned", "evicted_before")


@register("p6_features_long", D.with_views("SELECT event_id, feature, value FROM (SELECT event_id, "
          "unnest(['packet_count', 'byte_count', 'flow_duration_sec']) AS feature, "
          "unnest([cast(packet_count AS double), cast(byte_count AS double), cast(duration_sec AS double)]) AS value FROM eligible) x",
          "flows", extra={"eligible": ELIGIBLE_SQL}))
def p6_features_long(spark, sf):
    """Entries of the feature map, unpacked; the counters, whose values the
    flow row states."""
    from netsieve.operators.features import features_to_map, live_features
    f = features_to_map(live_features(eligible_flows(D.flows(spark, sf)), keep=["event_id"]))
    long = f.select("event_id", F.explode("features").alias("feature", "value"))
    return long.where(F.col("feature").isin("packet_count", "byte_count", "flow_duration_sec"))
