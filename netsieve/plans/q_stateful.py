"""Chain queries (ST1-ST4, ST6) with recursive-CTE oracles.

Window/limit parameters are chosen for the fixture's event density (events
are minutes apart, so the reference's per-second limits would admit
everything); the operators take them as arguments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.functions.network import jitter_timeout
from netsieve.operators.stateful import (
    admit, block_episodes, breaker_states, learn_macs, suppress_floods)
from netsieve.plans import derived as D
from netsieve.plans.catalog import register
from netsieve.plans.detection import detect_floods
from netsieve.plans.q_core import _detect_sql

ST1_LIMIT, ST1_WINDOW = 5, 3600
ST2_LIMIT, ST2_WINDOW, ST2_DEDUP = 20, 3600, 21600


def _admit_rcte(src: str, key: str, limit: int, window_s: int, name: str = "adm") -> str:
    w = window_s * 1_000_000
    return f"""
{name}_ev AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM {src}),
{name}(k, rn, event_id, start_us, cnt, admitted) AS (
  SELECT {key}, rn, event_id, us, 1, true FROM {name}_ev WHERE rn = 1
  UNION ALL
  SELECT e.{key}, e.rn, e.event_id,
    CASE WHEN e.us - r.start_us >= {w} THEN e.us ELSE r.start_us END,
    CASE WHEN e.us - r.start_us >= {w} THEN 1 WHEN r.cnt < {limit} THEN r.cnt + 1 ELSE r.cnt END,
    CASE WHEN e.us - r.start_us >= {w} THEN true ELSE r.cnt < {limit} END
  FROM {name} r JOIN {name}_ev e ON e.{key} = r.k AND e.rn = r.rn + 1)"""


@register("st1_admit", "WITH RECURSIVE arrivals AS (" + D.ARRIVALS_SQL + ")," +
          _admit_rcte("arrivals", "dpid", ST1_LIMIT, ST1_WINDOW) + """
SELECT event_id, admitted, make_timestamp(start_us) AS window_start FROM adm""")
def st1_admit(spark, sf):
    return admit(D.arrivals(spark, sf), ["dpid"], limit=ST1_LIMIT, window_sec=ST1_WINDOW).select(
        "event_id", "admitted", "window_start")


@register("st2_suppress_floods", "WITH RECURSIVE arrivals AS (" + D.ARRIVALS_SQL + ")," +
          _admit_rcte("arrivals", "dpid", ST2_LIMIT, ST2_WINDOW) + f""",
fl AS (SELECT a.*, adm.admitted, epoch_us(a.ts) AS us,
         row_number() OVER (PARTITION BY a.dpid, a.eth_src, a.eth_dst, a.ethertype ORDER BY a.ts, a.event_id) AS rn
       FROM arrivals a JOIN adm ON a.event_id = adm.event_id),
sup(dpid, eth_src, eth_dst, ethertype, rn, event_id, last_us, suppressed) AS (
  SELECT dpid, eth_src, eth_dst, ethertype, rn, event_id, CASE WHEN admitted THEN us END, NOT admitted FROM fl WHERE rn = 1
  UNION ALL
  SELECT e.dpid, e.eth_src, e.eth_dst, e.ethertype, e.rn, e.event_id,
    CASE WHEN NOT e.admitted OR (s.last_us IS NOT NULL AND e.us - s.last_us < {ST2_DEDUP * 1_000_000}) THEN s.last_us ELSE e.us END,
    NOT e.admitted OR (s.last_us IS NOT NULL AND e.us - s.last_us < {ST2_DEDUP * 1_000_000})
  FROM sup s JOIN fl e ON e.dpid = s.dpid AND e.eth_src = s.eth_src AND e.eth_dst = s.eth_dst
    AND e.ethertype = s.ethertype AND e.rn = s.rn + 1)
SELECT event_id, suppressed FROM sup""")
def st2_suppress_floods(spark, sf):
    return suppress_floods(D.arrivals(spark, sf), limit=ST2_LIMIT, window_sec=ST2_WINDOW,
                           dedup_sec=ST2_DEDUP).select("event_id", "suppressed")


BLOCK_TIMEOUT = 300


def block_detections(spark, sf):
    """Detections of the slice with their block key and the jittered timeout
    a block opened by them would get (P21)."""
    det = detect_floods(D.flows(spark, sf), "poll_ts")
    key = F.concat_ws("|", "block_src", "dst_ip", F.col("ip_proto").cast("string"),
                      F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    return det.withColumn("timeout_sec", jitter_timeout(key, BLOCK_TIMEOUT))


_DET = _detect_sql(10, 15)
_head, _tail = _DET.split("\nSELECT event_id, ts, dpid", 1)
BLOCKDET_CTE = (_head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\ndetections AS (SELECT event_id, ts, dpid" + _tail + """),
bd AS (SELECT *, 240 + (('0x' || substr(md5(concat_ws('|', block_src, dst_ip, cast(ip_proto AS varchar),
         cast(epoch_us(ts) AS varchar))), 1, 8))::BIGINT) % 121 AS timeout_sec,
       epoch_us(ts) AS us,
       row_number() OVER (PARTITION BY block_src, dst_ip, ip_proto ORDER BY ts, event_id) AS rn
       FROM detections)""")


@register("p21_jitter_timeout", BLOCKDET_CTE + "\nSELECT event_id, cast(timeout_sec AS int) AS timeout_sec FROM bd")
def p21_jitter_timeout(spark, sf):
    return block_detections(spark, sf).select("event_id", "timeout_sec")


@register("st3_block_episodes", BLOCKDET_CTE + """,
ep(block_src, dst_ip, ip_proto, rn, event_id, start_us, exp_us, opens) AS (
  SELECT block_src, dst_ip, ip_proto, rn, event_id, us, us + timeout_sec * 1000000, true FROM bd WHERE rn = 1
  UNION ALL
  SELECT e.block_src, e.dst_ip, e.ip_proto, e.rn, e.event_id,
    CASE WHEN e.us >= p.exp_us THEN e.us ELSE p.start_us END,
    CASE WHEN e.us >= p.exp_us THEN e.us + e.timeout_sec * 1000000 ELSE p.exp_us END,
    e.us >= p.exp_us
  FROM ep p JOIN bd e ON e.block_src = p.block_src AND e.dst_ip IS NOT DISTINCT FROM p.dst_ip
    AND e.ip_proto = p.ip_proto AND e.rn = p.rn + 1)
SELECT event_id, block_src, dst_ip, ip_proto, opens, make_timestamp(start_us) AS start_ts,
  make_timestamp(exp_us) AS expiry_ts FROM ep""")
def st3_block_episodes(spark, sf):
    b = block_episodes(block_detections(spark, sf), ["block_src", "dst_ip", "ip_proto"])
    return b.select("event_id", "block_src", "dst_ip", "ip_proto", "opens", "start_ts", "expiry_ts")


OUTCOMES_SQL = "SELECT event_id, ts, event_type AS model, value >= 20 AS ok FROM events"


def outcomes(spark, sf):
    e = D.read_table(spark, sf, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("model"), (F.col("value") >= 20).alias("ok"))


@register("st6_breaker_states", """
WITH RECURSIVE o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS rn
                     FROM (""" + OUTCOMES_SQL + """) x),
b(model, rn, event_id, s, f, c, l, tf, tfb, fb) AS (
  SELECT DISTINCT model, 0, NULL::BIGINT, 'closed', 0, 0, NULL::BIGINT, 0, 0, false FROM o
  UNION ALL
  SELECT model, rn, event_id,
    CASE WHEN s0 = 'open' THEN 'open'
         WHEN ok AND s0 = 'half_open' THEN CASE WHEN c0 + 1 >= 2 THEN 'closed' ELSE 'half_open' END
         WHEN ok THEN s0
         WHEN s0 = 'half_open' OR pf + 1 >= 5 THEN 'open' ELSE s0 END,
    CASE WHEN s0 = 'open' THEN pf
         WHEN ok AND s0 = 'half_open' THEN CASE WHEN c0 + 1 >= 2 THEN 0 ELSE pf END
         WHEN ok THEN 0 ELSE pf + 1 END,
    CASE WHEN s0 = 'open' THEN c0
         WHEN ok AND s0 = 'half_open' THEN CASE WHEN c0 + 1 >= 2 THEN 0 ELSE c0 + 1 END
         ELSE c0 END,
    CASE WHEN s0 <> 'open' AND NOT ok THEN us ELSE pl END,
    CASE WHEN s0 <> 'open' AND NOT ok THEN ptf + 1 ELSE ptf END,
    CASE WHEN s0 = 'open' OR NOT ok THEN ptfb + 1 ELSE ptfb END,
    s0 = 'open' OR NOT ok
  FROM (SELECT e.model, e.rn, e.event_id, e.ok, e.us, p.f AS pf, p.l AS pl, p.tf AS ptf, p.tfb AS ptfb,
          CASE WHEN p.s = 'open' AND p.l IS NOT NULL AND e.us - p.l >= 30000000 THEN 'half_open' ELSE p.s END AS s0,
          CASE WHEN p.s = 'open' AND p.l IS NOT NULL AND e.us - p.l >= 30000000 THEN 0 ELSE p.c END AS c0
        FROM b p JOIN o e ON e.model = p.model AND e.rn = p.rn + 1) z)
SELECT event_id, s AS state, fb AS use_fallback, cast(tf AS bigint) AS total_failures,
  cast(tfb AS bigint) AS total_fallbacks FROM b WHERE rn >= 1""")
def st6_breaker_states(spark, sf):
    return breaker_states(outcomes(spark, sf)).select(
        "event_id", "state", "use_fallback", "total_failures", "total_fallbacks")


@register("st4_learn_macs")
def st4_learn_macs(spark, sf):
    """Address learning with ageing and the port limit together (rows-only:
    the state is a map per switch)."""
    return learn_macs(D.arrivals(spark, sf), max_macs=5, age_sec=300.0).select(
        "event_id", "dpid", "in_port", "eth_src", "learned", "evicted_before")


@register("st5_adwin")
def st5_adwin(spark, sf):
    """ADWIN over each event type's values in time order (rows-only: the
    algorithm is checked against a brute-force windowed test in tests/)."""
    from netsieve.operators.stateful import adwin
    e = D.read_table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return adwin(e, ["event_type"], "value").select("event_id", "drift", "window_size", "drift_count")


def _st6_sql():
    from netsieve.plans.catalog import ORACLES
    return ORACLES["st6_breaker_states"]


@register("m12_score_guarded", None)
def m12_score_guarded(spark, sf):
    """Per flow, the model score unless the breaker of its model (the
    event type) is open at that time (newest breaker state at or before the
    flow, as-of), in which case the threshold verdict's probability is used.
    The model score here is a stand-in scorer min(1, pps / 20000)."""
    from netsieve.operators.detect import threshold_detect
    from netsieve.operators.features import clamped_features
    from netsieve.operators.filters import eligible_flows
    from netsieve.operators.ml import score_guarded
    e = D.read_table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"))
    f = clamped_features(eligible_flows(D.flows(spark, sf)), keep=["event_id", "ts"]).join(e, "event_id")
    f = threshold_detect(f).withColumnRenamed("attack_prob", "fallback_prob") \
        .withColumn("model_prob", F.least(F.lit(1.0), F.col("packet_count_per_second") / 20000.0))
    states = breaker_states(outcomes(spark, sf)).select("model", "ts", "state")
    g = score_guarded(f.select("event_id", "ts", "model", "model_prob", "fallback_prob"), states, "model", "ts")
    return g.select("event_id", "used_fallback", "final_prob")


def _m12_sql():
    st6 = _st6_sql()
    head, _ = st6.rsplit("\nSELECT event_id, s AS state", 1)
    return head + """,
states AS (SELECT o.ts, o.model, b.s AS state FROM b JOIN o ON b.event_id = o.event_id WHERE b.rn >= 1),
""" + """flows AS (""" + D.FLOWS_SQL + """),
eligible AS (SELECT * FROM flows WHERE priority <> 0 AND (src_ip IS NOT NULL OR dst_ip IS NOT NULL)
  AND duration_sec >= 0 AND packet_count >= 0 AND byte_count >= 0),
f AS (SELECT x.event_id, x.ts, ev.event_type AS model,
        least(1.0, (packet_count / greatest(cast(duration_sec AS double), 0.001)) / 20000.0) AS model_prob,
        CASE WHEN packet_count / greatest(cast(duration_sec AS double), 0.001) > 10000
               OR byte_count / greatest(cast(duration_sec AS double), 0.001) > 50000000 THEN 0.5 ELSE 0.1 END AS fallback_prob
      FROM eligible x JOIN events ev ON x.event_id = ev.event_id)
SELECT f.event_id, coalesce(s.state = 'open', false) AS used_fallback,
  CASE WHEN coalesce(s.state = 'open', false) THEN f.fallback_prob ELSE f.model_prob END AS final_prob
FROM f ASOF LEFT JOIN states s ON f.model = s.model AND f.ts >= s.ts"""


def _register_m12_oracle():
    from netsieve.plans.catalog import ORACLES
    ORACLES["m12_score_guarded"] = _m12_sql()


_register_m12_oracle()


@register("a18_drift_signal", None)
def a18_drift_signal(spark, sf):
    """Mean attack probability per poll (the drift monitor's input)."""
    from netsieve.operators.aggregates import drift_signal
    from netsieve.operators.detect import threshold_detect
    from netsieve.plans.detection import featurize
    s = threshold_detect(featurize(D.flows(spark, sf), "poll_ts"), pps="pps", bps="bps")
    d = drift_signal(s, "poll_ts")
    return d.select("poll_ts", F.round("mean_attack_prob", 9).alias("mean_attack_prob"), "n")


def _register_a18_oracle():
    from netsieve.plans.catalog import ORACLES
    from netsieve.plans.q_core import _views
    ORACLES["a18_drift_signal"] = D.with_views(
        "SELECT poll_ts, round(avg(attack_prob), 9) AS mean_attack_prob, count(*) AS n FROM scored GROUP BY poll_ts",
        "flows", extra=_views())


_register_a18_oracle()
