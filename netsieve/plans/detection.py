"""The detection slice: which (poll, destination) pairs are under a flood,
which flows would be blocked and with which scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.functions.network import attack_type, jitter_timeout
from netsieve.operators._prefix import _materialise
from netsieve.operators.aggregates import dst_aggregates
from netsieve.operators.detect import threshold_detect
from netsieve.operators.features import live_features
from netsieve.operators.filters import detections, eligible_flows
from netsieve.operators.joins import drop_rules, spoof_verdict, with_dst_aggregates
from netsieve.operators.stateful import block_episodes
from netsieve.operators.windows import FLOW_KEY, priority_sample, rate_of_change
from netsieve.schema import LEAF_DPIDS
from netsieve.sources.logs import attack_log

META = ["event_id", "ts", "dpid", "src_ip", "dst_ip"]


def featurize(flows: DataFrame, poll: str = "poll_ts",
              leaf_dpids: list[int] | None = None) -> DataFrame:
    """F1 -> A1 -> J1/A3 -> P2: the 12 live features per eligible flow, with
    the flow identity kept beside them."""
    elig = eligible_flows(flows)
    agg = dst_aggregates(elig, poll, leaf_dpids or LEAF_DPIDS)
    j = with_dst_aggregates(elig, agg, poll)
    keep = [c for c in META if c in j.columns] + [poll]
    d = F.greatest(F.col("duration_sec").cast("double"), F.lit(0.001))
    j = j.withColumns({"pps": F.col("packet_count") / d, "bps": F.col("byte_count") / d})
    return live_features(j, keep=keep + ["pps", "bps"])


def detect_floods(flows: DataFrame, poll: str = "poll_ts",
                  leaf_dpids: list[int] | None = None,
                  min_sources: int = 10, min_flows: int = 15, scorer=None, threshold: float = 0.7) -> DataFrame:
    """featurize -> M10/M11 fast path on the raw counter rates (duration
    floored at 1 ms, as the sampler computes them) -> known source -> J2 -> P17.
    With a ``scorer`` (rows -> rows with ``attack_prob``) the flows that the fast
    path leaves are scored, and F3 takes those at or above ``threshold``."""
    f = threshold_detect(featurize(flows, poll, leaf_dpids), pps="pps", bps="bps")
    caught = F.col("is_attack") & F.col("src_ip").isNotNull()
    if scorer is None:
        det = f.filter(caught)
    else:
        # one pass over the features: the scorer's probability counts where the
        # fast path has not decided
        s = scorer(f.drop("attack_prob"))
        s = s.withColumn("attack_prob", F.when(F.col("is_attack"), F.lit(1.0)).otherwise(F.col("attack_prob")))
        det = detections(s, threshold).drop("attack_prob")
    v = spoof_verdict(det, None, poll, min_sources, min_flows)
    return v.select(
        *[c for c in META if c in v.columns], poll, "ip_proto",
        attack_type("ip_proto").alias("attack_type"),
        "pps",
        "flows_to_dst", "unique_sources_to_dst", "is_spoofed", "block_scope", "block_src")


# what one batch of polls leaves for the next: the last row of each flow that can
# still give a rate of change, and the blocks still open
CARRIED = {
    "flow_state": "dpid int, src_ip string, dst_ip string, ip_proto int, ts timestamp_ntz, event_id long, duration_sec long, packet_count long, byte_count long",
    "block_state": "block_src string, dst_ip string, ip_proto int, ts timestamp_ntz, event_id long, timeout_sec int",
}
BLOCK_KEY = ["block_src", "dst_ip", "ip_proto"]
RATES = ["pps_delta", "bps_delta", "pps_acceleration"]


def detect_and_block(flows: DataFrame, switches: DataFrame, carried: dict[str, DataFrame] | None = None, poll: str = "poll_ts", scorer=None,
                     threshold: float = 0.7, leaf_dpids: list[int] | None = None, min_sources: int = 10, min_flows: int = 15, sample_n: int | None = 500,
                     sample_pps: float = 100.0, ttl_sec: float = 300.0, block_sec: int = 300) -> dict[str, DataFrame]:
    """ST7 as one plan over complete polls: F1 -> W1 -> A1/J1 -> W3 -> P2 -> M10/M11
    and, with a ``scorer``, M9 -> F3 -> J2 -> P17 -> P21 -> ST3 -> J3 and S11.

    Returns ``detections`` (every detection with its block), ``attack_log`` and
    ``rules`` (of detections that open a block), and the ``CARRIED`` tables. Given
    those of the polls before as ``carried``, batches of polls in order give what
    one batch of all gives. Carried rows end: a flow's when its poll lies
    ``ttl_sec`` back, a block's when it has expired. A row's ``ts`` is never
    earlier than its poll, nor later than the next."""
    c = carried or {}
    spark = flows.sparkSession
    old = {name: c[name] if name in c else spark.createDataFrame([], kind) for name, kind in CARRIED.items()}
    elig = eligible_flows(flows)

    seen = elig.withColumn("__new", F.lit(True)).unionByName(old["flow_state"].withColumn("__new", F.lit(False)), allowMissingColumns=True)
    rated = rate_of_change(seen, ttl_sec=ttl_sec).where("__new").drop("__new")
    joined = with_dst_aggregates(rated, dst_aggregates(elig, poll, leaf_dpids or LEAF_DPIDS), poll)
    sampled = priority_sample(joined, poll, sample_n, sample_pps).withColumns({"pps": F.col("pps_now"), "bps": F.col("bps_now")})
    f = threshold_detect(live_features(sampled, keep=[*META, poll, "pps", "bps", *RATES]), pps="pps", bps="bps")
    if scorer is None:
        det = f.where(F.col("is_attack") & F.col("src_ip").isNotNull())
    else:
        s = scorer(f.drop("attack_prob")).withColumn("attack_prob", F.when(F.col("is_attack"), F.lit(1.0)).otherwise(F.col("attack_prob")))
        det = detections(s, threshold)
    det = spoof_verdict(det, None, poll, min_sources, min_flows).withColumn("attack_type", attack_type("ip_proto"))
    key = F.concat_ws("|", "block_src", "dst_ip", F.col("ip_proto").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    det = det.select(*META, poll, "ip_proto", "attack_type", "pps", *RATES, "attack_prob", "flows_to_dst", "unique_sources_to_dst", "is_spoofed",
                     "block_scope", "block_src", jitter_timeout(key, block_sec).alias("timeout_sec"))

    # an open block's first detection comes before all new ones and opens it again
    hits = det.withColumn("__new", F.lit(True)).unionByName(old["block_state"].withColumn("__new", F.lit(False)), allowMissingColumns=True)
    blocks = _materialise(block_episodes(_materialise(hits), BLOCK_KEY))  # read by every table below
    placed = blocks.where("__new").drop("__new")
    opened = placed.where("opens")

    last = flows.agg(F.max(poll).cast("timestamp").alias("__last"))  # one row
    us = lambda col: F.unix_micros(F.col(col).cast("timestamp"))
    flow_row = F.struct("ts", "event_id", "duration_sec", "packet_count", "byte_count")
    flow_state = (seen.groupBy(*FLOW_KEY).agg(F.max(flow_row).alias("r")).crossJoin(F.broadcast(last))
                  .where(us("r.ts") > us("__last") - int(ttl_sec * 1e6)).select(*FLOW_KEY, "r.*"))
    block_state = blocks.where("opens").crossJoin(F.broadcast(last)).where(us("expiry_ts") > us("__last")).select(
        *BLOCK_KEY, "ts", "event_id", "timeout_sec")
    return {"detections": placed, "attack_log": attack_log(opened, switches.count()), "rules": drop_rules(opened.drop("dpid"), switches),
            "flow_state": flow_state, "block_state": block_state}
