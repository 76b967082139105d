"""Joins (J1-J9): equi, anti, broadcast-checked dimension joins, as-of and
interval joins expressed without a cross product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.functions.network import ip_to_long, valid_ipv4
from netsieve.operators._split import key_struct, with_buckets

# Block rule constants of the reference topology.
PRIORITY_BLOCK = 100
BLOCK_COOKIE = 0xDEAD
BLOCK_DST_COOKIE = 0xBEEF
BLOCK_IDLE_TIMEOUT = 60

# Dimension tables broadcast only up to this many rows (checked at plan time).
BROADCAST_ROW_LIMIT = 100_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only when it is proven small (<= ``limit`` rows).

    The count runs one cheap job over a dimension table; above the limit the
    plain DataFrame is returned and AQE chooses the join at run time.
    """
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def with_dst_aggregates(flows: DataFrame, agg: DataFrame, poll: str = "poll_ts") -> DataFrame:
    """J1 + A3: attach per-(poll, destination) aggregates to every flow of the
    poll (0 when there is none) and derive the live flow-creation rate:
    ``flows_to_dst / duration`` when duration > 0, else ``flows_to_dst``.

    Sort-merge (or AQE-chosen broadcast) equi-join on (poll, dst); a hot
    destination's partition is split by AQE skew-join handling.
    """
    j = flows.join(agg, [poll, "dst_ip"], "left")
    ftd = F.coalesce(F.col("flows_to_dst"), F.lit(0)).cast("bigint")
    usd = F.coalesce(F.col("unique_sources_to_dst"), F.lit(0)).cast("bigint")
    dur = F.col("duration_sec")
    return j.withColumns({
        "flows_to_dst": ftd,
        "unique_sources_to_dst": usd,
        "flow_creation_rate": F.when(dur > 0, ftd / dur).otherwise(ftd.cast("double")),
    })


def spoof_verdict(det: DataFrame, agg: DataFrame | None = None, poll: str = "poll_ts",
                  min_sources: int = 10, min_flows: int = 15) -> DataFrame:
    """A detection is a spoofed-source flood when its destination has at
    least ``min_sources`` distinct sources and ``min_flows`` flows in the poll.
    Spoofed detections are blocked by destination (scope 'dst', source '*')."""
    if agg is not None:
        det = (det.drop("flows_to_dst", "unique_sources_to_dst")
                  .join(agg, [poll, "dst_ip"], "left")
                  .withColumn("flows_to_dst", F.coalesce("flows_to_dst", F.lit(0)).cast("bigint"))
                  .withColumn("unique_sources_to_dst",
                              F.coalesce("unique_sources_to_dst", F.lit(0)).cast("bigint")))
    spoof = (F.col("unique_sources_to_dst") >= min_sources) & (F.col("flows_to_dst") >= min_flows)
    return det.withColumns({
        "is_spoofed": spoof,
        "block_scope": F.when(spoof, F.lit("dst")).otherwise(F.lit("src")),
        "block_src": F.when(spoof, F.lit("*")).otherwise(F.col("src_ip")),
    })


def drop_rules(blocks: DataFrame, switches: DataFrame) -> DataFrame:
    """One drop rule per new block per switch, leaf switches first.

    Source-scoped blocks match (src, dst, proto) with cookie 0xDEAD;
    destination-scoped blocks match (dst, proto) with cookie 0xBEEF. The
    protocol joins the match only when > 0. Invalid addresses give no rules.
    The switch table is a fixed-size dimension: broadcast after a size check.
    """
    sw = checked_broadcast(switches.select("dpid", "role"))
    is_src = F.col("block_scope") == "src"
    ok = F.when(is_src, valid_ipv4("src_ip") & (F.col("dst_ip").isNull() | valid_ipv4("dst_ip"))) \
          .otherwise(valid_ipv4("dst_ip"))
    b = blocks.filter(ok)
    return (b.crossJoin(sw)
             .select(
                 *[c for c in blocks.columns],
                 F.col("dpid").alias("rule_dpid"),
                 F.when(F.col("role") == "leaf", 0).otherwise(1).alias("install_order"),
                 F.lit(PRIORITY_BLOCK).alias("rule_priority"),
                 F.when(is_src, F.lit(BLOCK_COOKIE)).otherwise(F.lit(BLOCK_DST_COOKIE)).alias("cookie"),
                 F.when(is_src, F.col("src_ip")).alias("match_ipv4_src"),
                 F.col("dst_ip").alias("match_ipv4_dst"),
                 F.when(F.col("ip_proto") > 0, F.col("ip_proto")).alias("match_ip_proto"),
                 F.col("timeout_sec").alias("hard_timeout"),
                 F.lit(BLOCK_IDLE_TIMEOUT).alias("idle_timeout"),
             ))


def asof_lookup(probes: DataFrame, facts: DataFrame, keys: list[str], ts: str,
                value_cols: list[str], tolerance_sec: float | None = None,
                bucket_sec: float | None = None, part_rows: int | None = None) -> DataFrame:
    """For each probe, the newest fact of the same key at or before the
    probe time (facts win ties); a miss when that fact is older than
    ``tolerance_sec``. Adds ``fact_ts``, ``age_sec`` and the ``value_cols``.

    No as-of join exists in the public API. Probes and facts are unioned and
    scanned in time order with ``last(ignorenulls)``. To keep a hot key from
    landing in one task the scan is partitioned by (key, time bucket); the
    newest fact of all *earlier* buckets comes from a small per-(key, bucket)
    table (one row per bucket, scanned by key) and fills probes whose own
    bucket has no earlier fact. Exact for any bucket width.

    Of facts of one key and time the one with the greatest values counts, compared
    in the order of ``value_cols`` (put a row id first to let it decide), however
    the input is partitioned.
    """
    bsec = float(bucket_sec or tolerance_sec or 3600.0)
    fact_struct = F.struct(F.col(ts).alias("fact_ts"), *[F.col(c) for c in value_cols])
    f = facts.select(key_struct(keys).alias("__kk"), F.col(ts).alias("__t"), F.lit(0).alias("__kind"), fact_struct.alias("__fact"))
    p = probes.select(key_struct(keys).alias("__kk"), F.col(ts).alias("__t"), F.lit(1).alias("__kind"),
                      F.struct(*[F.col(c) for c in probes.columns]).alias("__probe"))
    u = with_buckets(f.unionByName(p, allowMissingColumns=True), "__t", bsec, part_rows)

    # newest fact per (key, bucket), carried to later buckets of the key
    wb = Window.partitionBy("__kk").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (u.groupBy("__kk", "__b").agg(F.max("__fact").alias("__bl"))
              .withColumn("__carry", F.last("__bl", ignorenulls=True).over(wb))
              .select("__kk", "__b", "__carry"))

    w = (Window.partitionBy("__kk", "__b").orderBy("__t", "__kind", "__fact")
               .rowsBetween(Window.unboundedPreceding, 0))
    scanned = (u.withColumn("__in", F.last("__fact", ignorenulls=True).over(w))
                .filter(F.col("__kind") == 1))
    j = scanned.join(carry, ["__kk", "__b"], "left")
    fact = F.coalesce(F.col("__in"), F.col("__carry"))
    out = j.select(F.col("__probe.*"), fact.alias("__f"))
    age = (F.unix_micros(F.col(ts).cast("timestamp")) -
           F.unix_micros(F.col("__f.fact_ts").cast("timestamp"))) / 1e6
    hit = F.col("__f").isNotNull()
    if tolerance_sec is not None:
        hit = hit & (age <= tolerance_sec)
    cols = [F.when(hit, F.col("__f.fact_ts")).alias("fact_ts"), F.when(hit, age).alias("age_sec")]
    cols += [F.when(hit, F.col(f"__f.{c}")).alias(c) for c in value_cols]
    return out.select(*[F.col(c) for c in probes.columns], *cols)


# Host-port source allow list of the reference topology
# (dpid, port, allowed ip, mask).
ALLOWED_SOURCES = [
    (3, 1, "10.0.0.1", "255.255.255.255"),
    (3, 2, "10.0.0.2", "255.255.255.255"),
    (3, 3, "10.0.0.3", "255.255.255.255"),
    (4, 1, "10.0.0.4", "255.255.255.255"),
    (4, 2, "10.0.0.5", "255.255.255.255"),
    (4, 3, "10.0.0.6", "255.255.255.255"),
    (4, 4, "10.0.0.7", "255.255.255.255"),
    (5, 1, "10.0.0.8", "255.255.255.255"),
    (5, 2, "10.0.0.9", "255.255.255.255"),
    (5, 3, "10.0.0.10", "255.255.255.255"),
]


def allowed_sources_df(spark) -> DataFrame:
    return spark.createDataFrame(ALLOWED_SOURCES, "dpid INT, port INT, ip STRING, mask STRING")


def antispoof(events: DataFrame, allow: DataFrame, src: str = "src_ip",
              port: str = "in_port") -> DataFrame:
    """Ingress source check. A (switch, port) with an allow entry passes a
    packet only when ``src & mask == ip & mask``; ports without an entry pass
    unchecked. Adds ``spoof_ok``. The allow list is a size-checked broadcast."""
    a = checked_broadcast(allow.select(
        F.col("dpid").alias("__a_dpid"), F.col("port").alias("__a_port"),
        ip_to_long("ip").alias("__a_ip"), ip_to_long("mask").alias("__a_mask")))
    j = events.join(a, (F.col("dpid") == F.col("__a_dpid")) & (F.col(port) == F.col("__a_port")), "left")
    s = ip_to_long(src)
    ok = F.when(F.col("__a_dpid").isNull(), F.lit(True)).otherwise(
        F.coalesce(F.col("__a_ip").bitwiseAND(F.col("__a_mask")) == s.bitwiseAND(F.col("__a_mask")),
                   F.lit(False)))
    return j.withColumn("spoof_ok", ok).drop("__a_dpid", "__a_port", "__a_ip", "__a_mask")


def suppressed_by(det: DataFrame, blocks: DataFrame, keys: list[str], ts: str = "ts",
                  start: str = "start_ts", expiry: str = "expiry_ts") -> DataFrame:
    """Rows that fall inside an open block of their key (``start <= ts <
    expiry``). Blocks of a key may overlap, as restored ones do. Every block is
    given the latest expiry of the key's blocks that start no later; a row is
    inside some block just when it lies before that of the newest block started at
    or before it: an as-of lookup, then one test — no (row x block) pairs are
    formed. Blocks without a start or an expiry suppress nothing."""
    from netsieve.operators._split import split_running
    b = blocks.select(*keys, F.col(start).alias(ts), F.col(expiry).alias("__own")).where(F.col(ts).isNotNull() & F.col("__own").isNotNull())
    b = split_running(b, keys, [ts, "__own"], maxes={"__exp": F.col("__own")}, bucket_sec=86400.0)
    x = asof_lookup(det, b, keys, ts, ["__exp"])
    return x.filter(F.col("__exp").isNotNull() & (F.col(ts) < F.col("__exp"))) \
            .drop("__exp", "fact_ts", "age_sec")


def unblock(rules: DataFrame, ips: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Drop source rules (0xDEAD) whose source is unblocked and destination
    rules (0xBEEF) whose destination is unblocked; two anti joins, no OR join."""
    i = ips.select(F.col(ip_col).alias("__ip")).distinct()
    src_rules = rules.filter(F.col("cookie") == BLOCK_COOKIE) \
        .join(i, F.col("match_ipv4_src") == F.col("__ip"), "left_anti")
    dst_rules = rules.filter(F.col("cookie") == BLOCK_DST_COOKIE) \
        .join(i, F.col("match_ipv4_dst") == F.col("__ip"), "left_anti")
    other = rules.filter(~F.col("cookie").isin(BLOCK_COOKIE, BLOCK_DST_COOKIE) | F.col("cookie").isNull())
    return src_rules.unionByName(dst_rules).unionByName(other)
