"""Aggregations.

All of these are hash aggregates with a map-side partial step, so a hot group
(one destination holding a third of all rows) is pre-combined inside every
task before the shuffle and never gathered into one task as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.schema import FEATURE_NAMES, LEAF_DPIDS


def dst_aggregates(df: DataFrame, poll: str = "poll_ts",
                   leaf_dpids: list[int] | None = None) -> DataFrame:
    """A1: per (poll, destination): flow rows and distinct known sources,
    counted on leaf switches only and for known destinations only.

    ``count(DISTINCT src_ip)`` is planned by Catalyst as a two-level aggregate:
    first deduplicated on (poll, dst, src) — spread across tasks even for one
    hot destination — then counted per (poll, dst) from partial counts.
    """
    leaf = leaf_dpids or LEAF_DPIDS
    return (df.filter(F.col("dpid").isin(leaf) & F.col("dst_ip").isNotNull())
              .groupBy(poll, "dst_ip")
              .agg(F.count(F.lit(1)).alias("flows_to_dst"),
                   F.countDistinct("src_ip").alias("unique_sources_to_dst")))


def dst_aggregates_global(df: DataFrame, dst: str | None = "dst_ip",
                          src: str | None = "src_ip") -> DataFrame:
    """A2: dataset-wide count and distinct sources per destination attached to
    each row. Without a destination column both are 1; rows with a null
    destination drop out. Aggregate then join back (distinct windows are refused)."""
    if dst is None or dst not in df.columns:
        return (df.withColumn("flows_to_dst", F.lit(1).cast("bigint"))
                  .withColumn("unique_sources_to_dst", F.lit(1).cast("bigint")))
    d = df.filter(F.col(dst).isNotNull())
    if src is None or src not in df.columns:
        agg = d.groupBy(dst).agg(F.count(F.lit(1)).alias("flows_to_dst"))
        return d.join(agg, dst, "inner").withColumn("unique_sources_to_dst", F.lit(1).cast("bigint"))
    agg = d.groupBy(dst).agg(F.count(F.lit(1)).alias("flows_to_dst"),
                             F.countDistinct(src).alias("unique_sources_to_dst"))
    return d.join(agg, dst, "inner")


def attack_summary(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A4: total, first, last, duration in seconds (1 decimal), distinct
    sources and destinations, in one aggregate."""
    first, last = F.min(ts), F.max(ts)
    secs = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.date_format(first, "yyyy-MM-dd HH:mm:ss").alias("first_attack"),
        F.date_format(last, "yyyy-MM-dd HH:mm:ss").alias("last_attack"),
        F.round(secs, 1).alias("duration_sec"),
        F.countDistinct("src_ip").alias("unique_sources"),
        F.countDistinct("dst_ip").alias("unique_destinations"),
    )


ATTACK_DIMS = ["attack_type", "src_ip", "dst_ip", "switch", "action"]


def attack_counts(df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """A5: counts per value of each dimension, with the percent of the total,
    for all dimensions in one pass (grouping sets). A dimension the log lacks
    yields no rows (older logs carry ``switch``, newer ``switches_blocked``)."""
    dims = [d for d in (dims or ATTACK_DIMS)]
    cols = list(df.columns)
    if "switch" in dims and "switch" not in cols and "switches_blocked" in cols:
        df = df.withColumn("switch", F.col("switches_blocked").cast("string"))
        cols.append("switch")
    present = [d for d in dims if d in cols]
    base = df.select(*[F.col(d).cast("string").alias(d) for d in present])
    sets = [[F.col(d)] for d in present]
    g = base.groupingSets(sets, *[F.col(d) for d in present]).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.grouping(d).alias(f"__g_{d}") for d in present])
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("string")
    for d in present:
        dim = F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(dim)
        val = F.when(F.col(f"__g_{d}") == 0, F.col(d)).otherwise(val)
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    out = g.select(dim.alias("dimension"), val.alias("value"), "count")
    # one-row total, broadcast: its size is fixed at one row
    out = out.crossJoin(F.broadcast(total))
    return out.select("dimension", "value", "count",
                      F.round(F.col("count") * 100.0 / F.col("__total"), 1).alias("percent"))


def rate_stats(df: DataFrame, col: str = "packet_rate") -> DataFrame:
    """mean/max/min of the numeric packet rates (text that is not a number
    is ignored), 2 decimals, 0 when there are none."""
    r = F.col(col).cast("string").try_cast("double")
    r = F.when(~F.isnan(r), r)
    return df.agg(
        F.coalesce(F.round(F.avg(r), 2), F.lit(0.0)).alias("avg_packet_rate"),
        F.coalesce(F.round(F.max(r), 2), F.lit(0.0)).alias("max_packet_rate"),
        F.coalesce(F.round(F.min(r), 2), F.lit(0.0)).alias("min_packet_rate"),
    )


def perf_summary(df: DataFrame) -> DataFrame:
    """Performance-log summary. Absent columns give 0. The attack column is
    cumulative in the monitor, yet the summary sums it (kept as ``sum_attacks``);
    ``attacks_span`` = max - min is the count the summary means."""
    cols = set(df.columns)

    def num(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    def stat(c, fn, nd, name):
        if c not in cols:
            return F.lit(0.0).alias(name)
        return F.coalesce(F.round(fn(num(c)), nd), F.lit(0.0)).alias(name)

    aggs = [
        stat("cpu_percent", F.avg, 2, "avg_cpu"), stat("cpu_percent", F.max, 2, "peak_cpu"),
        stat("cpu_percent", F.min, 2, "min_cpu"),
        stat("memory_mb", F.avg, 2, "avg_memory"), stat("memory_mb", F.max, 2, "peak_memory"),
        stat("active_flows", F.avg, 1, "avg_flows"),
        (F.coalesce(F.max(F.col("active_flows").cast("bigint")), F.lit(0)).cast("bigint")
         if "active_flows" in cols else F.lit(0).cast("bigint")).alias("peak_flows"),
        stat("avg_latency_ms", F.avg, 2, "avg_latency"),
        stat("avg_latency_ms", F.max, 2, "peak_latency"),
    ]
    if "attacks_detected" in cols:
        a = F.col("attacks_detected").cast("bigint")
        aggs += [F.coalesce(F.sum(a), F.lit(0)).cast("bigint").alias("sum_attacks"),
                 F.coalesce(F.max(a) - F.min(a), F.lit(0)).cast("bigint").alias("attacks_span")]
    else:
        aggs += [F.lit(0).cast("bigint").alias("sum_attacks"),
                 F.lit(0).cast("bigint").alias("attacks_span")]
    aggs.append(F.count(F.lit(1)).alias("total_records"))
    return df.agg(*aggs)


_MONITOR_METRICS = ["cpu_percent", "memory_mb", "active_flows", "avg_latency_ms"]


def monitor_summary(df: DataFrame, key: str | None = None, ts: str = "ts") -> DataFrame:
    """Per monitor session: avg/peak/min per metric (2 decimals), attacks
    max and max-min, first/last sample time."""
    aggs = []
    for m in _MONITOR_METRICS:
        aggs += [F.round(F.avg(m), 2).alias(f"avg_{m}"),
                 F.round(F.max(m), 2).cast("double").alias(f"peak_{m}"),
                 F.round(F.min(m), 2).cast("double").alias(f"min_{m}")]
    aggs += [F.max("attacks_detected").alias("attacks_max"),
             (F.max("attacks_detected") - F.min("attacks_detected")).alias("attacks_in_session"),
             F.min(ts).alias("first_sample"), F.max(ts).alias("last_sample"),
             F.count(F.lit(1)).alias("samples")]
    return df.groupBy(key).agg(*aggs) if key else df.agg(*aggs)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Total, normal, attack counts and percents (1 decimal)."""
    n = F.count(F.lit(1))
    normal = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    attack = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return df.agg(n.alias("total"), normal.cast("bigint").alias("normal"),
                  attack.cast("bigint").alias("attack"),
                  F.round(normal * 100.0 / n, 1).alias("normal_pct"),
                  F.round(attack * 100.0 / n, 1).alias("attack_pct"))


# Protocol names in the distribution report.
PROTO_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP"}


def proto_distribution(df: DataFrame, proto: str = "ip_proto") -> DataFrame:
    """A10: ICMP/TCP/UDP counts with percent of all rows; empty groups omitted."""
    name = F.lit(None).cast("string")
    for num, nm in PROTO_NAMES.items():
        name = F.when(F.col(proto) == num, F.lit(nm)).otherwise(name)
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    g = (df.select(name.alias("protocol")).filter(F.col("protocol").isNotNull())
           .groupBy("protocol").agg(F.count(F.lit(1)).alias("count")))
    return (g.crossJoin(F.broadcast(total))
             .select("protocol", "count",
                     F.round(F.col("count") * 100.0 / F.col("__total"), 1).alias("percent")))


KEY_FEATURES = ["packet_count_per_second", "byte_count_per_second", "avg_packet_size",
                "flows_to_dst", "unique_sources_to_dst", "flow_creation_rate"]


def class_feature_means(df: DataFrame, features: list[str] | None = None,
                        label: str = "label") -> DataFrame:
    """Per feature, mean for normal and attack rows and attack/normal
    ratio (Inf when the normal mean is 0). One aggregate, then unpivot."""
    feats = features or KEY_FEATURES
    aggs = []
    for f in feats:
        aggs += [F.avg(F.when(F.col(label) == 0, F.col(f))).alias(f"n__{f}"),
                 F.avg(F.when(F.col(label) == 1, F.col(f))).alias(f"a__{f}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                        F.col(f"n__{f}").alias("normal_mean"),
                                        F.col(f"a__{f}").alias("attack_mean")) for f in feats]))
    long = wide.select(rows.alias("r")).select("r.*")
    ratio = F.when(F.col("normal_mean") == 0, F.lit(float("inf"))) \
             .otherwise(F.col("attack_mean") / F.col("normal_mean"))
    return long.withColumn("ratio", ratio)


def dataset_report(df: DataFrame, label: str = "label",
                   expected=(65.0, 35.0), tolerance: float = 1.0) -> DataFrame:
    """Validation checks as (check, status, value) rows, from one aggregate."""
    feats = [c for c in FEATURE_NAMES if c in df.columns]
    cols_ok = list(df.columns) == FEATURE_NAMES + [label]
    dbl = {c for c, t in df.dtypes if t in ("double", "float")}
    nulls = sum([F.sum(F.when(F.col(c).isNull() | (F.isnan(F.col(c)) if c in dbl else F.lit(False)), 1)
                       .otherwise(0)) for c in df.columns], F.lit(0))
    infs = sum([F.sum(F.when(F.abs(F.col(c)) == float("inf"), 1).otherwise(0))
                for c in feats if c in dbl], F.lit(0))
    negs = sum([F.sum(F.when(F.col(c) < 0, 1).otherwise(0)) for c in ("packet_count", "byte_count") if c in feats], F.lit(0))
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        nulls.cast("bigint").alias("nulls"), infs.cast("bigint").alias("infs"),
        negs.cast("bigint").alias("negatives"),
        F.countDistinct(F.col(label)).alias("n_labels"),
        F.sum(F.when(F.col(label).isin(0, 1), 0).otherwise(1)).alias("bad_labels"),
        (F.sum(F.when(F.col(label) == 0, 1).otherwise(0)) * 100.0 / F.count(F.lit(1))).alias("normal_pct"),
    )
    st = lambda ok: F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL"))
    lab_ok = (F.col("bad_labels") == 0) & (F.col("n_labels") == 2)  # exactly 0 and 1
    share_ok = F.abs(F.col("normal_pct") - F.lit(expected[0])) <= tolerance
    def chk(name, status, value):
        return F.struct(F.lit(name).alias("check"), status.alias("status"),
                        value.cast("string").alias("value"))

    checks = F.array(
        chk("columns", st(F.lit(cols_ok)), F.lit(str(len(df.columns)))),
        chk("nulls", st(F.col("nulls") == 0), F.col("nulls")),
        chk("infs", st(F.col("infs") == 0), F.col("infs")),
        chk("labels", st(lab_ok), F.format_string("%d distinct, %d outside {0,1}", F.col("n_labels"),
                                                   F.col("bad_labels"))),
        chk("class_balance", F.when(share_ok, F.lit("PASS")).otherwise(F.lit("WARN")),
            F.format_number(F.col("normal_pct"), 1)),
        chk("negatives", st(F.col("negatives") == 0), F.col("negatives")),
    )
    return one.select(F.explode(checks).alias("c")).select(
        F.col("c.check").alias("check"), F.col("c.status").alias("status"),
        F.col("c.value").alias("value"))


def table_usage(df: DataFrame, default_max: int = 2000,
                warning: float = 0.80, critical: float = 0.95,
                keep: list[str] | None = None) -> DataFrame:
    """Flow-table 0 usage per switch; max <= 0 means the default size."""
    mx = F.when(F.col("max_entries") <= 0, F.lit(default_max)).otherwise(F.col("max_entries"))
    u = F.col("active_count") / mx
    return (df.filter(F.col("table_id") == 0)
              .select(*(keep or []), "dpid", F.col("active_count"), mx.cast("bigint").alias("max_entries"),
                      u.alias("usage"),
                      F.when(u >= critical, F.lit("critical"))
                       .when(u >= warning, F.lit("warning")).otherwise(F.lit("ok")).alias("level")))


def eviction_candidates(entries: DataFrame, usage: DataFrame,
                        keys: list[str] | None = None) -> DataFrame:
    """Forwarding entries (0 < priority <= 10) on critical switches; block
    rules (higher priority) are never candidates. Semi join on the switch."""
    keys = keys or ["dpid"]
    crit = usage.filter(F.col("level") == "critical").select(*keys)
    return (entries.filter((F.col("priority") > 0) & (F.col("priority") <= 10))
                   .join(crit, keys, "left_semi"))


def health(polls: DataFrame, blocks: DataFrame, bucket_sec: int = 86400,
           poll_ts: str = "ts", model_ok: bool = True, models: DataFrame | None = None) -> DataFrame:
    """Per cycle bucket with a poll: switches that answered, blocks in force
    at the bucket's end, and the model flag.

    A block is in force at boundary E when start < E < expiry. A block adds one at
    the first boundary after its start and takes it away at the first at or after
    its expiry; the running sum of both over time is the count, so a block costs two
    rows however many buckets it spans. Blocks without a start or an expiry are never
    in force. ``models`` (``ts``, ``event_id``, ``loaded``) holds the states of the
    model: the flag is the newest at or before the boundary (the greatest event_id of
    one time), false before the first. Without the table it is ``model_ok``."""
    from netsieve.operators._split import split_running
    from netsieve.operators.joins import asof_lookup

    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    b_us = bucket_sec * 1_000_000
    p = (polls.select(F.floor(us(poll_ts) / b_us).cast("bigint").alias("bucket"), "dpid")
              .groupBy("bucket").agg(F.countDistinct("dpid").alias("switches_seen")).where("bucket IS NOT NULL"))
    # the bucket that ends at boundary n is bucket n - 1
    opens = F.floor(us("start_ts") / b_us).cast("bigint")
    closes = F.ceil(us("expiry_ts") / b_us).cast("bigint") - 1
    steps = (blocks.select(opens.alias("f"), closes.alias("l")).where("l > f")
                   .select(F.explode(F.array(F.struct(F.col("f").alias("bucket"), F.lit(1).alias("step")),
                                             F.struct(F.col("l").alias("bucket"), F.lit(-1).alias("step")))).alias("x"))
                   .groupBy("x.bucket").agg(F.sum("x.step").alias("step")))
    line = p.join(steps, "bucket", "full").select("*", F.timestamp_micros(F.col("bucket") * b_us).alias("bucket_start"), F.lit(0).alias("__line"))
    line = split_running(line, ["__line"], ["bucket_start"], sums={"active_blocks": F.coalesce("step", F.lit(0))},
                         bucket_sec=max(bucket_sec, 86400))
    out = line.where(F.col("switches_seen").isNotNull()).select("bucket_start", "switches_seen", F.col("active_blocks").cast("bigint").alias("active_blocks"))
    if models is None:
        return out.withColumn("model_loaded", F.lit(model_ok))
    ends = out.select("*", F.lit(0).alias("__line"), (F.unix_micros("bucket_start") + b_us).alias("__us")).withColumn("__end", F.timestamp_micros("__us"))
    states = models.select(F.lit(0).alias("__line"), F.col("ts").cast("timestamp").alias("__end"), "event_id", "loaded").where("__end IS NOT NULL")
    x = asof_lookup(ends, states, ["__line"], "__end", ["event_id", "loaded"])
    return x.select(*out.columns, F.coalesce("loaded", F.lit(False)).alias("model_loaded"))


def drift_signal(df: DataFrame, poll: str = "poll_ts", prob: str = "attack_prob") -> DataFrame:
    """Mean attack probability per batch."""
    return df.groupBy(poll).agg(F.avg(prob).alias("mean_attack_prob"),
                                F.count(F.lit(1)).alias("n"))


def history_summary(df: DataFrame) -> DataFrame:
    """Attack runs and total seconds per (type, status)."""
    return df.groupBy("type", "status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("duration_sec"), F.lit(0)).cast("bigint").alias("total_sec"))
