"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical feature names, in model order.
FEATURE_NAMES = [
    "flow_duration_sec",
    "packet_count",
    "byte_count",
    "packet_count_per_second",
    "byte_count_per_second",
    "avg_packet_size",
    "ip_proto",
    "icmp_code",
    "icmp_type",
    "flows_to_dst",
    "unique_sources_to_dst",
    "flow_creation_rate",
]
LABEL = "label"

_FEATURE_TYPES = {
    "flow_duration_sec": T.DoubleType(),
    "packet_count": T.LongType(),
    "byte_count": T.LongType(),
    "packet_count_per_second": T.DoubleType(),
    "byte_count_per_second": T.DoubleType(),
    "avg_packet_size": T.DoubleType(),
    "ip_proto": T.IntegerType(),
    "icmp_code": T.IntegerType(),
    "icmp_type": T.IntegerType(),
    "flows_to_dst": T.LongType(),
    "unique_sources_to_dst": T.LongType(),
    "flow_creation_rate": T.DoubleType(),
}

# Canonical labelled flow row.
CANONICAL = T.StructType(
    [T.StructField(n, _FEATURE_TYPES[n], True) for n in FEATURE_NAMES]
    + [T.StructField(LABEL, T.IntegerType(), True)]
)

# D3: raw flow statistics, one row per flow per switch per poll.
FLOW_STATS = T.StructType([
    T.StructField("poll_ts", T.TimestampType(), True),
    T.StructField("dpid", T.IntegerType(), True),
    T.StructField("priority", T.IntegerType(), True),
    T.StructField("duration_sec", T.LongType(), True),
    T.StructField("packet_count", T.LongType(), True),
    T.StructField("byte_count", T.LongType(), True),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("ip_proto", T.IntegerType(), True),
    T.StructField("icmp_code", T.IntegerType(), True),
    T.StructField("icmp_type", T.IntegerType(), True),
])

# Attack log as written by the detector.
ATTACK_LOG = T.StructType([
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("attack_type", T.StringType(), True),
    T.StructField("packet_rate", T.StringType(), True),
    T.StructField("confidence", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
    T.StructField("switches_blocked", T.StringType(), True),
])

# Performance log.
PERF_LOG = T.StructType([
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("cpu_percent", T.StringType(), True),
    T.StructField("memory_mb", T.StringType(), True),
    T.StructField("active_flows", T.StringType(), True),
    T.StructField("attacks_detected", T.StringType(), True),
    T.StructField("avg_latency_ms", T.StringType(), True),
])

# Switch roles of the reference topology (1, 2 spine; 3, 4, 5 leaf).
SPINE_DPIDS = [1, 2]
LEAF_DPIDS = [3, 4, 5]


def switches_df(spark):
    """D12 switch-role table for the default topology."""
    rows = [(d, "spine") for d in SPINE_DPIDS] + [(d, "leaf") for d in LEAF_DPIDS]
    return spark.createDataFrame(rows, "dpid INT, role STRING")
