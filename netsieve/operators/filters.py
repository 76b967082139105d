"""Row predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LLDP_ETHERTYPE = 0x88CC
ARP_ETHERTYPE = 0x0806
IPV4_ETHERTYPE = 0x0800


def eligible_flows(df: DataFrame) -> DataFrame:
    """drop table-miss (priority 0) rows, rows whose source and destination
    are both unknown, and rows with a negative counter. Pushed to the scan."""
    return df.filter(
        (F.col("priority") != 0)
        & (F.col("src_ip").isNotNull() | F.col("dst_ip").isNotNull())
        & (F.col("duration_sec") >= 0) & (F.col("packet_count") >= 0)
        & (F.col("byte_count") >= 0))


def classify_frames(df: DataFrame) -> DataFrame:
    """drop link-discovery frames; mark ARP frames for the ARP path."""
    return (df.filter(F.col("ethertype") != LLDP_ETHERTYPE)
              .withColumn("frame_kind",
                          F.when(F.col("ethertype") == ARP_ETHERTYPE, F.lit("arp"))
                           .when(F.col("ethertype") == IPV4_ETHERTYPE, F.lit("ipv4"))
                           .otherwise(F.lit("other"))))


def detections(df: DataFrame, threshold: float = 0.7, prob: str = "attack_prob") -> DataFrame:
    """attack probability at or above the threshold with a known source."""
    return df.filter((F.col(prob) >= threshold) & F.col("src_ip").isNotNull())


def active_blocks(df: DataFrame, now, expiry: str = "expiry_ts") -> DataFrame:
    """blocks still in force at ``now`` (expiry strictly after now)."""
    return df.filter(F.col(expiry) > F.lit(now))


def expired_blocks(df: DataFrame, now, expiry: str = "expiry_ts") -> DataFrame:
    """blocks the cleanup pass removes (now >= expiry)."""
    return df.filter(F.col(expiry) <= F.lit(now))
