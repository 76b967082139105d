"""Detectors: threshold fallback (M10), fast path (M11), guarded scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PPS_THRESHOLD = 10_000
BPS_THRESHOLD = 50_000_000


def threshold_detect(df: DataFrame, pps_threshold: float = PPS_THRESHOLD,
                     bps_threshold: float = BPS_THRESHOLD,
                     pps: str = "packet_count_per_second",
                     bps: str = "byte_count_per_second") -> DataFrame:
    """Attack iff pps > threshold or bps > threshold (strict), on raw
    (unscaled) rates. ``attack_prob`` is 0.5 for attacks and 0.1 otherwise."""
    hit = (F.col(pps) > pps_threshold) | (F.col(bps) > bps_threshold)
    hit = F.coalesce(hit, F.lit(False))
    return df.withColumns({"is_attack": hit,
                           "attack_prob": F.when(hit, F.lit(0.5)).otherwise(F.lit(0.1))})


def fast_path(df: DataFrame, pps_threshold: float = PPS_THRESHOLD, bps_threshold: float = BPS_THRESHOLD) -> DataFrame:
    """Rows the thresholds already catch skip model scoring. Adds ``caught``,
    so that both kinds come from one pass over the input."""
    t = threshold_detect(df, pps_threshold, bps_threshold)
    return t.withColumnRenamed("is_attack", "caught").drop("attack_prob")
