"""Per-row feature projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.schema import FEATURE_NAMES

# Aggregate feature columns; absent ones default to 0.
_AGG_DEFAULTS = {"flows_to_dst": "bigint", "unique_sources_to_dst": "bigint",
                 "flow_creation_rate": "double"}


def _num(df: DataFrame, name: str, typ: str) -> Column:
    """Column if present (nulls -> 0), else a typed 0: 'missing inputs are 0'."""
    if name in df.columns:
        return F.coalesce(F.col(name).cast(typ), F.lit(0).cast(typ))
    return F.lit(0).cast(typ)


def _base(df: DataFrame):
    dur_name = "duration_sec" if "duration_sec" in df.columns else "flow_duration_sec"
    dur = _num(df, dur_name, "double")
    pkts = _num(df, "packet_count", "bigint")
    byts = _num(df, "byte_count", "bigint")
    return dur, pkts, byts


def _assemble(df: DataFrame, dur, pkts, byts, pps, bps, keep: list[str]) -> DataFrame:
    avg = F.when(pkts > 0, byts / pkts).otherwise(F.lit(0.0))
    cols = [F.col(c) for c in keep] + [
        dur.alias("flow_duration_sec"),
        pkts.alias("packet_count"),
        byts.alias("byte_count"),
        pps.cast("double").alias("packet_count_per_second"),
        bps.cast("double").alias("byte_count_per_second"),
        avg.cast("double").alias("avg_packet_size"),
        _num(df, "ip_proto", "int").alias("ip_proto"),
        _num(df, "icmp_code", "int").alias("icmp_code"),
        _num(df, "icmp_type", "int").alias("icmp_type"),
    ] + [_num(df, n, t).alias(n) for n, t in _AGG_DEFAULTS.items()]
    return df.select(*cols)


def offline_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rates over duration; a zero duration gives the raw counts."""
    dur, pkts, byts = _base(df)
    pps = F.when(dur > 0, pkts / dur).otherwise(pkts)
    bps = F.when(dur > 0, byts / dur).otherwise(byts)
    return _assemble(df, dur, pkts, byts, pps, bps, keep or [])


def live_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """As P1, but a zero duration gives rate 0."""
    dur, pkts, byts = _base(df)
    pps = F.when(dur > 0, pkts / dur).otherwise(F.lit(0.0))
    bps = F.when(dur > 0, byts / dur).otherwise(F.lit(0.0))
    return _assemble(df, dur, pkts, byts, pps, bps, keep or [])


def clamped_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adapter rule, duration floored at 0.001 s and packets at 1 for the average."""
    dur, pkts, byts = _base(df)
    d = F.greatest(dur, F.lit(0.001))
    pps = pkts / d
    bps = byts / d
    out = _assemble(df, dur, pkts, byts, pps, bps, keep or [])
    return out.withColumn("avg_packet_size", (byts / F.greatest(pkts, F.lit(1))).cast("double"))


def delta_rate_features(df: DataFrame, key: list[str], order: list[str],
                        window_sec: float = 5.0, keep: list[str] | None = None) -> DataFrame:
    """With a previous snapshot of the same flow and ``window_sec > 0``, rates are
    ``max(0, cur - prev) / window_sec``; otherwise the live rule (P2) applies.

    The previous snapshot is the prior row of the flow key by ``order``
    (first order column: the timestamp), found by the split keyed scan so a
    hot flow key stays parallel.
    """
    from netsieve.operators._split import split_lag
    df = split_lag(df, key, order, ["packet_count", "byte_count"], 1)
    prev_p = F.col("prev1")["packet_count"]
    prev_b = F.col("prev1")["byte_count"]
    dur, pkts, byts = _base(df)
    has_prev = prev_p.isNotNull() & F.lit(window_sec > 0)
    pps = F.when(has_prev, F.greatest(F.lit(0), pkts - prev_p) / F.lit(float(window_sec))) \
           .when(dur > 0, pkts / dur).otherwise(F.lit(0.0))
    bps = F.when(has_prev, F.greatest(F.lit(0), byts - prev_b) / F.lit(float(window_sec))) \
           .when(dur > 0, byts / dur).otherwise(F.lit(0.0))
    return _assemble(df, dur, pkts, byts, pps, bps, keep or [])


def clean_inf_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """+-Inf -> 0 in the feature columns, then drop rows with any null/NaN."""
    cols = cols or [c for c in FEATURE_NAMES if c in df.columns]
    dbl = {c for c, t in df.dtypes if t in ("double", "float")}
    out = df.select(*[
        (F.when(F.abs(F.col(c)) == float("inf"), F.lit(0.0)).otherwise(F.col(c)).alias(c)
         if c in cols and c in dbl else F.col(c)) for c in df.columns])
    return out.na.drop(how="any")


def clean_inf_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """+-Inf -> the column's finite maximum (both signs).

    One global aggregate row (partial per task, one tiny final merge) is
    cross-joined back; its size is one row whatever the input size.
    """
    finite = lambda c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    mx = df.agg(*[F.max(finite(c)).alias(f"__max_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(mx))
    for c in cols:
        out = out.withColumn(c, F.when(F.abs(F.col(c)) == float("inf"), F.col(f"__max_{c}"))
                             .otherwise(F.col(c)))
    return out.drop(*[f"__max_{c}" for c in cols])


def features_to_map(df: DataFrame) -> DataFrame:
    """The 12 features as one name -> value map column ``features``."""
    return df.withColumn("features", F.create_map(*[
        x for n in FEATURE_NAMES for x in (F.lit(n), F.col(n).cast("double"))]))


def assemble(df: DataFrame, output: str = "features_vec") -> DataFrame:
    """Dense feature vector in model order (Spark ML ``VectorAssembler``)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=FEATURE_NAMES, outputCol=output,
                           handleInvalid="keep").transform(df)


def icmp_fields(df: DataFrame, proto: str = "ip_proto") -> DataFrame:
    """ICMP type 8 when the protocol is 1, else 0; code always 0."""
    return (df.withColumn("icmp_type", F.when(F.col(proto) == 1, 8).otherwise(0).cast("int"))
              .withColumn("icmp_code", F.lit(0).cast("int")))


def estimate_latency(df: DataFrame, key: str, order: list[str],
                     attacks: str = "attacks_detected") -> DataFrame:
    """2650 ms when the attack counter rose since the key's previous sample,
    else 5000 ms. The previous sample comes from the split keyed scan (a
    monitor's samples are one key)."""
    from netsieve.operators._split import split_lag
    x = split_lag(df, [key], order, [attacks], 1)
    prev = F.col("prev1")[attacks]
    return x.withColumn("est_latency_ms",
                        F.when(prev.isNotNull() & (F.col(attacks) > prev), F.lit(2650.0))
                         .otherwise(F.lit(5000.0))).drop("prev1")


def validate_features(df: DataFrame) -> DataFrame:
    """P5: per row, the first failing rule as a message (NULL when valid).

    Rules in order: wrong column set, NaN values (count and names), Inf values
    (count and names).
    """
    missing = [c for c in FEATURE_NAMES if c not in df.columns]
    if missing:
        return df.withColumn("is_valid", F.lit(False)).withColumn(
            "error", F.lit(f"Missing features: {sorted(missing)}"))
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    vals = F.array(*[F.col(n).cast("double") for n in FEATURE_NAMES])
    z = F.arrays_zip(names.alias("n"), vals.alias("v"))
    nan = F.filter(z, lambda s: F.isnan(s["v"]) | s["v"].isNull())
    inf = F.filter(z, lambda s: F.abs(s["v"]) == float("inf"))
    nan_msg = F.format_string("%d NaN values in features: %s", F.size(nan),
                              F.array_join(F.transform(nan, lambda s: s["n"]), ", "))
    inf_msg = F.format_string("%d Inf values in features: %s", F.size(inf),
                              F.array_join(F.transform(inf, lambda s: s["n"]), ", "))
    err = F.when(F.size(nan) > 0, nan_msg).when(F.size(inf) > 0, inf_msg)
    return df.withColumn("error", err).withColumn("is_valid", err.isNull())
