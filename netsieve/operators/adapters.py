"""Dataset adapters: raw public flow tables -> the canonical 12-feature row
(P5-P16, P20, P23, A2, W2 composed as DataFrame pipelines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.functions.network import proto_number
from netsieve.functions.timefmt import parse_ts
from netsieve.operators.aggregates import dst_aggregates_global
from netsieve.operators.features import clean_inf_max
from netsieve.operators.windows import arrival_rate
from netsieve.schema import CANONICAL, FEATURE_NAMES, LABEL

# CIC-IDS2017 columns coerced to numbers.
CIC2017_NUMERIC = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Protocol", "Flow Bytes/s", "Flow Packets/s",
]
# CIC-IDS2017 columns whose null drops the row.
CIC2017_CRITICAL = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Protocol",
]
# CIC-DDoS2019 column aliases, first present wins.
CIC2019_ALIASES = {
    "fwd_pkts": ["Total Fwd Packets", "Tot Fwd Pkts", "Fwd Packets"],
    "bwd_pkts": ["Total Backward Packets", "Tot Bwd Pkts", "Bwd Packets"],
    "fwd_len": ["Total Length of Fwd Packets", "TotLen Fwd Pkts", "Fwd Len"],
    "bwd_len": ["Total Length of Bwd Packets", "TotLen Bwd Pkts", "Bwd Len"],
    "duration": ["Flow Duration"],
    "proto": ["Protocol"],
    "dst": ["Destination IP", "Dst IP"],
    "src": ["Source IP", "Src IP"],
    "ts": ["Timestamp"],
}
# CIC-DDoS2019 text columns left as text.
CIC2019_TEXT = ["label", "source ip", "destination ip", "timestamp", "src ip", "dst ip"]
# UNSW-NB15 address column candidates (lower-case headers).
UNSW_DST = ["dstip", "dst_ip", "destination ip"]
UNSW_SRC = ["srcip", "src_ip", "source ip"]
# Column of the class label (P16); ``keep=[CLASS]`` puts it before the canonical ones.
CLASS = "attack_class"
# Label column candidates.
LABEL_CANDIDATES = ["Label", " Label", "label"]


def normalise_header(df: DataFrame, lower: bool = False) -> DataFrame:
    """Trim header names (and lower-case them for UNSW)."""
    names = [c.strip().lower() if lower else c.strip() for c in df.columns]
    return df.toDF(*names)


def pick(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate column present (plan-time schema lookup)."""
    for c in candidates:
        if c in df.columns:
            return c
    return None


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text -> DOUBLE, bad text -> NULL ('Infinity' stays +-Inf)."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in present})


def drop_critical_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """P10: drop rows null (or NaN) in the critical columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.na.drop(subset=present) if present else df


def cic_labels(df: DataFrame) -> tuple[Column, Column]:
    """P16 (CIC): binary = trimmed label != 'BENIGN', class = trimmed label."""
    col = pick(df, LABEL_CANDIDATES)
    if col is None:
        raise ValueError(f"none of {LABEL_CANDIDATES} is a column; the first columns are {df.columns[:10]}")
    cls = F.trim(F.col(col).cast("string"))
    return (cls != "BENIGN").cast("int"), cls


def unsw_labels(df: DataFrame) -> tuple[Column, Column]:
    """P16 (UNSW): binary from ``label`` (null -> 0), class from ``attack_cat``
    (null -> Normal), else Normal/Attack from the binary label."""
    lc = pick(df, ["label", "Label"])
    binary = F.coalesce(F.col(lc).cast("int"), F.lit(0)) if lc else F.lit(0)
    ac = pick(df, ["attack_cat", "Attack_cat", "attack_category"])
    cls = (F.trim(F.coalesce(F.col(ac).cast("string"), F.lit("Normal"))) if ac
           else F.when(binary == 1, F.lit("Attack")).otherwise(F.lit("Normal")))
    return binary, cls


INSTANT = "__instant"  # the parsed timestamp of a raw row


def _instant(df: DataFrame, ts: str) -> Column:
    """A raw timestamp column as an instant; text of no known layout is NULL."""
    is_ts = df.schema[ts].dataType.typeName().startswith("timestamp")
    return F.col(ts) if is_ts else parse_ts(F.col(ts).cast("string"))


def _finish(df: DataFrame, dst: str | None, src: str | None, ts: str | None, tie: str | None,
            keep: list[str]) -> DataFrame:
    """Shared tail: A2 aggregates, W2 creation rate, Inf -> 0, drop nulls,
    canonical types and order."""
    x = dst_aggregates_global(df, dst, src)
    if ts is not None and dst is not None:
        x = x.withColumn("__ts", _instant(x, ts))
        # rows whose timestamp does not parse get rate 0 (Q24: per row, not the
        # whole column); a stand-in instant keeps them in a scan group of their own
        x = x.withColumn("__bad_ts", F.col("__ts").isNull()) \
             .withColumn("__ts", F.coalesce(F.col("__ts"), F.lit("1970-01-01 00:00:00").cast("timestamp")))
        x = arrival_rate(x, dst, "__ts", tie, extra_key=["__bad_ts"])
        x = x.withColumn("flow_creation_rate",
                         F.when(F.col("__bad_ts"), F.lit(0.0)).otherwise(F.col("flow_creation_rate")))
        x = x.drop("__ts", "__bad_ts")
    else:
        x = x.withColumn("flow_creation_rate", F.lit(0.0))
    cols = []
    for f in CANONICAL.fields:
        c = F.col(f.name).cast(f.dataType)
        if f.dataType.typeName() == "double":
            c = F.when(F.abs(c) == float("inf"), F.lit(0.0)).otherwise(c)
        cols.append(c.alias(f.name))
    out = x.select(*[F.col(k) for k in keep], *cols)
    # the creation rate is never NULL nor NaN; tested here, the optimizer would move its
    # whole formula below the join and work it out many times for every row
    return out.na.drop(subset=[c for c in FEATURE_NAMES + [LABEL] if c != "flow_creation_rate"])


def _materialise_pruned(df: DataFrame, cols: list[str], ts: str | None = None) -> DataFrame:
    """Parse the raw text once: keep only the columns the mapping reads and
    checkpoint them (columnar) to the shared checkpoint folder; the
    aggregate, join and scan passes that follow read that copy. Timestamps in
    ``ts`` are parsed here too, into ``INSTANT``."""
    from netsieve.operators._prefix import _materialise
    keep = [F.col(c) for c in dict.fromkeys(cols) if c and c in df.columns]
    return _materialise(df.select(*keep, *([_instant(df, ts).alias(INSTANT)] if ts else [])))


def _base(df, dur_s: Column, pkts: Column, byts: Column, proto: Column) -> DataFrame:
    safe_d = F.greatest(dur_s, F.lit(0.001))
    return df.withColumns({
        "flow_duration_sec": dur_s,
        "packet_count": pkts,
        "byte_count": byts,
        "packet_count_per_second": pkts / safe_d,
        "byte_count_per_second": byts / safe_d,
        "avg_packet_size": byts / F.greatest(pkts, F.lit(1.0)),
        "ip_proto": proto,
        "icmp_code": F.lit(0),
        "icmp_type": F.when(proto == 1, 8).otherwise(0),
    })


def map_cic2017(df: DataFrame, tie: str | None = "Flow ID", keep: list[str] | None = None) -> DataFrame:
    """P23 CIC-IDS2017: coerce (P9), Inf -> column max (P8), drop critical
    nulls (P10), microseconds -> s, forward + backward sums (P13), clamped
    rates (P4), ICMP heuristic (P15), destination aggregates (A2),
    arrival rate (W2), labels (P16)."""
    x = coerce_numeric(df, CIC2017_NUMERIC)
    lab = pick(df, LABEL_CANDIDATES)
    ts = pick(x, ["Timestamp"])
    x = _materialise_pruned(x, CIC2017_NUMERIC + [lab, "Destination IP", "Source IP", tie] + (keep or []), ts)
    num = [c for c in CIC2017_NUMERIC if c in x.columns]
    x = clean_inf_max(x, num)
    x = drop_critical_nulls(x, CIC2017_CRITICAL)
    z = F.lit(0.0)
    pk = F.coalesce(F.col("Total Fwd Packets"), z) + F.coalesce(F.col("Total Backward Packets"), z)
    by = F.coalesce(F.col("Total Length of Fwd Packets"), z) + F.coalesce(F.col("Total Length of Bwd Packets"), z)
    x = _base(x, F.coalesce(F.col("Flow Duration"), z) / 1e6, pk, by,
              F.coalesce(F.col("Protocol"), z).cast("int"))
    binary, cls = cic_labels(x)
    x = x.withColumns({LABEL: binary, CLASS: cls})
    tie = tie if tie in df.columns else None
    return _finish(x, pick(x, ["Destination IP"]), pick(x, ["Source IP"]), INSTANT if ts else None,
                   tie or "Flow Duration", keep or [])


def map_cic2019(df: DataFrame, tie: str | None = "Flow ID", keep: list[str] | None = None) -> DataFrame:
    """P23 CIC-DDoS2019: every text column except label/address/time is
    coerced; aliases resolved (P12); otherwise as CIC-2017 (no critical drop)."""
    text = [c for c, t in df.dtypes if t == "string" and c.lower() not in CIC2019_TEXT and c != tie]
    x = coerce_numeric(df, text)
    used = [c for v in CIC2019_ALIASES.values() for c in v] + LABEL_CANDIDATES + [tie] + (keep or [])
    ts = pick(x, CIC2019_ALIASES["ts"])
    x = _materialise_pruned(x, used, ts)
    num = [c for c, t in x.dtypes if t in ("double", "float", "int", "bigint") and c != tie]
    x = clean_inf_max(x, num) if num else x
    col = {k: pick(x, v) for k, v in CIC2019_ALIASES.items()}
    z = F.lit(0.0)
    get = lambda k: F.coalesce(F.col(col[k]).cast("double"), z) if col[k] else z
    x = _base(x, get("duration") / 1e6, get("fwd_pkts") + get("bwd_pkts"),
              get("fwd_len") + get("bwd_len"), get("proto").cast("int"))
    binary, cls = cic_labels(x)
    x = x.withColumns({LABEL: binary, CLASS: cls})
    tie = tie if tie in df.columns else None
    return _finish(x, col["dst"], col["src"], INSTANT if ts else None, tie or col["duration"], keep or [])


def map_unsw(df: DataFrame, tie: str | None = "id", keep: list[str] | None = None) -> DataFrame:
    """P23 UNSW-NB15: lower-case headers, seconds already, text protocol ->
    number (P14), packet/byte sums, aggregates on srcip/dstip, arrival rate
    from ``stime`` (epoch seconds), labels from label/attack_cat."""
    x = normalise_header(df, lower=True)
    keep_l = [k.lower() for k in (keep or [])]
    x = _materialise_pruned(x, ["dur", "spkts", "dpkts", "sbytes", "dbytes", "proto", "label", "attack_cat",
                                "attack_category", "stime", tie] + UNSW_DST + UNSW_SRC + keep_l)
    z = F.lit(0.0)
    get = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), z) if c in x.columns else z
    proto = proto_number("proto") if "proto" in x.columns else F.lit(0)
    x = _base(x, get("dur"), get("spkts") + get("dpkts"), get("sbytes") + get("dbytes"), proto)
    binary, cls = unsw_labels(x)
    x = x.withColumns({LABEL: binary, CLASS: cls})
    if "stime" in x.columns:
        x = x.withColumn("__stime", F.timestamp_micros(
            (F.col("stime").cast("string").try_cast("double") * 1e6).cast("bigint")))
    keep = [k.lower() for k in (keep or [])]
    tie = tie if tie in x.columns else None
    return _finish(x, pick(x, UNSW_DST), pick(x, UNSW_SRC),
                   "__stime" if "stime" in x.columns else None, tie or "dur", keep)
