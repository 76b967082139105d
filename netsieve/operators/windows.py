"""Window and time-series operators (W1-W9), ranking and limits (L1-L3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsieve.operators._split import DEFAULT_BUCKET_SEC, key_struct, split_lag, split_running, with_buckets

FLOW_KEY = ["dpid", "src_ip", "dst_ip", "ip_proto"]


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def rate_of_change(df: DataFrame, key: list[str] | None = None, ts: str = "ts",
                   tie: str = "event_id", ttl_sec: float = 300.0,
                   bucket_sec: float = DEFAULT_BUCKET_SEC) -> DataFrame:
    """pps/bps deltas to the key's previous observation and acceleration
    = delta pps / max(0.001, delta t). 0 for the first observation or when the
    previous one is ``ttl_sec`` or more old (it has left the cache). Rates use
    the duration floored at 1 ms."""
    key = key or FLOW_KEY
    d = F.greatest(F.col("duration_sec").cast("double"), F.lit(0.001))
    x = df.withColumns({"pps_now": F.col("packet_count") / d, "bps_now": F.col("byte_count") / d})
    x = split_lag(x, key, [ts, tie], [ts, "pps_now", "bps_now"], 1, bucket_sec)
    dt = (_us(ts) - F.unix_micros(F.col("prev1")[ts].cast("timestamp"))) / 1e6
    live = F.col("prev1").isNotNull() & (dt < ttl_sec)
    dpps = F.col("pps_now") - F.col("prev1")["pps_now"]
    return x.withColumns({
        "pps_delta": F.when(live, dpps).otherwise(F.lit(0.0)),
        "bps_delta": F.when(live, F.col("bps_now") - F.col("prev1")["bps_now"]).otherwise(F.lit(0.0)),
        "pps_acceleration": F.when(live, dpps / F.greatest(F.lit(0.001), dt)).otherwise(F.lit(0.0)),
    }).drop("prev1")


def arrival_rate(df: DataFrame, key: str = "dst_ip", ts: str = "ts", tie: str = "event_id",
                 n: int = 5, bucket_sec: float = DEFAULT_BUCKET_SEC,
                 extra_key: list[str] | None = None) -> DataFrame:
    """Flow-creation rate per destination: 1 / max(gap, 0.001) to the
    previous arrival, averaged over the last ``n`` rows (the first arrival has
    no gap and is skipped), NULL -> 0. Rows with a null key drop out."""
    x = df.filter(F.col(key).isNotNull())
    x = split_lag(x, [key] + (extra_key or []), [ts, tie], [ts], n, bucket_sec)
    t = [_us(ts)] + [F.unix_micros(F.col(f"prev{k}")[ts].cast("timestamp")) for k in range(1, n + 1)]
    # r_j for j = current and the n-1 before it; each needs the row before j
    rs = []
    for j in range(n):
        cur, prev = t[j], t[j + 1]
        rs.append(F.when(prev.isNotNull(),
                         1.0 / F.greatest((cur - prev) / 1e6, F.lit(0.001))))
    num = sum([F.coalesce(r, F.lit(0.0)) for r in rs], F.lit(0.0))
    cnt = sum([F.when(r.isNotNull(), 1).otherwise(0) for r in rs], F.lit(0))
    rate = F.when(cnt > 0, num / cnt).otherwise(F.lit(0.0))
    return x.withColumn("flow_creation_rate", rate).drop(*[f"prev{k}" for k in range(1, n + 1)])


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salts: int = 64, salt_col: str | None = None) -> DataFrame:
    """Exact top-``k`` rows per group in ``order`` (a total order), in two
    phases so a hot group never ranks all its rows in one task: first the top
    k inside (group, salt) slices, then the top k of those <= salts*k rows.
    Adds ``rank`` (1..k)."""
    s = F.pmod(F.xxhash64(F.col(salt_col)) if salt_col else F.xxhash64(*[F.col(c) for c in df.columns]),
               F.lit(salts))
    x = df.withColumn("__salt", s)
    w1 = Window.partitionBy(*group, "__salt").orderBy(*order)
    x = x.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (x.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)
             .drop("__salt", "__r1"))


def priority_sample(df: DataFrame, poll: str = "poll_ts", n: int | None = 500,
                    pps_threshold: float = 100.0, tie: str = "event_id") -> DataFrame:
    """W3 (with L3, U2): per poll, all flows when there are at most ``n``;
    otherwise the ``n`` highest-pps flows plus every flow at or above
    ``pps_threshold``. pps = packets / max(duration, 0.001); ties keep the
    earlier row id. Without an ``n`` (None) no poll is too large: every flow stays.

    The n-th flow of each poll is found with the salted two-phase top-k, and
    flows are kept by comparing with that one-row-per-poll cut: no task ranks
    a whole poll, however large."""
    d = F.greatest(F.col("duration_sec").cast("double"), F.lit(0.001))
    x = df.withColumn("sample_pps", F.col("packet_count") / d)
    if n is None:
        return x
    order = [F.col("sample_pps").desc(), F.col(tie).asc()]
    top = top_k_per_group(x.select(poll, "sample_pps", tie), [poll], order, n, salt_col=tie)
    cut = (top.groupBy(poll).agg(F.max_by(F.struct(F.col("sample_pps").alias("cut_pps"),
                                                   F.col(tie).alias("cut_id")), F.col("rank")).alias("cut"),
                                 F.max("rank").alias("__n_top")))
    sizes = x.groupBy(poll).agg(F.count(F.lit(1)).alias("poll_flows"))
    j = x.join(cut, poll, "left").join(sizes, poll, "left")
    in_top = (F.col("sample_pps") > F.col("cut.cut_pps")) | \
             ((F.col("sample_pps") == F.col("cut.cut_pps")) & (F.col(tie) <= F.col("cut.cut_id")))
    keep = (F.col("poll_flows") <= n) | in_top | (F.col("sample_pps") >= pps_threshold)
    return j.filter(keep).drop("cut", "__n_top", "poll_flows")


def port_security(df: DataFrame, max_macs: int = 5, ts: str = "ts", tie: str = "event_id",
                  port_key: list[str] | None = None, mac: str = "eth_src") -> DataFrame:
    """Only the first ``max_macs`` distinct MACs seen on a (switch, port)
    are learnt; events of later MACs are flagged. First sighting per MAC is an
    aggregate (partial per task), the first-k MACs per port a salted top-k."""
    pk = port_key or ["dpid", "in_port"]
    first = df.groupBy(*pk, mac).agg(F.min(F.struct(F.col(ts), F.col(tie))).alias("__first"))
    top = top_k_per_group(first, pk, [F.col("__first").asc()], max_macs, salt_col=mac)
    allowed = top.select(*pk, mac, F.lit(True).alias("__ok"))
    return (df.join(allowed, pk + [mac], "left")
              .withColumn("port_violation", F.col("__ok").isNull())
              .drop("__ok"))


def zscore_drift(df: DataFrame, key: str, value: str = "value", ts: str = "ts",
                 tie: str = "event_id", n: int = 1000, min_n: int = 100,
                 bucket_sec: float = DEFAULT_BUCKET_SEC) -> DataFrame:
    """Over the last ``n`` values of the key (current included), once at
    least ``min_n`` were seen and the population std is > 0, flag when
    ``x > mean + 3 std``; with the running drift count and last drift time.

    A drift series is usually ONE key (a model's error stream), so no step may
    need the key in one task: rows are numbered per key (``split_running``) and
    cut into blocks of ``n``. A row's frame is the end of the block before its
    own plus the start of its own, so its moments are those of a suffix and a
    prefix, put together; nothing is ever subtracted, and values of any size
    keep their digits. Blocks hold ``n`` rows whatever the key's size."""
    kk, at = F.struct(F.col(key)).alias("__k"), F.col("__pos") - 1
    x = split_running(df, [key], [ts, tie], sums={"__pos": F.lit(1).cast("long")}, bucket_sec=bucket_sec)
    x = x.select("*", kk, F.floor(at / n).alias("__block"))
    v = F.col(value).cast("double")

    def moments(order, name):
        w = Window.partitionBy("__k", "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.struct(F.count(v).over(w).alias("n"), F.avg(v).over(w).alias("m"), F.var_pop(v).over(w).alias("v"),
                        F.min(v).over(w).alias("lo"), F.max(v).over(w).alias("hi")).alias(name)

    x = x.select("*", moments(F.col("__pos").asc(), "__a"), moments(F.col("__pos").desc(), "__b"))
    # the suffix that starts n - 1 rows back lies in the block before, but for
    # the last row of a block, whose own prefix is the frame
    old = x.where(at % n != 0).select(F.col("__k").alias("__ko"), (F.col("__pos") + n - 1).alias("__po"), F.col("__b").alias("__o"))
    j = x.drop("__b").join(old, (F.col("__k") == F.col("__ko")) & (F.col("__pos") == F.col("__po")), "left")
    na, nb = F.col("__a.n"), F.coalesce("__o.n", F.lit(0))
    ma, mb = F.coalesce("__a.m", F.lit(0.0)), F.coalesce("__o.m", F.lit(0.0))
    cnt = na + nb
    mean = (na * ma + nb * mb) / cnt
    var = (na * F.coalesce("__a.v", F.lit(0.0)) + nb * F.coalesce("__o.v", F.lit(0.0)) + (mb - ma) * (mb - ma) * (na * nb / cnt)) / cnt
    # equal values have no spread, whatever rounding their mean has seen
    std = F.when(F.least("__a.lo", "__o.lo") == F.greatest("__a.hi", "__o.hi"), 0.0).otherwise(F.sqrt(var))
    flag = F.coalesce((cnt >= min_n) & (std > 0) & (v > mean + 3 * std), F.lit(False))
    y = j.withColumn("drift", flag).drop("__ko", "__po", "__o", "__a", "__k", "__block", "__pos")
    return split_running(y, [key], [ts, tie], sums={"drift_count": F.col("drift").cast("long")},
                         maxes={"last_drift_ts": F.when(F.col("drift"), F.col(ts))},
                         bucket_sec=bucket_sec)


def previous_snapshot(df: DataFrame, key: list[str], ts: str = "ts", tie: str = "event_id",
                      cols: list[str] | None = None,
                      bucket_sec: float = DEFAULT_BUCKET_SEC) -> DataFrame:
    """The most recent earlier snapshot of the same key as a struct
    column ``prev`` (NULL for the first)."""
    cols = cols or [c for c in df.columns if c not in key]
    x = split_lag(df, key, [ts, tie], cols, 1, bucket_sec)
    return x.withColumnRenamed("prev1", "prev")


def ttl_counter(df: DataFrame, key: list[str], ts: str = "ts", tie: str = "event_id",
                ttl_sec: float = 300.0, bucket_sec: float = DEFAULT_BUCKET_SEC, part_rows: int | None = None) -> DataFrame:
    """Per key a counter that increments on each event and restarts at 1
    when the gap since the previous event is ``ttl_sec`` or more. Adds
    ``session`` (restarts so far) and ``counter``.

    One pass per (key, bucket) counts since the last restart inside the bucket;
    one row per bucket then says whether its first event restarts, and what
    counter and session the bucket before ended with."""
    us = _us(ts)
    x = with_buckets(df.withColumn("__kk", key_struct(key)), ts, bucket_sec, part_rows)
    w = Window.partitionBy("__kk", "__b").orderBy(ts, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", us.alias("__us"), F.row_number().over(w).alias("__p"), F.lag(us).over(w).alias("__prev"))
    x = x.withColumn("__r", F.when((F.col("__us") - F.col("__prev")) / 1e6 >= ttl_sec, F.col("__p")))
    x = x.select("*", F.max("__r").over(upto).alias("__at"), F.count("__r").over(upto).alias("__rs"))

    # one row per (key, bucket), in the partitions of the rows
    s = x.groupBy("__kk", "__b").agg(F.count(F.lit(1)).alias("n"), F.min("__us").alias("first"), F.max("__us").alias("last"),
                                     F.max("__at").alias("at"), F.max("__rs").alias("rs"))
    k = Window.partitionBy("__kk").orderBy("__b")
    s = s.withColumn("before", F.lag("last").over(k))
    s = s.withColumn("opens", F.col("before").isNull() | ((F.col("first") - F.col("before")) / 1e6 >= ttl_sec))
    sofar = k.rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("*", F.sum("n").over(sofar).alias("rows"), F.sum(F.col("rs") + F.col("opens").cast("long")).over(sofar).alias("resets"))
    # events up to the last restart at or before the bucket's end
    until = F.when(F.col("at").isNotNull(), F.col("rows") - F.col("n") + F.col("at") - 1).when(F.col("opens"), F.col("rows") - F.col("n"))
    s = s.withColumn("base", F.last(until, ignorenulls=True).over(sofar))
    s = s.select("__kk", "__b", "opens", F.lag(F.col("rows") - F.col("base")).over(k).alias("carried"), (F.col("resets") - F.col("rs")).alias("session0"))

    j = x.join(s, ["__kk", "__b"])
    since = F.when(F.col("__at").isNotNull(), F.col("__p") - F.col("__at") + 1).when(F.col("opens"), F.col("__p")).otherwise(F.col("__p") + F.col("carried"))
    return j.select(*df.columns, (F.col("session0") + F.col("__rs")).alias("session"), since.cast("bigint").alias("counter"))


def timeline(df: DataFrame, unit: str = "hour", ts: str = "ts") -> DataFrame:
    """Events per hour (or minute) from the first to the last bin, empty
    bins 0. The first/last bin are two scalars of a one-row aggregate; the
    bin list is ``spark.range`` over the bin count (generated in parallel,
    not exploded from one row); the counts are an aggregate; the fill is an
    equi-join on the bin."""
    step_us = {"hour": 3_600_000_000, "minute": 60_000_000}[unit]
    b = F.date_trunc(unit, F.col(ts).cast("timestamp"))
    counts = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("events"))
    lo, hi = df.agg(F.unix_micros(F.min(b)), F.unix_micros(F.max(b))).first()
    if lo is None:
        return counts.limit(0)
    n = (hi - lo) // step_us + 1
    bins = df.sparkSession.range(n).select(F.timestamp_micros(F.lit(lo) + F.col("id") * step_us).alias("bin"))
    return (bins.join(counts, "bin", "left")
                .select("bin", F.coalesce("events", F.lit(0)).cast("bigint").alias("events")))


def table_state(df: DataFrame, at, ttl_sec: float = 300.0, ts: str = "ts",
                key: list[str] | None = None, port: str = "in_port", tie: str = "event_id") -> DataFrame:
    """Address-table state at time ``at``: newest (port, time) per
    (switch, MAC) learnt at or before ``at``; entries older than ``ttl_sec``
    are aged out (``evicted``)."""
    key = key or ["dpid", "eth_src"]
    x = df.filter(F.col(ts) <= F.lit(at))
    # of entries of one time the greatest row id (else port) counts, however the rows lie
    rank = [F.col(ts).alias("learnt_ts"), *([F.col(tie).alias("tie")] if tie in df.columns else []), F.col(port).alias("port")]
    newest = x.groupBy(*key).agg(F.max(F.struct(*rank)).alias("e"))
    age = (F.unix_micros(F.lit(at).cast("timestamp")) - F.unix_micros(F.col("e.learnt_ts").cast("timestamp"))) / 1e6
    return newest.select(*key, F.col("e.port").alias("port"), F.col("e.learnt_ts").alias("learnt_ts"),
                         age.alias("age_sec"), (age > ttl_sec).alias("evicted"))


def top_sources(df: DataFrame, col: str = "src_ip", k: int = 10) -> DataFrame:
    """L1: the ``k`` most frequent values, count descending (value ascending
    on ties). Aggregate, then TakeOrdered: each task keeps only its top k."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col(col).asc()).limit(k))


def ranking(df: DataFrame, col: str = "src_ip") -> DataFrame:
    """L2: full ranking of the values by count (distributed rank)."""
    from netsieve.operators._prefix import global_rank
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return global_rank(g, [F.col("count").desc(), F.col(col).asc_nulls_first()])
