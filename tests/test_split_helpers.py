"""Split-key scans and distributed ranks equal their single-task forms."""
import datetime as dt
import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from netsieve.operators._prefix import global_rank, global_running_sum
from netsieve.operators._split import key_struct, split_lag, split_running, with_buckets
from netsieve.operators.joins import asof_lookup
from netsieve.operators.windows import top_k_per_group, ttl_counter

T0 = dt.datetime(2024, 1, 1)


def _events(spark, n=600, keys=("a", "b", None), span=20000):
    rnd = random.Random(3)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.uniform(0, span)), rnd.choice(keys), rnd.randint(0, 9))
            for i in range(n)]
    return spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP, k STRING, v LONG")


def test_split_lag_equals_window_for_any_bucket(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    exp = {r["event_id"]: (r["l1"], r["l3"]) for r in
           df.select("event_id", F.lag("v", 1).over(w).alias("l1"), F.lag("v", 3).over(w).alias("l3")).collect()}
    for b in (60.0, 1000.0, 1e9):
        got = {r["event_id"]: (r["prev1"]["v"] if r["prev1"] else None, r["prev3"]["v"] if r["prev3"] else None)
               for r in split_lag(df, ["k"], ["ts", "event_id"], ["v"], 3, b).collect()}
        assert got == exp


def test_split_running_equals_window(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    exp = {r["event_id"]: (r["s"], r["m"]) for r in
           df.select("event_id", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m")).collect()}
    got = {r["event_id"]: (r["s"], r["m"]) for r in
           split_running(df, ["k"], ["ts", "event_id"], sums={"s": F.col("v")}, maxes={"m": F.col("v")},
                         bucket_sec=300.0).collect()}
    assert got == exp


def test_ttl_counter_restarts(spark):
    rows = [(0, 0), (1, 100), (2, 399), (3, 699), (4, 700)]
    df = spark.createDataFrame([(e, T0 + dt.timedelta(seconds=s), "x") for e, s in rows],
                               "event_id LONG, ts TIMESTAMP, k STRING")
    r = {x["event_id"]: x["counter"] for x in ttl_counter(df, ["k"], ttl_sec=300, bucket_sec=200).collect()}
    assert r == {0: 1, 1: 2, 2: 3, 3: 1, 4: 2}   # gap of exactly 300 s restarts


def test_global_rank_consecutive(spark):
    df = _events(spark).repartition(5)
    r = global_rank(df, [F.col("v").desc(), F.col("event_id").asc()], "rank").toPandas()
    exp = r.sort_values(["v", "event_id"], ascending=[False, True])["event_id"].tolist()
    assert r.sort_values("rank")["event_id"].tolist() == exp
    assert sorted(r["rank"]) == list(range(1, len(r) + 1))


def test_global_running_sum(spark):
    df = _events(spark).repartition(4)
    r = global_running_sum(df, [F.col("event_id").asc()], "v", "cs").toPandas().sort_values("event_id")
    assert r["cs"].tolist() == r["v"].cumsum().tolist()


def test_top_k_per_group_exact(spark):
    df = _events(spark, n=900)
    got = top_k_per_group(df, ["k"], [F.col("v").desc(), F.col("event_id").asc()], 7, salts=8).toPandas()
    pdf = df.toPandas().sort_values(["v", "event_id"], ascending=[False, True])
    exp = pdf.groupby("k", dropna=False).head(7)
    assert sorted(got["event_id"]) == sorted(exp["event_id"])
    assert isinstance(got, pd.DataFrame)


def test_ttl_counter_equals_a_walk_with_few_exchanges(spark):
    """Any bucket width, gaps at the limit, ties, a NULL key; and a third of the
    exchanges the composed form took."""
    import random

    from pyspark.sql import functions as F

    from netsieve.operators.windows import ttl_counter
    rng = random.Random(4)
    rows, t = [], {"a": 0, "b": 0, None: 0}
    for i in range(600):
        k = rng.choice(["a", "a", "a", "b", None])
        t[k] += rng.choice([0, 1_000_000, 4_999_999, 5_000_000, 7_500_000, 40_000_000])
        rows.append((i, k, t[k]))
    want, last = {}, {}
    for i, k, at in sorted(rows, key=lambda r: (r[2], r[0])):
        seen, session, counter = last.get(k, (None, 0, 0))
        if seen is None or at - seen >= 5_000_000:
            session, counter = session + 1, 0
        last[k] = (at, session, counter + 1)
        want[i] = (session, counter + 1)
    df = spark.createDataFrame(rows, "event_id long, k string, us long").withColumn("ts", F.timestamp_micros("us"))
    for bucket in (3.0, 11.0, 1e6):
        got = {r["event_id"]: (r["session"], r["counter"]) for r in ttl_counter(df.repartition(3), ["k"], ttl_sec=5.0, bucket_sec=bucket).collect()}
        assert got == want
    plan = ttl_counter(df, ["k"])._jdf.queryExecution().sparkPlan().toString()
    executed = ttl_counter(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    # those by __clock carry the counts of slices from which hot buckets are cut, not rows
    moved = [line for line in executed.splitlines() if "Exchange hashpartitioning" in line and "__clock" not in line]
    assert len(moved) <= 6 and plan.count("Window") <= 12


def _burst(spark, n):
    """One key; half of its rows in a tenth of one hour, with ties."""
    at = F.when(F.col("id") % 2 == 0, F.pmod(F.xxhash64("id"), F.lit(360))).otherwise(F.pmod(F.xxhash64("id"), F.lit(3600)))
    return spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + at).alias("ts"),
                                 F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.lit("victim")).alias("k"), (F.col("id") % 7).alias("v"))


def test_hot_buckets_are_cut_by_rows(spark):
    """One key and one hour: parts of about equal rows, in time order, and rows of
    one time stay together."""
    d = with_buckets(_burst(spark, 200_000).withColumn("__kk", key_struct(["k"])), "ts", 3600.0, 10_000)
    got = d.where("k = 'victim'").groupBy("__b").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z")).orderBy("__b").collect()
    sizes = sorted(r["n"] for r in got)
    assert len(got) >= 15 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert all(x["z"] < y["a"] for x, y in zip(got, got[1:]))
    cold = with_buckets(_burst(spark, 1000).withColumn("__kk", key_struct(["k"])), "ts", 3600.0)
    assert {r["__b"]["__part"] for r in cold.select("__b").distinct().collect()} == {0}


def test_parts_do_not_change_results(spark):
    df = _events(spark, n=500, span=300).withColumn("ts", F.date_trunc("second", "ts"))
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    exp = {r["event_id"]: (r["l1"], r["l2"], r["s"]) for r in df.select(
        "event_id", F.lag("v", 1).over(w).alias("l1"), F.lag("v", 2).over(w).alias("l2"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()}
    for rows in (1, 7, 100):
        one = split_lag(df, ["k"], ["ts", "event_id"], ["v"], 2, 120.0, part_rows=rows)
        run = split_running(df, ["k"], ["ts", "event_id"], sums={"s": F.col("v")}, bucket_sec=120.0, part_rows=rows)
        got = {r["event_id"]: (r["prev1"] and r["prev1"]["v"], r["prev2"] and r["prev2"]["v"], r["s"])
               for r in one.join(run.select("event_id", "s"), "event_id").collect()}
        assert got == exp
        a = {tuple(r) for r in ttl_counter(df, ["k"], ttl_sec=2, bucket_sec=120.0, part_rows=rows).select("event_id", "session", "counter").collect()}
        assert a == {tuple(r) for r in ttl_counter(df, ["k"], ttl_sec=2, bucket_sec=1e9).select("event_id", "session", "counter").collect()}


def test_asof_by_parts_equals_one_bucket(spark):
    df = _events(spark, n=400, span=300).withColumn("ts", F.date_trunc("second", "ts"))
    facts, probes = df.where("event_id % 3 = 0"), df.where("event_id % 3 > 0").select("event_id", "ts", "k")
    facts = facts.select("ts", "k", F.col("event_id").alias("fact"), "v")

    def looked_up(**kw):
        return {tuple(r) for r in asof_lookup(probes, facts, ["k"], "ts", ["fact", "v"], **kw).select("event_id", "fact", "v", "age_sec").collect()}

    want = looked_up(bucket_sec=1e9)
    assert any(r[1] is not None for r in want)
    for rows in (1, 9, 60):
        assert looked_up(bucket_sec=120.0, part_rows=rows) == want
