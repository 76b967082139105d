"""As-of lookup, ingress source check, unblock, block suppression."""
import datetime as dt
import random

import pandas as pd

from netsieve.operators.joins import (
    allowed_sources_df, antispoof, asof_lookup, suppressed_by, unblock)

T0 = dt.datetime(2024, 1, 1)


def test_asof_matches_pandas(spark):
    rnd = random.Random(5)
    facts = [(T0 + dt.timedelta(seconds=rnd.uniform(0, 5000)), rnd.choice("ab"), rnd.randint(1, 9)) for _ in range(300)]
    probes = [(i, T0 + dt.timedelta(seconds=rnd.uniform(0, 5000)), rnd.choice("abc")) for i in range(300)]
    f = spark.createDataFrame(facts, "ts TIMESTAMP, k STRING, port INT")
    p = spark.createDataFrame(probes, "pid LONG, ts TIMESTAMP, k STRING")
    got = asof_lookup(p, f, ["k"], "ts", ["port"], tolerance_sec=300.0, bucket_sec=120.0).toPandas()
    fp = pd.DataFrame(facts, columns=["ts", "k", "port"]).sort_values("ts")
    pp = pd.DataFrame(probes, columns=["pid", "ts", "k"]).sort_values("ts")
    m = pd.merge_asof(pp, fp.rename(columns={"ts": "fts"}), left_on="ts", right_on="fts", by="k",
                      direction="backward", allow_exact_matches=True)
    m.loc[(m["ts"] - m["fts"]).dt.total_seconds() > 300, "port"] = None
    exp = dict(zip(m["pid"], m["port"]))
    g = dict(zip(got["pid"], got["port"]))
    assert {k: (None if pd.isna(v) else int(v)) for k, v in g.items()} == \
           {k: (None if pd.isna(v) else int(v)) for k, v in exp.items()}


def test_antispoof(spark):
    ev = spark.createDataFrame([(1, 3, 1, "10.0.0.1"), (2, 3, 1, "10.0.0.9"), (3, 1, 1, "1.2.3.4"),
                                (4, 4, 4, "10.0.0.7")], "event_id LONG, dpid INT, in_port INT, src_ip STRING")
    r = {x["event_id"]: x["spoof_ok"] for x in antispoof(ev, allowed_sources_df(spark)).collect()}
    assert r == {1: True, 2: False, 3: True, 4: True}


def test_unblock_removes_both_cookies(spark):
    rules = spark.createDataFrame([(0xDEAD, "1.1.1.1", "2.2.2.2"), (0xBEEF, None, "1.1.1.1"),
                                   (0xDEAD, "3.3.3.3", "1.1.1.1"), (0x1, "1.1.1.1", None)],
                                  "cookie INT, match_ipv4_src STRING, match_ipv4_dst STRING")
    ips = spark.createDataFrame([("1.1.1.1",)], "ip STRING")
    left = sorted((r["cookie"], r["match_ipv4_src"]) for r in unblock(rules, ips).collect())
    assert left == [(0x1, "1.1.1.1"), (0xDEAD, "3.3.3.3")]


def test_suppressed_by_interval(spark):
    blocks = spark.createDataFrame([("a", T0, T0 + dt.timedelta(seconds=300))],
                                   "k STRING, start_ts TIMESTAMP, expiry_ts TIMESTAMP")
    det = spark.createDataFrame([(1, "a", T0), (2, "a", T0 + dt.timedelta(seconds=299)),
                                 (3, "a", T0 + dt.timedelta(seconds=300)), (4, "b", T0)],
                                "id LONG, k STRING, ts TIMESTAMP")
    assert sorted(r["id"] for r in suppressed_by(det, blocks, ["k"]).collect()) == [1, 2]


def test_asof_ties_do_not_depend_on_the_order_of_the_input(spark):
    from pyspark.sql import functions as F

    from netsieve.operators.joins import asof_lookup
    facts = spark.createDataFrame([("k", k) for k in range(40)], "key string, port int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    probe = spark.createDataFrame([("k", 1)], "key string, event_id int").withColumn("ts", F.lit("2024-01-01 00:00:05").cast("timestamp_ntz"))
    for bucket in (2.0, 3600.0):
        for parts in (1, 7):
            f = facts.repartition(parts, F.rand(parts))
            assert asof_lookup(probe, f, ["key"], "ts", ["port"], bucket_sec=bucket).first()["port"] == 39


def test_overlapping_blocks_suppress_alike(spark):
    import random

    from pyspark.sql import functions as F

    from netsieve.operators.joins import suppressed_by
    rng = random.Random(4)
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c)).cast("timestamp_ntz")
    blocks = [(rng.choice("ab"), s, s + rng.choice([5, 50, 90_000])) for s in (rng.randrange(400_000) for _ in range(60))] + [("a", 7, None), (None, 0, 10)]
    rows = [(k, rng.choice("abc"), rng.randrange(500_000)) for k in range(400)]
    b = spark.createDataFrame(blocks, "src string, s long, e long").select("src", at("s").alias("start_ts"), at("e").alias("expiry_ts"))
    d = spark.createDataFrame(rows, "id long, src string, t long").select("id", "src", at("t").alias("ts"))
    got = {r["id"] for r in suppressed_by(d, b, ["src"]).collect()}
    want = {k for k, src, t in rows if any(x == src and s <= t < e for x, s, e in blocks if e is not None)}
    assert got == want and 20 < len(want) < 380
