"""Drift detectors: z-score window (reference cases) and ADWIN against a
brute-force check of every cut of the window."""
import datetime as dt
import math
import random

from netsieve.operators.stateful import _Adwin, adwin
from netsieve.operators.windows import zscore_drift

T0 = dt.datetime(2024, 1, 1)


def _series(spark, values, key="m"):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), key, float(v)) for i, v in enumerate(values)],
                                 "event_id LONG, ts TIMESTAMP, k STRING, value DOUBLE")


def test_zscore_needs_100_and_flags_spike(spark):
    few = zscore_drift(_series(spark, [0.0] * 98 + [1.0]), "k").filter("drift").count()
    assert few == 0
    r = sorted(zscore_drift(_series(spark, [0.0] * 150 + [1.0] * 3), "k").collect(), key=lambda x: x["event_id"])
    # 150 zeros: std 0, no flag; the first 1.0 is far above mean + 3 std once std > 0
    assert not any(x["drift"] for x in r[:150]) and r[150]["drift"]
    assert r[-1]["drift_count"] >= 1


def _brute_cut(values, delta=0.002, min_sub=5):
    """ADWIN0 check on the whole window: any cut with |mean0 - mean1| > eps."""
    n = len(values)
    mean = sum(values) / n
    var = sum((x - mean) ** 2 for x in values) / n
    dp = delta / max(math.log(n), 1.0)
    ln = math.log(2.0 / dp)
    for c in range(min_sub, n - min_sub + 1):
        a, b = values[:c], values[c:]
        m = 1.0 / (1.0 / len(a) + 1.0 / len(b))
        eps = math.sqrt(2.0 / m * var * ln) + 2.0 / (3.0 * m) * ln
        if abs(sum(a) / len(a) - sum(b) / len(b)) > eps:
            return True
    return False


def test_adwin_detects_shift_and_stays_quiet():
    rnd = random.Random(1)
    stationary = [rnd.gauss(0.2, 0.05) for _ in range(600)]
    a = _Adwin(0.002)
    assert sum(a.update(x) for x in stationary) == 0
    assert not _brute_cut(stationary)
    shifted = stationary[:300] + [rnd.gauss(0.8, 0.05) for _ in range(100)]
    a2 = _Adwin(0.002)
    flags = [a2.update(x) for x in shifted]
    first = flags.index(True)
    # detection soon after the change, and the brute-force cut agrees a change exists there
    assert 300 <= first <= 330
    assert _brute_cut(shifted[: first + 1])
    assert a2.n < 200        # the old part was dropped


def test_adwin_operator_per_key(spark):
    vals = [0.0] * 200 + [1.0] * 60
    df = _series(spark, vals, "x").unionByName(_series(spark, [0.0] * 260, "y").selectExpr(
        "event_id + 1000 AS event_id", "ts", "k", "value"))
    r = {x["k"]: x["c"] for x in adwin(df, ["k"], "value").groupBy("k").agg({"drift_count": "max"})
         .withColumnRenamed("max(drift_count)", "c").collect()}
    assert r["x"] >= 1 and r["y"] == 0


def test_zscore_drift_of_any_scale(spark):
    """Against a plain window in numpy, from tiny to huge values, outliers and
    constant stretches among them."""
    import numpy as np
    from pyspark.sql import functions as F

    from netsieve.operators.windows import zscore_drift
    rng = np.random.default_rng(0)
    x = rng.normal(5, 1, 2600)
    x[rng.integers(0, 2600, 40)] += 30
    x[1200:2300] = 7.0
    x[2290] = 9.0
    for scale, n in ((1.0, 50), (1e-6, 1000), (1e15, 130)):
        v = x * scale
        rows = [(i, "m" if i % 50 else None, float(a)) for i, a in enumerate(v)]
        df = spark.createDataFrame(rows, "event_id long, k string, value double").withColumn("ts", F.timestamp_seconds(F.floor(F.col("event_id") / 3)))
        got = {r["event_id"]: r for r in zscore_drift(df.repartition(5), "k", n=n, min_n=20, bucket_sec=97).collect()}
        for key in ("m", None):
            ids = [r[0] for r in rows if r[1] == key]
            count = 0
            for p, i in enumerate(ids):
                f = v[ids[max(0, p - n + 1):p + 1]]
                want = len(f) >= 20 and f.max() > f.min() and v[i] > f.mean() + 3 * f.std()
                count += want
                assert got[i]["drift"] == want and got[i]["drift_count"] == count, (scale, key, i)
        assert sum(r["drift"] for r in got.values()) > 10
