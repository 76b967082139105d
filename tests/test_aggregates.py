"""Leaf-only destination aggregates and priority sampling."""
import datetime as dt

from pyspark.sql import functions as F

from netsieve.operators.aggregates import dst_aggregates
from netsieve.operators.joins import with_dst_aggregates
from netsieve.operators.windows import priority_sample

T0 = dt.datetime(2024, 1, 1)
ROWS = [(3, 5, 100, 5000, "10.0.0.1", "10.0.0.7"), (3, 3, 200, 8000, "10.0.0.2", "10.0.0.7"),
        (3, 4, 150, 6000, "10.0.0.1", "10.0.0.7"), (3, 2, 50, 2000, "10.0.0.3", "10.0.0.8"),
        (4, 6, 300, 12000, "10.0.0.4", "10.0.0.7"), (1, 5, 100, 5000, "10.0.0.5", "10.0.0.7")]


def _flows(spark):
    return spark.createDataFrame(
        [(i, T0, d, 10, dur, p, b, s, t, 6) for i, (d, dur, p, b, s, t) in enumerate(ROWS)],
        "event_id LONG, poll_ts TIMESTAMP, dpid INT, priority INT, duration_sec LONG, packet_count LONG, "
        "byte_count LONG, src_ip STRING, dst_ip STRING, ip_proto INT")


def test_leaf_only_counts(spark):
    a = {r["dst_ip"]: (r["flows_to_dst"], r["unique_sources_to_dst"])
         for r in dst_aggregates(_flows(spark), "poll_ts").collect()}
    assert a == {"10.0.0.7": (4, 3), "10.0.0.8": (1, 1)}


def test_join_back_keeps_spine_rows(spark):
    f = _flows(spark)
    j = with_dst_aggregates(f, dst_aggregates(f, "poll_ts"), "poll_ts")
    assert j.count() == 6
    spine = j.filter("dpid = 1").first()
    assert spine["flows_to_dst"] == 4 and spine["flow_creation_rate"] == 4 / 5


def test_priority_sample_top_n_plus_threshold(spark):
    rows = [(i, T0, 1, 110, 0) for i in range(50)] + [(50 + i, T0, 1, 1, 0) for i in range(550)]
    df = spark.createDataFrame(rows, "event_id LONG, poll_ts TIMESTAMP, duration_sec LONG, packet_count LONG, x INT")
    s = priority_sample(df, "poll_ts", 500, 100.0)
    assert s.count() == 500
    assert s.filter(F.col("sample_pps") >= 100).count() == 50
    # every flow above the threshold is kept even when it is outside the top N
    small = priority_sample(df, "poll_ts", 10, 100.0)
    assert small.count() == 50


def test_priority_sample_small_poll_kept_whole(spark):
    rows = [(i, T0, 1, i, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id LONG, poll_ts TIMESTAMP, duration_sec LONG, packet_count LONG, x INT")
    assert priority_sample(df, "poll_ts", 500, 100.0).count() == 20
