"""Invariants: stream == batch, result independent of partition count,
sample contains the top N, flows_to_dst >= unique sources."""
import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from netsieve.operators.aggregates import dst_aggregates
from netsieve.operators.stateful import block_episodes
from netsieve.operators.windows import priority_sample
from netsieve.streaming.detection import block_stream
from tests.conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 1)


def _detections(spark, n=400):
    rnd = random.Random(21)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.uniform(0, 3000)), rnd.choice(["*", "10.1.0.1", "10.1.0.2"]),
             rnd.choice(["10.0.0.1", "10.0.0.2"]), rnd.choice([1, 6]), rnd.randint(240, 360)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP_NTZ, block_src STRING, dst_ip STRING, "
                                       "ip_proto INT, timeout_sec INT")


def test_block_stream_equals_batch(spark):
    det = _detections(spark)
    src = tempfile.mkdtemp(prefix="netsieve-test-src-")
    # one file per 10-minute slice, written one after another (a stream
    # takes files in arrival order)
    sl = det.withColumn("slice", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600e6))
    for i, v in enumerate(sorted(r[0] for r in sl.select("slice").distinct().collect())):
        sl.filter(F.col("slice") == v).drop("slice").coalesce(1).write.parquet(os.path.join(src, f"part{i:04d}"))
    src = os.path.join(src, "part*")
    s = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = tempfile.mkdtemp(prefix="netsieve-test-out-")
    q = (block_stream(s).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(out, "_ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["event_id"]: (r["opens"], r["start_ts"], r["expiry_ts"]) for r in spark.read.parquet(out).collect()}
    exp = {r["event_id"]: (r["opens"], r["start_ts"], r["expiry_ts"])
           for r in block_episodes(det, ["block_src", "dst_ip", "ip_proto"], method="walk").collect()}
    assert got == exp


def test_partition_count_independence(spark):
    from netsieve.plans import derived as D
    f = D.flows(spark, SF_SMALL)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    res = []
    for n in ("2", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        ps = priority_sample(f.repartition(int(n)), "poll_ts", 5, 100.0)
        res.append(sorted(r["event_id"] for r in ps.select("event_id").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1]


def test_sample_contains_top_n_and_aggregate_bounds(spark):
    from netsieve.plans import derived as D
    f = D.flows(spark, SF_SMALL)
    ps = {r["event_id"] for r in priority_sample(f, "poll_ts", 5, 100.0).collect()}
    pdf = f.withColumn("pps", F.col("packet_count") / F.greatest(F.col("duration_sec").cast("double"), F.lit(0.001))) \
           .select("event_id", "poll_ts", "pps").toPandas()
    top = pdf.sort_values(["pps", "event_id"], ascending=[False, True]).groupby("poll_ts").head(5)
    assert set(top["event_id"]) <= ps
    a = dst_aggregates(f, "poll_ts")
    assert a.filter(F.col("flows_to_dst") < F.col("unique_sources_to_dst")).count() == 0


def _sequential_source(spark, df, slice_sec=600):
    src = tempfile.mkdtemp(prefix="netsieve-test-src-")
    sl = df.withColumn("slice", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (slice_sec * 1e6)))
    for i, v in enumerate(sorted(r[0] for r in sl.select("slice").distinct().collect())):
        sl.filter(F.col("slice") == v).drop("slice").coalesce(1).write.parquet(os.path.join(src, f"part{i:04d}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "part*"))


def _run_to_table(spark, stream_df):
    out = tempfile.mkdtemp(prefix="netsieve-test-out-")
    q = (stream_df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(out, "_ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def test_admit_and_breaker_streams_equal_batch(spark):
    from netsieve.operators.stateful import admit, breaker_states
    from netsieve.streaming.detection import admit_stream, breaker_stream
    rnd = random.Random(31)
    t, rows = 0.0, []
    for i in range(600):
        t += rnd.expovariate(1 / 5.0)
        rows.append((i, T0 + dt.timedelta(seconds=t), rnd.choice([1, 2]), rnd.choice(["m", "n"]), rnd.random() > 0.4))
    df = spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP_NTZ, dpid INT, model STRING, ok BOOLEAN")
    s = _sequential_source(spark, df)
    got = {r["event_id"]: (r["admitted"], r["window_start"])
           for r in _run_to_table(spark, admit_stream(s, "dpid", limit=3, window_sec=20.0)).collect()}
    exp = {r["event_id"]: (r["admitted"], r["window_start"])
           for r in admit(df, ["dpid"], limit=3, window_sec=20.0, method="walk").collect()}
    assert got == exp
    s2 = _sequential_source(spark, df)
    cols = ("state", "use_fallback", "total_failures", "total_fallbacks")
    got = {r["event_id"]: tuple(r[c] for c in cols) for r in _run_to_table(spark, breaker_stream(s2)).collect()}
    exp = {r["event_id"]: tuple(r[c] for c in cols) for r in breaker_states(df, method="walk").collect()}
    assert got == exp
