"""ST2 and W7 on a stream: the same rows as in batch, and state that ends."""
import datetime
import os

import pytest
from pyspark.sql import functions as F

from netsieve.operators.stateful import admit, suppress_floods
from netsieve.operators.windows import ttl_counter
from netsieve.streaming.keyed import suppress_stream, ttl_stream

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, dpid INT, eth_src STRING, eth_dst STRING, ethertype INT"


def _events(spark, n=600):
    """Three switches, one of which has most of the events, NULL switches and
    flows, ties, and gaps of different length."""
    rows = []
    for i in range(n):
        t = T0 + datetime.timedelta(seconds=(i * 7919 % 5) * 0.25 + (i // 6) * 1.5 + (i // 150) * 40)
        rows.append((i, t, None if i % 41 == 0 else (1 if i % 3 else 2 + i % 2), f"a{i % 4}", None if i % 29 == 0 else f"b{i % 3}", 2048))
    return spark.createDataFrame(rows, SCHEMA)


def _source(spark, df, path, files):
    """Files in the order of time (a file's events may be in any order) and at the
    end a heartbeat."""
    rows = sorted(df.collect(), key=lambda r: r["ts"])
    size = -(-len(rows) // files)
    parts = [rows[k:k + size] for k in range(0, len(rows), size)]
    beat = dict(rows[-1].asDict(), event_id=-1, ts=rows[-1]["ts"] + datetime.timedelta(days=1))
    for k, part in enumerate([*parts, [tuple(beat[c] for c in df.columns)]]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/part={k}")
        for name in os.listdir(f"{path}/part={k}"):
            os.utime(f"{path}/part={k}/{name}", (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_weighted_arrivals_stand_for_as_many(spark):
    t = lambda s: T0 + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([(None, t(0), 1, 3), (1, t(2), 1, 1), (2, t(3), 1, 1), (3, t(11), 1, 1)], "event_id LONG, ts TIMESTAMP_NTZ, dpid INT, n LONG")
    got = {r["event_id"]: r["admitted"] for r in admit(df, ["dpid"], limit=4, window_sec=10, weight="n").collect()}
    assert got == {None: True, 1: True, 2: False, 3: True}


@pytest.mark.parametrize("files", [3])
def test_suppression_behind_the_limiter(spark, tmp_path, files):
    df, options = _events(spark), dict(limit=7, window_sec=4, dedup_sec=6)
    out = str(tmp_path / "out")
    suppress_stream(_source(spark, df, str(tmp_path / "in"), files), out, os.path.join(out, "ckpt"), **options).awaitTermination()
    got, want = spark.read.parquet(f"{out}/decisions"), suppress_floods(df, method="walk", **options)
    columns = ["event_id", "admitted", "suppressed"]
    assert _rows(got, columns) == _rows(want, columns)
    assert want.where("not admitted").count() > 0 and want.where("admitted and suppressed").count() > 0 and want.where("not suppressed").count() > 0


@pytest.mark.parametrize("files", [3])
def test_counter_goes_on_over_epochs(spark, tmp_path, files):
    df, out = _events(spark), str(tmp_path / "out")
    ttl_stream(_source(spark, df, str(tmp_path / "in"), files), ["dpid", "eth_dst"], out, os.path.join(out, "ckpt"), ttl_sec=20.0).awaitTermination()
    want = ttl_counter(df, ["dpid", "eth_dst"], ttl_sec=20.0)
    assert _rows(spark.read.parquet(f"{out}/counts"), ["event_id", "counter"]) == _rows(want, ["event_id", "counter"])
    assert want.agg(F.max("session")).first()[0] > 1 and want.agg(F.max("counter")).first()[0] > 10


def test_state_ends(spark, tmp_path):
    """Many sources once, then two lone later events: nothing old is carried on."""
    t = F.lit(T0).cast("timestamp_ntz")
    many = spark.range(20_000).select(F.col("id").alias("event_id"), t.alias("ts"), (F.col("id") % 50).cast("int").alias("dpid"),
                                      F.concat(F.lit("spoofed-"), "id").alias("eth_src"), F.lit("b").alias("eth_dst"), F.lit(2048).alias("ethertype"))
    late = spark.createDataFrame([(30_000 + k, T0 + datetime.timedelta(hours=k), 1, "a", "b", 2048) for k in (1, 2)], SCHEMA)
    for name, start, carried in (("s", lambda s, out: suppress_stream(s, out, f"{out}/ckpt", limit=1000), ("windows", "passed")),
                                 ("w", lambda s, out: ttl_stream(s, ["eth_src"], out, f"{out}/ckpt"), ("sessions",))):
        src, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
        for k, part in enumerate((many, late.where("event_id = 30001"), late.where("event_id = 30002"))):
            part.coalesce(1).write.parquet(f"{src}/part={k}")
            for f in os.listdir(f"{src}/part={k}"):
                os.utime(f"{src}/part={k}/{f}", (1_700_000_000 + 60 * k,) * 2)
        s = spark.readStream.schema(many.schema).option("maxFilesPerTrigger", 1).parquet(src)
        start(s, out).awaitTermination()
        for table in carried:
            left = spark.read.parquet(f"{out}/{table}")
            epochs = {r["epoch"]: r["n"] for r in left.groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).collect()}
            assert epochs and epochs[max(epochs)] <= 1, (table, epochs)
