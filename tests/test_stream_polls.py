"""Polls spread over files and triggers: the stream equals the batch plan."""
import datetime
import os

import pytest
from pyspark.sql import functions as F

from netsieve.operators.aggregates import dst_aggregates
from netsieve.operators.filters import eligible_flows
from netsieve.plans import derived as D
from netsieve.plans.detection import detect_and_block, detect_floods
from netsieve.plans.q_stream import WHOLE, trained_scorer, write_poll_files
from netsieve.schema import switches_df
from netsieve.streaming.detection import admit_stream, block_stream, detection_stream, for_each_poll, read_flow_stats
from tests.conftest import SF_SMALL


def _first_polls(spark, n=7):
    f = D.flows(spark, SF_SMALL).withColumn("poll_ts", F.col("poll_ts").cast("timestamp"))
    days = sorted(r["poll_ts"] for r in f.select("poll_ts").distinct().collect())
    return f.where(F.col("poll_ts") < F.lit(days[n]))


@pytest.mark.parametrize("files_per_trigger", [4, 40])
def test_detections_do_not_depend_on_the_file_cap(spark, tmp_path, files_per_trigger):
    polls = _first_polls(spark)
    src = write_poll_files(spark, SF_SMALL, flows=polls)
    out = str(tmp_path / "out")
    s = read_flow_stats(spark, src, streaming=True, max_files_per_trigger=files_per_trigger)
    detection_stream(spark, s, out, os.path.join(out, "ckpt"), min_sources=3, min_flows=3).awaitTermination()
    got = spark.read.parquet(f"{out}/detections").drop("epoch")
    want = detect_floods(polls, min_sources=3, min_flows=3)
    cols = [c for c in want.columns if c != "poll_ts"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert got.count() > 0


def test_aggregates_of_every_poll_and_no_row_twice(spark, tmp_path):
    src = write_poll_files(spark, SF_SMALL)
    # a file delivered again: its rows must not count twice
    some = spark.read.parquet(src).where("event_id % 3 = 1")
    some.withColumn("poll", F.date_format("poll_ts", "yyyyMMdd")).write.mode("append").partitionBy("poll").parquet(src)
    out = str(tmp_path / "out")
    s = read_flow_stats(spark, src, streaming=True, max_files_per_trigger=1000)
    for_each_poll(s, lambda p: {"agg": dst_aggregates(eligible_flows(p), "poll_ts")}, out, os.path.join(out, "ckpt")).awaitTermination()
    got = spark.read.parquet(f"{out}/agg").drop("epoch")
    want = dst_aggregates(eligible_flows(D.flows(spark, SF_SMALL)).withColumn("poll_ts", F.col("poll_ts").cast("timestamp")), "poll_ts")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("files_per_trigger,trained", [(4, False), (40, True)])
def test_whole_stream_equals_its_batch_plan(spark, tmp_path, files_per_trigger, trained):
    """Rates of change, sampling, scores, blocks, rules and log with polls spread
    over three files; what one epoch leaves serves the next."""
    scorer = trained_scorer(spark, SF_SMALL, 5, 4) if trained else lambda f: f.withColumn("attack_prob", 1 / (1 + F.exp(-(F.col("pps") - 2000) / 500)))
    options = {**WHOLE, "sample_n": 5, "scorer": scorer, "min_sources": 3, "min_flows": 3}
    # few flows, so that they come back poll after poll
    few = lambda net, n: F.concat(F.lit(net), (F.col("event_id") % n + 1).cast("string"))
    polls = _first_polls(spark).withColumns({"src_ip": few("10.1.0.", 3), "dst_ip": few("10.0.0.", 2), "dpid": F.lit(3), "ip_proto": F.lit(17)})
    src, out = write_poll_files(spark, SF_SMALL, flows=polls), str(tmp_path / "out")
    s = read_flow_stats(spark, src, streaming=True, max_files_per_trigger=files_per_trigger)
    detection_stream(spark, s, out, os.path.join(out, "ckpt"), **options).awaitTermination()
    want = detect_and_block(polls, switches_df(spark), **options)
    for name in ("detections", "attack_log", "rules"):
        got = spark.read.parquet(f"{out}/{name}").drop("epoch")
        assert sorted(map(str, got.select(want[name].columns).collect())) == sorted(map(str, want[name].collect())), name
    det = want["detections"]
    opened, all_ = det.where("opens").count(), det.count()
    assert 0 < opened < all_ and want["attack_log"].count() == opened
    assert det.where("pps_delta <> 0").count() > 0 and det.where("not opens and start_ts < poll_ts").count() > 0
    epochs = sorted(int(d.split("=")[1]) for d in os.listdir(f"{out}/block_state"))
    assert len(epochs) <= 2


def test_an_epoch_is_planned_with_aqe(spark, tmp_path):
    """The batch plan of an epoch sees its rows as a table of the caller's session,
    without the plan of the state store; nothing is left of it."""
    polls, out, seen = _first_polls(spark, 2), str(tmp_path / "out"), []

    def run(rows):
        seen.append((rows.sparkSession.conf.get("spark.sql.adaptive.enabled"), rows._jdf.queryExecution().toString()))
        return {"rows": rows}

    s = read_flow_stats(spark, write_poll_files(spark, SF_SMALL, flows=polls), streaming=True, max_files_per_trigger=1000)
    for_each_poll(s, run, out, os.path.join(out, "ckpt")).awaitTermination()
    assert seen and all(aqe == "true" and "StateStore" not in plan for aqe, plan in seen)
    assert spark.read.parquet(f"{out}/rows").count() == polls.count()
    assert os.listdir(f"{out}/_rows") == []


def test_slices_are_cut_by_rows(spark, monkeypatch):
    """A trigger's file holds about so many rows at most, however many there are; the
    decisions stay."""
    from netsieve.plans import q_stream
    from netsieve.plans.q_stateful import ST2_DEDUP, ST2_LIMIT, ST2_WINDOW
    from netsieve.operators.stateful import suppress_floods
    a = D.arrivals(spark, SF_SMALL).select("event_id", "ts", "dpid", "eth_src", "eth_dst", "ethertype")
    n = a.count()
    monkeypatch.setattr(q_stream, "SLICE_ROWS", n // 5)
    files = spark.read.parquet(q_stream._write_time_ordered(spark, a, "cut", 10 * 86400)).groupBy("slice").count()
    assert max(r["count"] for r in files.collect()) < n // 4 and files.agg(F.sum("count")).first()[0] == n
    got = q_stream.st2_suppress_stream(spark, SF_SMALL).where("event_id >= 0")
    want = suppress_floods(a, limit=ST2_LIMIT, window_sec=ST2_WINDOW, dedup_sec=ST2_DEDUP).select("event_id", "suppressed")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _flood(spark, start: str, sources: int, polls: int, at: int = 0):
    ids = spark.range(sources * polls)
    poll = F.expr(f"timestamp '{start}' + make_dt_interval(0, 0, 0, 5 * cast(id div {sources} as int))")
    return ids.select((F.col("id") + at).alias("event_id"), poll.cast("timestamp_ntz").alias("ts"), poll.cast("timestamp").alias("poll_ts"), F.lit(3).alias("dpid"), F.lit(10).alias("priority"),
                      F.concat_ws(".", F.lit("10"), (F.col("id") % sources / 65536).cast("int"), (F.col("id") % sources / 256 % 256).cast("int"), (F.col("id") % 256).cast("int")).alias("src_ip"),
                      F.concat(F.lit("10.0.0."), (F.col("id") % 7).cast("string")).alias("dst_ip"), F.lit(17).alias("ip_proto"), F.lit(0).alias("icmp_code"), F.lit(0).alias("icmp_type"),
                      F.lit(1).cast("long").alias("duration_sec"), F.lit(50_000).cast("long").alias("packet_count"), F.lit(100_000).cast("long").alias("byte_count"))


def test_carried_rows_end(spark, tmp_path):
    """10^5 spoofed sources, then quiet: what is carried falls to nothing."""
    out = str(tmp_path)
    flood = _flood(spark, "2024-01-01 00:00:00", 100_000, 1)
    first = detect_and_block(flood, switches_df(spark), min_sources=10**9, ttl_sec=60, block_sec=100)
    sizes = []
    for name in ("flow_state", "block_state"):
        first[name].write.parquet(f"{out}/{name}")
        sizes.append(spark.read.parquet(f"{out}/{name}").count())
    assert sizes == [100_000, 100_000]
    later = _flood(spark, "2024-01-01 00:10:00", 3, 1, at=10**6)
    carried = {name: spark.read.parquet(f"{out}/{name}") for name in ("flow_state", "block_state")}
    second = detect_and_block(later.withColumn("packet_count", F.lit(1).cast("long")), switches_df(spark), carried, min_sources=10**9, ttl_sec=60, block_sec=100)
    assert second["flow_state"].count() == 3 and second["block_state"].count() == 0 and second["detections"].count() == 0


def _last_state_rows(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


@pytest.mark.parametrize("chain", ["blocks", "admit"])
def test_streaming_state_ends(spark, tmp_path, chain):
    day = datetime.datetime(2024, 1, 1)
    rows = spark.range(600).select(F.col("id").alias("event_id"), F.lit(day).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("s"), "id").alias("block_src"),
                                      F.lit("10.0.0.1").alias("dst_ip"), F.lit(17).alias("ip_proto"), F.lit(60).alias("timeout_sec"))
    beat = rows.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.lit(day + datetime.timedelta(hours=1)).cast("timestamp_ntz")})
    src = str(tmp_path / "in")
    rows.repartition(2).write.parquet(src + "/a=1")
    beat.coalesce(1).write.parquet(src + "/a=2")
    for f, at in (("a=1", 1_700_000_000), ("a=2", 1_700_000_900)):
        for name in os.listdir(f"{src}/{f}"):
            os.utime(f"{src}/{f}/{name}", (at, at))
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(src)
    s = block_stream(s) if chain == "blocks" else admit_stream(s.withColumn("key", F.col("block_src")), "key", 5, 1.0)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = _last_state_rows(q)
    assert max(seen) >= 600 and seen[-1] <= 1, seen
    assert spark.read.parquet(str(tmp_path / "out")).count() == 601


def test_the_model_scores_every_flow(spark, tmp_path, monkeypatch):
    """Polls of more flows than the other streams sample: with a model that calls every
    flow an attack, every eligible flow with a known source is a detection."""
    from netsieve.plans import q_stream
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 2 as int), 0, 0, cast(id as int))")
    spark.range(1, 201).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"),
                               F.when(F.col("id") % 50 != 0, F.col("id") / 20).alias("value"), F.lit('{"k": 5}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(q_stream, "trained_scorer", lambda spark, sf: lambda f: f.withColumn("attack_prob", F.lit(0.9)))
    got = [r["event_id"] for r in q_stream.st7_model_stream(spark, str(tmp_path)).collect()]
    flows = eligible_flows(D.flows(spark, str(tmp_path))).where("src_ip is not null")
    assert flows.groupBy("poll_ts").count().agg(F.min("count")).first()[0] > 2 * WHOLE["sample_n"]
    assert sorted(got) == sorted(r["event_id"] for r in flows.select("event_id").collect())
