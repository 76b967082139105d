"""Live detection on Structured Streaming (S8, ST7, streaming ST3).

* ``read_flow_stats``: the flow-stat poll source; batch or ``readStream``
  with a fixed schema and a per-trigger file cap (rate control instead of the
  reference's queue overflow, so nothing is dropped).
* ``complete_polls``: rows wait in the state store until the watermark has
  passed their poll, and come out poll by poll. The file cap, and how a poll is
  spread over files, therefore change nothing about the results.
* ``detection_stream``: the whole batch plan ``detect_and_block`` (F1 -> W1 -> A1
  -> J1 -> W3 -> P2 -> M10/M9 -> F3 -> J2 -> ST3 -> J3, S11) on complete polls.
  Detections, rules and the attack log go to folders ``epoch=<id>``, which a replayed
  epoch writes over (exactly-once). What later polls need of earlier ones, the
  last rows of flows and the open blocks, are tables too: an epoch reads those of
  the one before and writes its own, so no key's rows meet in one Python worker,
  and rows that can no longer matter are not written on.
* ``block_stream``: block episodes over the detection stream with
  ``applyInPandasWithState``; state per block key is (start, expiry). Episodes
  follow the order of time: a trigger must not deliver detections older than
  those of the triggers before it, which the detection stream's epochs, taken
  whole, do not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.plans.detection import CARRIED, detect_and_block
from netsieve.schema import switches_df

FLOW_STREAM_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("poll_ts", T.TimestampType()),
    T.StructField("dpid", T.IntegerType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("icmp_code", T.IntegerType()),
    T.StructField("icmp_type", T.IntegerType()),
    T.StructField("duration_sec", T.LongType()),
    T.StructField("packet_count", T.LongType()),
    T.StructField("byte_count", T.LongType()),
])


def read_flow_stats(spark: SparkSession, path: str, streaming: bool = False,
                    max_files_per_trigger: int = 8, fmt: str = "parquet") -> DataFrame:
    """Flow-stat replies of all switches. A switch that did not answer a
    poll simply has no rows in it."""
    if streaming:
        return (spark.readStream.format(fmt).schema(FLOW_STREAM_SCHEMA)
                .option("maxFilesPerTrigger", max_files_per_trigger).load(path))
    return spark.read.format(fmt).schema(FLOW_STREAM_SCHEMA).load(path)


def complete_polls(source: DataFrame, poll: str = "poll_ts", row_id: str = "event_id",
                   delay: str = "2 seconds") -> DataFrame:
    """Rows of a stream, held until their poll is complete: until a row of a poll
    more than ``delay`` later has been seen. All rows of a poll then come out
    in one micro-batch, whatever files and triggers they arrived in; a row that
    arrives twice comes out once. The rows of open polls wait in the state store;
    rows of a poll that has come out are late and dropped."""
    rows = F.struct(*[F.col(c) for c in source.columns])
    held = source.withWatermark(poll, delay).groupBy(poll, row_id).agg(F.first(rows).alias("__row"))
    return held.select("__row.*")


def for_each_poll(source: DataFrame, run: Callable[..., dict[str, DataFrame]], out_path: str, checkpoint: str,
                  poll: str = "poll_ts", row_id: str = "event_id", available_now: bool = True, processing_time: str | None = None,
                  carried: dict[str, str] | None = None, delay: str = "2 seconds"):
    """Apply the batch plan ``run`` to complete polls and write each table it
    returns under ``out_path``/name/epoch=N. A replayed epoch writes over its
    own folder only. ``carried`` names tables, with their schemas, that an epoch
    hands to the next: ``run`` gets those of the epoch before as its second
    argument; those of two epochs before are removed. Returns the
    ``StreamingQuery``.

    An epoch's rows are written aside and read back in the session of ``source``: a
    stream's own session plans without AQE, so every exchange of ``run`` would have
    all shuffle partitions, and each of their tasks would send back the metrics of
    the state store."""
    from netsieve.sources.datasets import _fs
    spark = source.sparkSession

    def batch(df: DataFrame, epoch_id: int) -> None:
        before = {}
        for name, kind in (carried or {}).items():
            fs, path = _fs(spark, f"{out_path}/{name}/epoch={epoch_id - 1}")
            before[name] = spark.read.schema(kind).parquet(path.toString()) if fs.exists(path) else spark.createDataFrame([], kind)
        aside = f"{out_path}/_rows/epoch={epoch_id}"
        df.write.mode("overwrite").parquet(aside)
        rows = spark.read.schema(df.schema).parquet(aside)
        if carried and rows.isEmpty():
            tables = before
        else:
            tables = run(rows, before) if carried else run(rows)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{out_path}/{name}/epoch={epoch_id}")
        fs, path = _fs(spark, aside)
        fs.delete(path, True)
        for name in carried or {}:
            fs, path = _fs(spark, f"{out_path}/{name}/epoch={epoch_id - 2}")
            fs.delete(path, True)

    w = complete_polls(source, poll, row_id, delay).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "3 seconds")
    return w.start()


def detection_stream(spark: SparkSession, source: DataFrame, out_path: str, checkpoint: str, switches: DataFrame | None = None,
                     available_now: bool = True, processing_time: str | None = None, **options):
    """ST7: start the detection stream; returns the ``StreamingQuery``. Each poll
    is worked on once it is complete. ``options`` are those of
    ``detect_and_block``; a ``scorer`` such as ``model_scorer`` adds ``attack_prob``
    to flows that the fast path did not catch (F3 then applies)."""
    switches = switches if switches is not None else switches_df(spark)

    def run(polls: DataFrame, before: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return detect_and_block(polls, switches, before, **options)

    return for_each_poll(source, run, out_path, checkpoint, available_now=available_now, processing_time=processing_time, carried=CARRIED)


def model_scorer(model, stats: DataFrame | None = None):
    """M9 as a scorer: ``attack_prob`` from a fitted model over the (scaled) live
    features; the features themselves stay as they are."""
    from netsieve.operators.ml import apply_scaler, score
    from netsieve.schema import FEATURE_NAMES

    def scorer(f: DataFrame) -> DataFrame:
        raw = F.struct(*[F.col(c) for c in FEATURE_NAMES])
        x = f.withColumn("__raw", raw)
        x = score(apply_scaler(x, stats) if stats is not None else x, model).drop("prediction")
        return x.withColumns({c: F.col(f"__raw.{c}") for c in FEATURE_NAMES}).drop("__raw")

    return scorer


BLOCK_STATE = "start_us LONG, exp_us LONG"
BLOCK_OUT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("block_src", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("opens", T.BooleanType()),
    T.StructField("start_ts", T.TimestampNTZType()),
    T.StructField("expiry_ts", T.TimestampNTZType()),
])


def _end_at(state, us: int) -> None:
    """Let a key's state end once the watermark has passed a time."""
    state.setTimeoutTimestamp(max(us // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def _episode_step(key, batches: Iterator[pd.DataFrame], state):
    """ST3 step for one block key: the same rule as the batch walk. The state ends
    with the block: what comes after its expiry opens a new one anyway."""
    if state.hasTimedOut:
        state.remove()
        return
    pdf = pd.concat(list(batches), ignore_index=True)
    pdf = pdf.sort_values(["__us", "event_id"], kind="mergesort")
    start, exp = (state.get if state.exists else (None, None))
    out = {c: [] for c in ("event_id", "opens", "start_us", "exp_us")}
    for eid, t, to in zip(pdf["event_id"], pdf["__us"], pdf["timeout_sec"]):
        opens = exp is None or t >= exp
        if opens:
            start, exp = int(t), int(t) + int(round(float(to) * 1e6))
        out["event_id"].append(int(eid))
        out["opens"].append(bool(opens))
        out["start_us"].append(start)
        out["exp_us"].append(exp)
    state.update((start, exp))
    _end_at(state, exp)
    res = pd.DataFrame({
        "event_id": out["event_id"], "block_src": key[0], "dst_ip": key[1], "ip_proto": key[2],
        "opens": out["opens"],
        "start_ts": pd.to_datetime(out["start_us"], unit="us"),
        "expiry_ts": pd.to_datetime(out["exp_us"], unit="us"),
    })
    yield res


def block_stream(detections: DataFrame) -> DataFrame:
    """Streaming ST3: ``detections`` (a stream with ``ts``, block key and
    ``timeout_sec``) -> one row per detection with its episode. Keys are the
    groups of ``applyInPandasWithState``; state survives restarts through the
    query checkpoint."""
    from netsieve.session import ship_package
    ship_package(detections.sparkSession)
    d = detections.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp"))) \
                  .withColumn("__wts", F.col("ts").cast("timestamp")) \
                  .withWatermark("__wts", "2 seconds")
    return (d.groupBy("block_src", "dst_ip", "ip_proto")
             .applyInPandasWithState(_episode_step, BLOCK_OUT, BLOCK_STATE, "append", "EventTimeTimeout"))


# --- streaming forms of the keyed chains (ST1, ST6) --------------------------

ADMIT_STATE = "start_us LONG, cnt LONG"


def admit_stream(events: DataFrame, key: str, limit: int = 100, window_sec: float = 1.0,
                 ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Streaming ST1: per key (a switch) the resetting-window limiter with
    (window start, count) kept in streaming state. Emits ``event_id``,
    ``admitted`` and ``window_start``. Arrival order is event order."""
    from netsieve.session import ship_package
    ship_package(events.sparkSession)
    w_us = int(round(window_sec * 1e6))
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField(tie, T.LongType()),
                        T.StructField("admitted", T.BooleanType()),
                        T.StructField("window_start", T.TimestampNTZType())])

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()  # the next event would start a new window
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["__us", tie], kind="mergesort")
        start, cnt = state.get if state.exists else (None, 0)
        adm, wst = [], []
        for t in pdf["__us"]:
            t = int(t)
            if start is None or t - start >= w_us:
                start, cnt = t, 0
            ok = cnt < limit
            cnt += int(ok)
            adm.append(ok)
            wst.append(start)
        state.update((start, cnt))
        _end_at(state, start + w_us)
        yield pd.DataFrame({key: k[0], tie: pdf[tie].astype("int64").to_numpy(), "admitted": adm,
                            "window_start": pd.to_datetime(wst, unit="us")})

    d = (events.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
               .withColumn("__wts", F.col(ts).cast("timestamp")).withWatermark("__wts", "2 seconds"))
    return d.groupBy(key).applyInPandasWithState(step, out, ADMIT_STATE, "append", "EventTimeTimeout")


BREAKER_STATE = "mode STRING, val LONG, tot_f LONG, tot_fb LONG"


def breaker_stream(outcomes: DataFrame, model_key: str = "model", ok: str = "ok", ts: str = "ts",
                   tie: str = "event_id", fail_max: int = 5, reset_sec: float = 30.0,
                   success_threshold: int = 2) -> DataFrame:
    """Streaming ST6: the breaker replay per model with its state machine and
    totals in streaming state (same transition function as the batch forms). The
    totals count from a model's first call on: a state per model stays."""
    from netsieve.operators._chain import _breaker_step
    from netsieve.session import ship_package
    ship_package(outcomes.sparkSession)
    r_us = int(round(reset_sec * 1e6))
    names = {"C": "closed", "H": "half_open", "O": "open"}
    out = T.StructType([T.StructField(model_key, outcomes.schema[model_key].dataType),
                        T.StructField(tie, T.LongType()), T.StructField("state", T.StringType()),
                        T.StructField("use_fallback", T.BooleanType()),
                        T.StructField("total_failures", T.LongType()),
                        T.StructField("total_fallbacks", T.LongType())])

    def step(k, batches, state):
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["__us", tie], kind="mergesort")
        mode, val, tf, tfb = state.get if state.exists else ("C", 0, 0, 0)
        st = (mode, int(val))
        rows = []
        for t, okv in zip(pdf["__us"], pdf[ok]):
            st, used, counted = _breaker_step(st, int(t), bool(okv), fail_max, r_us, success_threshold)
            tf += int(counted)
            tfb += int(used)
            rows.append((names[st[0]], used, tf, tfb))
        state.update((st[0], int(st[1]), int(tf), int(tfb)))
        yield pd.DataFrame({model_key: k[0], tie: pdf[tie].astype("int64").to_numpy(),
                            "state": [r[0] for r in rows], "use_fallback": [r[1] for r in rows],
                            "total_failures": [r[2] for r in rows], "total_fallbacks": [r[3] for r in rows]})

    d = (outcomes.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
                 .withColumn("__wts", F.col(ts).cast("timestamp")).withWatermark("__wts", "2 seconds"))
    return d.groupBy(model_key).applyInPandasWithState(step, out, BREAKER_STATE, "append", "NoTimeout")
