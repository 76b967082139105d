"""Keyed chains on a stream without a key's rows in one worker (ST2, W7).

Events wait until the watermark has passed their time (``complete_polls``), so an
epoch's events are later than all of the epochs before and the order of files and
triggers changes nothing. An epoch is worked on by the batch operator, which cuts
hot keys into time buckets. What later epochs need, one row per open window,
suppression or session, are tables that an epoch hands to the next; the first row
of a key in time order is then the carried one, which opens its window, suppression
or session again. Rows that have run out are not written on, so the state falls
to zero once the events that made it are old.

Events without a time never come out. An event that arrives twice comes out once;
one that arrives after the watermark has passed its time is dropped. The last
events come out once later ones have been seen (a heartbeat serves).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.operators._prefix import _materialise
from netsieve.operators.stateful import admit
from netsieve.operators.windows import ttl_counter
from netsieve.streaming.detection import for_each_poll


def _micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def _fields(source: DataFrame, columns: list[str], more: str) -> str:
    return ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns] + [more])


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    new = rows.withColumn("__new", F.lit(True))
    return new.unionByName(carried.withColumn("__new", F.lit(False)), allowMissingColumns=True)


def _start(source: DataFrame, run, out_path: str, checkpoint: str, ts: str, tie: str, delay: str, carried: dict[str, str], **trigger):
    events = source.where(F.col(ts).isNotNull()).withColumn("__at", F.col(ts).cast("timestamp"))
    return for_each_poll(events, lambda rows, before: run(rows.drop("__at"), before), out_path, checkpoint, poll="__at", row_id=tie,
                         delay=delay, carried=carried, **trigger)


def suppress_stream(events: DataFrame, out_path: str, checkpoint: str, ts: str = "ts", tie: str = "event_id",
                    switch_key: list[str] | None = None, flow_key: list[str] | None = None, limit: int = 100, window_sec: float = 1.0,
                    dedup_sec: float = 1.0, delay: str = "2 seconds", **trigger):
    """ST2 on a stream: the limiter per switch, and on what it admits the flood
    suppression per flow; the same decisions as ``suppress_floods`` of all events.
    ``decisions`` gets the events with ``admitted`` and ``suppressed``; carried are
    the open ``windows`` (switch, start, arrivals so far) and the ``passed`` events
    that still suppress (flow, time). Returns the ``StreamingQuery``."""
    from netsieve.operators._chain import episode_openers
    sk = switch_key or ["dpid"]
    fk = flow_key or ["dpid", "eth_src", "eth_dst", "ethertype"]
    w_us, d_us = int(round(window_sec * 1e6)), int(round(dedup_sec * 1e6))
    at = f"`{ts}` {events.schema[ts].dataType.simpleString()}"

    def run(rows: DataFrame, before: dict[str, DataFrame]) -> dict[str, DataFrame]:
        newest = rows.agg(F.max(_micros(ts))).first()[0]
        arrivals = _with_carried(rows.withColumn("__n", F.lit(1).cast("long")), before["windows"])
        a = _materialise(admit(arrivals, sk, ts, tie, limit, window_sec, weight="__n"))  # read by all that follows
        windows = a.groupBy(*sk, "window_start").agg(F.sum("__n").alias("__n")).where(_micros("window_start") > newest - w_us)
        fresh = a.where("__new").drop("__new", "__n", "window_start")
        asked = _with_carried(fresh.where("admitted"), before["passed"]).withColumn("__dur", F.lit(d_us).cast("long"))
        o = _materialise(episode_openers(asked, fk, ts, tie, "__dur", max(60.0 * dedup_sec, dedup_sec), dedup_sec))
        passed = o.where("opens").groupBy(*fk).agg(F.max(ts).alias(ts)).where(_micros(ts) > newest - d_us)
        decided = o.where("__new").withColumn("suppressed", ~F.col("opens")).select(*fresh.columns, "suppressed")
        refused = fresh.where("not admitted").withColumn("suppressed", F.lit(True))
        return {"decisions": decided.unionByName(refused), "passed": passed,
                "windows": windows.select(*sk, F.col("window_start").cast(events.schema[ts].dataType).alias(ts), "__n")}

    carried = {"windows": _fields(events, sk, f"{at}, __n long"), "passed": _fields(events, fk, at)}
    return _start(events, run, out_path, checkpoint, ts, tie, delay, carried, **trigger)


def ttl_stream(events: DataFrame, key: list[str], out_path: str, checkpoint: str, ts: str = "ts", tie: str = "event_id",
               ttl_sec: float = 300.0, delay: str = "2 seconds", **trigger):
    """W7 on a stream: per key the counter that restarts at 1 after a gap of
    ``ttl_sec`` or more, as ``ttl_counter`` of all events counts. ``counts`` gets the
    events with ``counter``; carried are the ``sessions`` still open (key, last time,
    counter), without their number, which would have to be kept for ever.
    Returns the ``StreamingQuery``."""
    at = f"`{ts}` {events.schema[ts].dataType.simpleString()}"

    def run(rows: DataFrame, before: dict[str, DataFrame]) -> dict[str, DataFrame]:
        newest = rows.agg(F.max(_micros(ts))).first()[0]
        old = before["sessions"]
        c = ttl_counter(_with_carried(rows, old.drop("__count")), key, ts, tie, ttl_sec)
        named = old.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], "__count")
        same = F.lit(True)
        for i, k in enumerate(key):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        # the key's first session here is the carried one, if there is one
        went_on = F.when(F.col("session") == 1, F.coalesce(F.col("__count"), F.lit(1)) - 1).otherwise(0)
        c = _materialise(c.join(named, same, "left").select(*rows.columns, "__new", (F.col("counter") + went_on).alias("counter")))
        last = c.groupBy(*key).agg(F.max(F.struct(ts, tie, "counter")).alias("e"))
        sessions = last.where(_micros(f"e.{ts}") / 1e6 > newest / 1e6 - ttl_sec).select(*key, f"e.{ts}", F.col("e.counter").alias("__count"))
        return {"counts": c.where("__new").drop("__new"), "sessions": sessions}

    carried = {"sessions": _fields(events, key, f"{at}, __count long")}
    return _start(events, run, out_path, checkpoint, ts, tie, delay, carried, **trigger)
