"""Episode chains split across time buckets (exact, parallel inside a key).

An *episode chain* is the rule shared by the resetting-window limiter (ST1)
and block episodes (ST3): an event opens an episode when no episode of its
key is open; the episode opened by event i lasts ``d_i`` (open while
``t < t_i + d_i``); later events inside it are absorbed. Which events open
depends on every earlier decision, so a plain window cannot state it, and a
sorted walk puts a whole key in one task.

Here each key's timeline is cut into buckets of width ``W >= max d``, so an
episode spills into at most the next bucket:

1. per (key, bucket), in parallel: for every event i, ``exit_i`` = end of
   the last episode of the bucket if i opens the bucket's first episode
   (reverse pass, next opener found by binary search). Only the events that
   can be a bucket's first opener are kept as *candidates*: those before
   ``bucket start + max d`` plus the first one after it.
2. per key, a sorted walk over the candidates only (about ``max d / W`` of
   the rows): the true first opener of each bucket is the first candidate at
   or after the end of the previous bucket's last episode.
3. per (key, bucket), in parallel: from the true first opener, follow the
   next-opener links and mark the openers.

Each group of steps 1 and 3 holds one key's events of one bucket: its size is
set by ``W``, not by how hot the key is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.operators._runs import group_runs, keyed_scan
from netsieve.operators._split import _null_safe_join


def _next_index(us: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each i, the first index j with us[j] >= end[i] (len(us) if none).
    ``us`` is sorted ascending."""
    return np.searchsorted(us, end, side="left")


def episode_openers(df: DataFrame, keys: list[str], ts: str, tie: str, dur_us_col: str,
                    bucket_sec: float, max_dur_sec: float) -> DataFrame:
    """Add ``opens`` (bool) to every row. ``dur_us_col``: the episode length
    (microseconds) an event gives when it opens. Requires
    ``bucket_sec >= max_dur_sec`` (checked)."""
    from netsieve.session import ship_package

    if bucket_sec < max_dur_sec:
        raise ValueError("bucket width must be at least the longest episode")
    ship_package(df.sparkSession)
    w_us = int(round(bucket_sec * 1e6))
    dmax_us = int(round(max_dur_sec * 1e6))
    x = (df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
           .withColumn("__d", F.col(dur_us_col).cast("long")))
    x = x.withColumn("__b", F.floor(F.col("__us") / w_us).cast("long"))

    # 1. candidates with their place in the bucket and their exit, per (key, bucket)
    def candidates(c: dict):
        us = c["__us"]
        end = us + c["__d"]
        nxt = _next_index(us, end)
        n = len(us)
        exit_ = np.empty(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            exit_[i] = exit_[nxt[i]] if nxt[i] < n else end[i]
        bstart = int(c["__b"][0]) * w_us
        limit = int(np.searchsorted(us, bstart + dmax_us, side="left"))  # first event at/after bs + max d
        k = min(limit + 1, n)
        return np.arange(k), {"__pos": np.arange(k), "__exit": exit_[:k]}

    # only keys, time, tie and duration travel; the tie may be of any type that sorts
    base = x.select(*keys, "__b", "__us", F.col(tie).alias("__tie"), "__d")
    cand = group_runs(base, [*keys, "__b"], ["__us", "__tie"], candidates, ["__b", "__us", "__d"], [*keys, "__b", "__us"],
                      [("__pos", T.LongType()), ("__exit", T.LongType())])

    # 2. true first opener per bucket: a walk over the candidates of each key
    def choose(st, c, s, e, out):
        end_prev = st.get("end")          # end of the last episode so far
        cur_b, done = st.get("b"), st.get("done", False)
        bs, us, ex = c["__b"], c["__us"], c["__exit"]
        for i in range(s, e):
            if bs[i] != cur_b:
                cur_b, done = bs[i], False
            if not done and (end_prev is None or us[i] >= end_prev):
                out["__chosen"][i] = True
                end_prev, done = int(ex[i]), True
            else:
                out["__chosen"][i] = False
        st.update(end=end_prev, b=cur_b, done=done)

    chosen = keyed_scan(cand, keys, ["__b", "__pos"], dict, choose, [("__chosen", T.BooleanType(), "bool")])
    first = chosen.filter("__chosen").select(*keys, "__b", F.col("__pos").alias("__o_pos"))

    # 3. mark the openers inside each bucket from its true first opener
    j = _null_safe_join(x, first, keys)

    def mark(c: dict):
        us = c["__us"]
        n = len(us)
        opens = np.zeros(n, dtype=bool)
        if c["__o_pos"][0] == c["__o_pos"][0]:  # not NULL
            nxt = _next_index(us, us + c["__d"])
            i = int(c["__o_pos"][0])
            while i < n:
                opens[i] = True
                i = int(nxt[i])
        return None, {"opens": opens}

    return group_runs(j, [*keys, "__b"], ["__us", tie], mark, ["__us", "__d", "__o_pos"], list(df.columns), [("opens", T.BooleanType())])


# --- circuit breaker split across buckets ----------------------------------------

def _breaker_step(state, t, ok, fail_max, r_us, succ_thr):
    """One call through the breaker. States: ("C", fails), ("H", successes),
    ("O", last_failure_us). Returns (state, used_fallback, counted_failure)."""
    mode, v = state
    if mode == "O" and t - v >= r_us:
        mode, v = "H", 0
    if mode == "O":
        return (mode, v), True, False
    if ok:
        if mode == "H":
            v += 1
            return (("C", 0) if v >= succ_thr else ("H", v)), False, False
        return ("C", 0), False, False
    if mode == "H":
        return ("O", t), True, True
    v += 1
    return (("O", t) if v >= fail_max else ("C", v)), True, True


def breaker_split(df: DataFrame, key: str, ts: str, tie: str, ok: str, fail_max: int, reset_sec: float,
                  success_threshold: int, bucket_sec: float) -> DataFrame:
    """ST6 replay, parallel inside one model's series. Adds ``state``,
    ``use_fallback``, ``total_failures``, ``total_fallbacks``."""
    from netsieve.session import ship_package
    from netsieve.operators._split import split_running

    if bucket_sec < reset_sec:
        raise ValueError("bucket width must be at least the reset time")
    ship_package(df.sparkSession)
    w_us, r_us = int(round(bucket_sec * 1e6)), int(round(reset_sec * 1e6))
    x = (df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
           .withColumn("__b", F.floor(F.col("__us") / w_us).cast("long")))
    discrete = [("C", f) for f in range(fail_max)] + [("H", s) for s in range(success_threshold)]

    # 1. exit state of each bucket for every possible entry state
    def exits(c: dict):
        t = c["__us"]
        okv = c[ok].astype(bool)
        n = len(t)
        bs = int(c["__b"][0]) * w_us
        m = int(np.searchsorted(t, bs + r_us, side="left"))
        entries = [(k, v, None) for k, v in discrete] + [("O", k, int(t[k])) for k in range(min(m + 1, n))]
        starts: dict[int, list[int]] = {}
        groups: dict = {}
        for eid, (kind, param, _) in enumerate(entries):
            if kind == "O":
                starts.setdefault(param, []).append(eid)
            else:
                groups.setdefault((kind, param), []).append(eid)
        for i in range(n):
            for eid in starts.get(i, []):
                groups.setdefault(("H", 0), []).append(eid)
            nxt: dict = {}
            for st, eids in groups.items():
                ns, _, _ = _breaker_step(st, int(t[i]), bool(okv[i]), fail_max, r_us, success_threshold)
                nxt.setdefault(ns, []).extend(eids)
            groups = nxt
        out = [None] * len(entries)
        for st, eids in groups.items():
            for eid in eids:
                out[eid] = st
        ne = len(entries)
        return np.zeros(ne, np.int64), {
                "__kind": np.array([e[0] for e in entries], dtype=object),
                "__param": np.array([e[1] for e in entries], dtype=np.int64),
                "__cand_us": np.array([e[2] for e in entries], dtype=object),
                "__x_mode": np.array([st[0] for st in out], dtype=object),
                "__x_val": np.array([int(st[1]) for st in out], dtype=np.int64)}

    base = x.select(key, "__b", "__us", F.col(tie).alias("__tie"), ok)
    long, text = T.LongType(), T.StringType()
    ex = group_runs(base, [key, "__b"], ["__us", "__tie"], exits, ["__b", "__us", ok], [key, "__b"],
                    [("__kind", text), ("__param", long), ("__cand_us", long), ("__x_mode", text), ("__x_val", long)])

    # 2. the true entry of each bucket: walk the exit table of each model
    order_key = (F.when(F.col("__kind") == "C", 0).when(F.col("__kind") == "H", 1).otherwise(2) * (1 << 40)
                 + F.coalesce(F.col("__cand_us") - F.col("__b") * w_us, F.col("__param")))
    ex = ex.withColumn("__ord", order_key)

    def choose(st, c, s, e, out):
        cur_b = st.get("b")
        entry = st.get("entry", ("C", 0))
        nxt = st.get("next")
        done = st.get("done", False)
        for i in range(s, e):
            b = c["__b"][i]
            if b != cur_b:
                if cur_b is not None and done:
                    entry = nxt
                cur_b, done, nxt = b, False, None
            kind, param, cand = c["__kind"][i], int(c["__param"][i]), c["__cand_us"][i]
            hit = False
            if not done:
                if entry[0] == "O":
                    hit = kind == "O" and cand is not None and cand == cand and int(cand) - entry[1] >= r_us
                else:
                    hit = kind == entry[0] and param == entry[1]
            if hit:
                done, nxt = True, (c["__x_mode"][i], int(c["__x_val"][i]))
            out["__chosen"][i] = hit
        st.update(b=cur_b, entry=entry, next=nxt, done=done)

    chosen = keyed_scan(ex, [key], ["__b", "__ord"], dict, choose, [("__chosen", T.BooleanType(), "bool")])
    first = chosen.filter("__chosen").select(key, "__b", "__kind", "__param")

    # 3. replay each bucket from its true entry
    j = _null_safe_join(x, first, [key])
    names = {"C": "closed", "H": "half_open", "O": "open"}

    def replay(c: dict):
        t = c["__us"]
        okv = c[ok].astype(bool)
        n = len(t)
        kind, param = c["__kind"][0], c["__param"][0]
        states = np.empty(n, dtype=object)
        fb = np.ones(n, dtype=bool)
        fail = np.zeros(n, dtype=np.int64)
        if kind is None or (isinstance(kind, float) and kind != kind):
            start, st = n, None               # still open for the whole bucket
        elif kind == "O":
            start, st = int(param), ("H", 0)
        else:
            start, st = 0, (kind, int(param))
        states[:start] = "open"
        for i in range(start, n):
            st, used, counted = _breaker_step(st, int(t[i]), bool(okv[i]), fail_max, r_us, success_threshold)
            states[i], fb[i], fail[i] = names[st[0]], used, int(counted)
        return None, {"state": states, "use_fallback": fb, "__fail": fail}

    r = group_runs(j, [key, "__b"], ["__us", tie], replay, ["__us", ok, "__kind", "__param"], list(df.columns),
                   [("state", text), ("use_fallback", T.BooleanType()), ("__fail", long)])
    r = split_running(r, [key], [ts, tie], sums={"total_failures": F.col("__fail"),
                                                 "total_fallbacks": F.col("use_fallback").cast("long")},
                      bucket_sec=bucket_sec)
    return r.select(*df.columns, "state", "use_fallback",
                    F.col("total_failures").cast("long").alias("total_failures"),
                    F.col("total_fallbacks").cast("long").alias("total_fallbacks"))
