"""Order-dependent event chains (ST1-ST4, ST6) in batch form.

Each decision depends on earlier *decisions*, so no window function states
it. Batch form: hash-partition by the chain key, sort each partition by
(key, time, id) and walk it with ``mapInPandas`` carrying one small state per
key, reset on key change. Memory is O(1) per task whatever the key sizes:
batches stream through the iterator and no group is ever materialised.
(The same ``step`` functions drive ``applyInPandasWithState`` in
``netsieve.streaming``.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.operators import _runs


def keyed_scan(df: DataFrame, keys: list[str], ts: str, tie: str, make_state: Callable[[], dict], step: Callable,
               out_fields: list[tuple[str, T.DataType, str]], num_partitions: int | None = None) -> DataFrame:
    """Sorted per-key walk by (``ts``, ``tie``); ``cols["__us"]`` has epoch
    microseconds, and timestamp outputs are written as such."""
    from netsieve.session import ship_package
    ship_package(df.sparkSession)
    x = df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    return _runs.keyed_scan(x, keys, ["__us", tie], make_state, step, out_fields, num_partitions).drop("__us")


def _method(method: str) -> bool:
    """True for the parallel path. ``walk``, one sorted walk per key, is the plain
    statement of the same rule, for tests."""
    if method not in ("split", "walk"):
        raise ValueError(f"unknown method {method!r}")
    return method == "split"


# --- ST1: resetting-window admission ---------------------------------------

def admit(df: DataFrame, key: list[str], ts: str = "ts", tie: str = "event_id",
          limit: int = 100, window_sec: float = 1.0, method: str = "split",
          bucket_sec: float | None = None, weight: str | None = None) -> DataFrame:
    """ST1: a key's window opens at its first event and closes when the
    elapsed time reaches ``window_sec``; the next event opens a new one.
    Events are admitted while fewer than ``limit`` were admitted in the
    window. Adds ``admitted`` and ``window_start``.

    Window openers come from the bucketed episode chain
    (parallel inside a key, e.g. one switch), then the position inside the
    window from split running sums. ``method="walk"``: one sorted walk per
    key. ``weight`` (split only) names a column that says for how many arrivals
    a row stands: a stream's open window is carried as one row."""
    w_us = int(round(window_sec * 1e6))
    if _method(method):
        from netsieve.operators._chain import episode_openers
        from netsieve.operators._split import split_running
        b = bucket_sec or max(60.0 * window_sec, window_sec)
        o = episode_openers(df.withColumn("__dur", F.lit(w_us).cast("long")), key, ts, tie, "__dur",
                            b, window_sec).drop("__dur")
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        n = (F.col(weight) if weight else F.lit(1)).cast("long")
        r = split_running(o, key, [ts, tie], sums={"__pos": n}, bucket_sec=b)
        r = split_running(r, key, [ts, tie], maxes={"__before": F.when(F.col("opens"), F.col("__pos") - n),
                                                    "__start_us": F.when(F.col("opens"), us)}, bucket_sec=b)
        return r.select(*df.columns,
                        (F.col("__pos") - F.col("__before") <= limit).alias("admitted"),
                        F.timestamp_micros("__start_us").cast("timestamp_ntz").alias("window_start"))

    def step(st, c, s, e, out):
        us, adm, wst = c["__us"], out["admitted"], out["window_start"]
        start, cnt = st.get("start"), st.get("cnt", 0)
        for i in range(s, e):
            t = us[i]
            if start is None or t - start >= w_us:
                start, cnt = t, 0
            if cnt < limit:
                cnt += 1
                adm[i] = True
            else:
                adm[i] = False
            wst[i] = start
        st["start"], st["cnt"] = start, cnt

    return keyed_scan(df, key, ts, tie, dict, step,
                      [("admitted", T.BooleanType(), "bool"), ("window_start", T.TimestampNTZType(), "int64")])


# --- ST2: flood suppression --------------------------------------------------

def suppress_floods(df: DataFrame, ts: str = "ts", tie: str = "event_id",
                    switch_key: list[str] | None = None, flow_key: list[str] | None = None,
                    limit: int = 100, window_sec: float = 1.0, dedup_sec: float = 1.0,
                    method: str = "split", bucket_sec: float | None = None) -> DataFrame:
    """ST2: per switch the ST1 limiter first; then an event is suppressed when
    the last *admitted* event of the same (switch, src, dst, ethertype) is
    less than ``dedup_sec`` old; suppressed events do not refresh it.
    Adds ``suppressed``.

    The dedup is itself an episode chain: a passing event opens a
    suppression episode of ``dedup_sec`` that absorbs later events, and takes
    the bucketed parallel form too."""
    sk = switch_key or ["dpid"]
    fk = flow_key or ["dpid", "eth_src", "eth_dst", "ethertype"]
    a = admit(df, sk, ts, tie, limit, window_sec, method=method).drop("window_start")
    d_us = int(round(dedup_sec * 1e6))
    if _method(method):
        from netsieve.operators._chain import episode_openers
        ok = a.filter(F.col("admitted")).withColumn("__dur", F.lit(d_us).cast("long"))
        b = bucket_sec or max(60.0 * dedup_sec, dedup_sec)
        o = episode_openers(ok, fk, ts, tie, "__dur", b, dedup_sec)
        passed = o.select(*a.columns, (~F.col("opens")).alias("suppressed"))
        refused = a.filter(~F.col("admitted")).withColumn("suppressed", F.lit(True))
        return passed.unionByName(refused)

    def step(st, c, s, e, out):
        us, ok, sup = c["__us"], c["admitted"], out["suppressed"]
        last = st.get("last")
        for i in range(s, e):
            t = us[i]
            if not ok[i] or (last is not None and t - last < d_us):
                sup[i] = True
            else:
                sup[i] = False
                last = t
        st["last"] = last

    return keyed_scan(a, fk, ts, tie, dict, step, [("suppressed", T.BooleanType(), "bool")])


# --- ST3: block episodes -----------------------------------------------------

def block_episodes(det: DataFrame, key: list[str], ts: str = "ts", tie: str = "event_id",
                   timeout_col: str = "timeout_sec", cap_sec: float | None = None,
                   method: str = "split", bucket_sec: float = 3600.0) -> DataFrame:
    """ST3: a detection opens a block for its key unless one is open; hits
    inside an open block are absorbed. ``timeout_col`` holds the (jittered)
    timeout a detection would give if it opened the block; the block closes
    at start + timeout (or start + min(timeout, cap) with ``cap_sec``, the
    reference's 300 s cache re-arm). Adds ``opens``, ``start_ts``,
    ``expiry_ts`` (of the block the detection belongs to).

    ``method="split"``: openers from the bucketed episode chain (buckets at
    least as wide as the longest timeout; parallel inside a hot key),
    start/expiry as split running maxima. ``method="walk"``: one sorted walk
    per key."""
    if _method(method):
        from netsieve.operators._chain import episode_openers
        from netsieve.operators._split import split_running
        dur = F.col(timeout_col).cast("double")
        if cap_sec is not None:
            dur = F.least(dur, F.lit(float(cap_sec)))
        x = det.withColumn("__dur", F.round(dur * 1e6).cast("long"))
        max_d = x.agg(F.max("__dur")).first()[0] or 0  # one number
        b = max(bucket_sec, max_d / 1e6)
        o = episode_openers(x, key, ts, tie, "__dur", b, max_d / 1e6)
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        r = split_running(o, key, [ts, tie], maxes={"__s": F.when(F.col("opens"), us),
                                                    "__e": F.when(F.col("opens"), us + F.col("__dur"))},
                          bucket_sec=b)
        return r.select(*det.columns, "opens",
                        F.timestamp_micros("__s").cast("timestamp_ntz").alias("start_ts"),
                        F.timestamp_micros("__e").cast("timestamp_ntz").alias("expiry_ts"))

    def step(st, c, s, e, out):
        us, to = c["__us"], c[timeout_col]
        opens, s_arr, e_arr = out["opens"], out["start_ts"], out["expiry_ts"]
        start, exp = st.get("start"), st.get("exp")
        for i in range(s, e):
            t = us[i]
            if exp is None or t >= exp:
                dur = float(to[i]) if cap_sec is None else min(float(to[i]), cap_sec)
                start, exp = t, t + int(round(dur * 1e6))
                opens[i] = True
            else:
                opens[i] = False
            s_arr[i], e_arr[i] = start, exp
        st["start"], st["exp"] = start, exp

    return keyed_scan(det, key, ts, tie, dict, step,
                      [("opens", T.BooleanType(), "bool"), ("start_ts", T.TimestampNTZType(), "int64"),
                       ("expiry_ts", T.TimestampNTZType(), "int64")])


# --- ST4: address learning with ageing and a port limit ---------------------

def learn_macs(df: DataFrame, ts: str = "ts", tie: str = "event_id", max_macs: int = 5,
               age_sec: float = 300.0, mac: str = "eth_src", port: str = "in_port") -> DataFrame:
    """ST4: per switch, learn (MAC -> port) with a per-port limit of
    ``max_macs`` MACs; an entry older than ``age_sec`` at lookup time is
    aged out and frees its port slot. Adds ``learned`` (False = port
    security violation) and ``evicted_before`` (entries aged out by this
    event's lookup). State: the switch's table, bounded by ports x max_macs.
    Entries are kept in learn-time order, so ageing pops from the front."""
    a_us = int(round(age_sec * 1e6))

    def step(st, c, s, e, out):
        from collections import OrderedDict
        table = st.setdefault("table", OrderedDict())  # mac -> (port, ts), oldest first
        ports = st.setdefault("ports", {})             # port -> set(mac)
        us, macs, prt = c["__us"], c[mac], c[port]
        learned, evicted = out["learned"], out["evicted_before"]
        for i in range(s, e):
            t = us[i]
            ev = 0
            while table:
                m0, (p0, lt) = next(iter(table.items()))
                if t - lt <= a_us:
                    break
                table.popitem(last=False)
                ports.get(p0, set()).discard(m0)
                ev += 1
            evicted[i] = ev
            m, p = macs[i], int(prt[i])
            sset = ports.setdefault(p, set())
            if m not in sset and len(sset) >= max_macs:
                learned[i] = False
                continue
            sset.add(m)
            prev = table.pop(m, None)
            if prev is not None and prev[0] != p:
                ports.get(prev[0], set()).discard(m)
            table[m] = (p, t)
            learned[i] = True

    return keyed_scan(df, ["dpid"], ts, tie, dict, step,
                      [("learned", T.BooleanType(), "bool"), ("evicted_before", T.LongType(), "int64")])


# --- ST6: circuit-breaker replay --------------------------------------------

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


def breaker_states(df: DataFrame, model_key: str = "model", ts: str = "ts", tie: str = "event_id",
                   ok: str = "ok", fail_max: int = 5, reset_sec: float = 30.0,
                   success_threshold: int = 2, method: str = "split",
                   bucket_sec: float = 3600.0) -> DataFrame:
    """ST6: replay a per-model log of call outcomes through the breaker:
    closed -> open after ``fail_max`` consecutive failures; open -> half-open
    once ``reset_sec`` passed since the last failure; half-open -> closed
    after ``success_threshold`` successes, -> open on any failure. Calls that
    arrive while open use the fallback and change no counter. Adds
    ``state`` (after the call), ``use_fallback``, ``total_failures``,
    ``total_fallbacks``.

    ``method="split"``: each bucket (>= the reset time wide) is simulated
    from every possible entry state at once (identical states merge), a walk
    over the small exit table fixes each bucket's true entry, and a second
    per-bucket replay emits the rows (``operators/_chain.py``);
    ``"walk"``: one sorted walk per model."""
    if _method(method):
        from netsieve.operators._chain import breaker_split
        return breaker_split(df, model_key, ts, tie, ok, fail_max, reset_sec, success_threshold,
                             max(bucket_sec, reset_sec))
    r_us = int(round(reset_sec * 1e6))

    def step(st, c, s, e, out):
        us, oks = c["__us"], c[ok]
        states, fb, tf, tfb = out["state"], out["use_fallback"], out["total_failures"], out["total_fallbacks"]
        state = st.get("s", CLOSED)
        fails, succ, last = st.get("f", 0), st.get("c", 0), st.get("l")
        tot_f, tot_fb = st.get("tf", 0), st.get("tfb", 0)
        for i in range(s, e):
            t = us[i]
            used = False
            if state == OPEN and last is not None and t - last >= r_us:
                state, succ = HALF_OPEN, 0
            if state == OPEN:
                tot_fb += 1
                used = True
            elif bool(oks[i]):
                if state == HALF_OPEN:
                    succ += 1
                    if succ >= success_threshold:
                        state, fails, succ = CLOSED, 0, 0
                else:
                    fails = 0
            else:
                fails += 1
                tot_f += 1
                last = t
                if state == HALF_OPEN or fails >= fail_max:
                    state = OPEN
                tot_fb += 1
                used = True
            states[i], fb[i], tf[i], tfb[i] = state, used, tot_f, tot_fb
        st.update(s=state, f=fails, c=succ, l=last, tf=tot_f, tfb=tot_fb)

    return keyed_scan(df, [model_key], ts, tie, dict, step,
                      [("state", T.StringType(), "object"), ("use_fallback", T.BooleanType(), "bool"),
                       ("total_failures", T.LongType(), "int64"), ("total_fallbacks", T.LongType(), "int64")])


# --- ST5: adaptive-window drift (ADWIN) -------------------------------------

class _Adwin:
    """ADWIN2 (Bifet & Gavalda 2007): the window is an exponential histogram
    of buckets (at most ``max_buckets`` per size 2^i, each holding count,
    sum and variance); after each insert every boundary between buckets is a
    cut candidate W = W0 . W1 and the oldest bucket is dropped while
    |mean0 - mean1| > eps_cut, with
    eps_cut = sqrt(2/m * var_W * ln(2/d')) + 2/(3m) * ln(2/d'),
    m = 1 / (1/n0 + 1/n1), d' = delta / ln(n). Lower delta needs more
    evidence, i.e. it is *less* sensitive (Q15)."""

    def __init__(self, delta: float = 0.002, max_buckets: int = 5, min_sub: int = 5):
        self.delta, self.M, self.min_sub = delta, max_buckets, min_sub
        self.rows: list[list[list[float]]] = []  # rows[i] = [[n, total, var], ...] oldest first
        self.n, self.total, self.var = 0, 0.0, 0.0

    def _insert(self, x: float) -> None:
        if self.n > 0:
            mean = self.total / self.n
            self.var += self.n * (x - mean) ** 2 / (self.n + 1)
        self.n += 1
        self.total += x
        if not self.rows:
            self.rows.append([])
        self.rows[0].append([1, x, 0.0])
        i = 0
        while i < len(self.rows) and len(self.rows[i]) > self.M:
            a, b = self.rows[i].pop(0), self.rows[i].pop(0)
            n = a[0] + b[0]
            merged = [n, a[1] + b[1],
                      a[2] + b[2] + a[0] * b[0] / n * (a[1] / a[0] - b[1] / b[0]) ** 2]
            if i + 1 == len(self.rows):
                self.rows.append([])
            self.rows[i + 1].append(merged)
            i += 1

    def _drop_oldest(self) -> None:
        for i in range(len(self.rows) - 1, -1, -1):
            if self.rows[i]:
                b = self.rows[i].pop(0)
                n0, n1 = b[0], self.n - b[0]
                if n1 > 0:
                    m0, m1 = b[1] / b[0], (self.total - b[1]) / n1
                    self.var -= b[2] + n0 * n1 / self.n * (m0 - m1) ** 2
                else:
                    self.var = 0.0
                self.n -= b[0]
                self.total -= b[1]
                while self.rows and not self.rows[-1]:
                    self.rows.pop()
                return

    def update(self, x: float) -> bool:
        import math
        self._insert(x)
        changed, again = False, True
        while again and self.n > 2 * self.min_sub:
            again = False
            dprime = self.delta / max(math.log(self.n), 1.0)
            ln = math.log(2.0 / dprime)
            var_w = max(self.var / self.n, 0.0)
            n0, s0 = 0, 0.0
            # boundaries from oldest to newest
            for i in range(len(self.rows) - 1, -1, -1):
                for b in self.rows[i]:
                    n0 += b[0]
                    s0 += b[1]
                    n1 = self.n - n0
                    if n0 < self.min_sub or n1 < self.min_sub:
                        continue
                    m = 1.0 / (1.0 / n0 + 1.0 / n1)
                    eps = math.sqrt(2.0 / m * var_w * ln) + 2.0 / (3.0 * m) * ln
                    if abs(s0 / n0 - (self.total - s0) / n1) > eps:
                        self._drop_oldest()
                        changed = again = True
                        break
                if again:
                    break
        return changed


def adwin(df: DataFrame, key: list[str], value: str = "value", ts: str = "ts", tie: str = "event_id",
          delta: float = 0.002) -> DataFrame:
    """ST5: per key, feed values in time order to ADWIN; adds ``drift``
    (change detected at this value), ``window_size`` and ``drift_count``.
    State per key: the bucket lists, O(M log W)."""

    def step(st, c, s, e, out):
        a = st.get("a")
        if a is None:
            a = st["a"] = _Adwin(delta)
            st["c"] = 0
        vals = c[value]
        for i in range(s, e):
            v = vals[i]
            d = False
            if v is not None and v == v:  # NULL / NaN values are skipped
                d = a.update(float(v))
            if d:
                st["c"] += 1
            out["drift"][i], out["window_size"][i], out["drift_count"][i] = d, a.n, st["c"]

    return keyed_scan(df, key, ts, tie, dict, step,
                      [("drift", T.BooleanType(), "bool"), ("window_size", T.LongType(), "int64"),
                       ("drift_count", T.LongType(), "int64")])
