"""Event chains against plain Python replays (rate limiter, breaker, blocks,
flood suppression) and the reference's literal cases."""
import datetime as dt
import random

from pyspark.sql import functions as F

from netsieve.operators.stateful import admit, block_episodes, breaker_states, suppress_floods

T0 = dt.datetime(2024, 1, 1)


def _ts(sec):
    return T0 + dt.timedelta(seconds=sec)


def test_limit_five_per_second_sixth_refused(spark):
    rows = [(i, _ts(i * 0.1), 1) for i in range(6)] + [(6, _ts(1.2), 1), (7, _ts(0.3), 2)]
    df = spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP, dpid INT")
    r = {x["event_id"]: x["admitted"] for x in admit(df, ["dpid"], limit=5, window_sec=1.0).collect()}
    assert [r[i] for i in range(6)] == [True] * 5 + [False]
    assert r[6] is True          # window reset after elapsed >= 1 s
    assert r[7] is True          # keys are independent


def _replay_admit(events, limit, w):
    st, out = {}, {}
    for eid, t, k in sorted(events, key=lambda e: (e[1], e[0])):
        s = st.get(k)
        if s is None or t - s[0] >= w:
            s = [t, 0]
        if s[1] < limit:
            s[1] += 1
            out[eid] = True
        else:
            out[eid] = False
        st[k] = s
    return out


def test_admit_matches_replay_random(spark):
    rnd = random.Random(7)
    ev = [(i, rnd.uniform(0, 30), rnd.randint(1, 3)) for i in range(800)]
    df = spark.createDataFrame([(e, _ts(t), k) for e, t, k in ev], "event_id LONG, ts TIMESTAMP, dpid INT")
    got = {x["event_id"]: x["admitted"] for x in admit(df, ["dpid"], limit=7, window_sec=2.0).collect()}
    exp = _replay_admit([(e, round(t * 1e6), k) for e, t, k in ev], 7, 2_000_000)
    assert got == exp


def test_breaker_transitions(spark):
    # 5 failures open it; calls while open fall back; 30 s later half-open;
    # 2 successes close it; a failure in half-open re-opens it.
    seq = [(0, False), (1, False), (2, False), (3, False), (4, False), (5, True),
           (40, True), (41, True), (42, False), (43, False), (44, False), (45, False), (46, False),
           (80, False), (81, True)]
    df = spark.createDataFrame([(i, _ts(t), "m", ok) for i, (t, ok) in enumerate(seq)],
                               "event_id LONG, ts TIMESTAMP, model STRING, ok BOOLEAN")
    r = sorted(breaker_states(df).collect(), key=lambda x: x["event_id"])
    states = [x["state"] for x in r]
    assert states[:6] == ["closed"] * 4 + ["open", "open"]
    assert r[5]["use_fallback"] and r[5]["total_failures"] == 5
    assert states[6:8] == ["half_open", "closed"]
    assert states[12] == "open"            # five consecutive failures again
    assert states[13] == "open"            # half-open, failed again
    assert states[14] == "open"            # still inside the reset time: fallback


def test_block_episodes_absorb_and_rearm(spark):
    rows = [(0, _ts(0), "a", 300), (1, _ts(100), "a", 240), (2, _ts(299), "a", 240),
            (3, _ts(300), "a", 360), (4, _ts(10), "b", 250)]
    df = spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP, k STRING, timeout_sec INT")
    r = {x["event_id"]: (x["opens"], x["start_ts"], x["expiry_ts"]) for x in block_episodes(df, ["k"]).collect()}
    assert r[0][0] and not r[1][0] and not r[2][0] and r[3][0] and r[4][0]
    assert r[3][2] == _ts(660)
    capped = {x["event_id"]: x["expiry_ts"] for x in block_episodes(df, ["k"], cap_sec=200).collect()}
    assert capped[0] == _ts(200)


def test_flood_suppression(spark):
    rows = [(0, _ts(0.0)), (1, _ts(0.5)), (2, _ts(1.2)), (3, _ts(1.9)), (4, _ts(2.5))]
    df = spark.createDataFrame([(e, t, 3, "a", "b", 2048) for e, t in rows],
                               "event_id LONG, ts TIMESTAMP, dpid INT, eth_src STRING, eth_dst STRING, ethertype INT")
    r = {x["event_id"]: x["suppressed"] for x in suppress_floods(df, dedup_sec=1.0).collect()}
    # 0 admitted; 1 within 1 s of 0; 2 admitted (1.2 s after 0); 3 within 1 s of 2; 4 admitted
    assert r == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_split_chains_equal_walk(spark):
    """The bucketed episode chain equals the sorted walk (ST1 and ST3), also
    with one hot key and bucket widths close to the episode length."""
    rnd = random.Random(13)
    rows = [(i, _ts(rnd.uniform(0, 4000)), rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.randint(30, 90))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP, k STRING, timeout_sec INT")
    for b in (90.0, 400.0):
        walk = {r["event_id"]: (r["opens"], r["start_ts"], r["expiry_ts"])
                for r in block_episodes(df, ["k"], method="walk").collect()}
        split = {r["event_id"]: (r["opens"], r["start_ts"], r["expiry_ts"])
                 for r in block_episodes(df, ["k"], method="split", bucket_sec=b).collect()}
        assert split == walk
    for lim, w in ((3, 20.0), (1, 7.5)):
        walk = {r["event_id"]: (r["admitted"], r["window_start"])
                for r in admit(df, ["k"], limit=lim, window_sec=w, method="walk").collect()}
        split = {r["event_id"]: (r["admitted"], r["window_start"])
                 for r in admit(df, ["k"], limit=lim, window_sec=w, method="split", bucket_sec=3 * w).collect()}
        assert split == walk


def test_split_flood_suppression_equals_walk(spark):
    rnd = random.Random(17)
    rows = [(i, _ts(rnd.uniform(0, 600)), rnd.choice([1, 2]), rnd.choice(["m1", "m2", "m3"]), "ff", 2048)
            for i in range(1200)]
    df = spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP, dpid INT, eth_src STRING, eth_dst STRING, "
                                     "ethertype INT")
    kw = dict(limit=4, window_sec=2.0, dedup_sec=3.0)
    walk = {r["event_id"]: r["suppressed"] for r in suppress_floods(df, method="walk", **kw).collect()}
    split = {r["event_id"]: r["suppressed"] for r in suppress_floods(df, method="split", bucket_sec=9.0,
                                                                    **kw).collect()}
    assert split == walk and 0 < sum(walk.values()) < len(walk)


def test_split_breaker_equals_walk(spark):
    rnd = random.Random(23)
    t, rows = 0.0, []
    for i in range(1500):
        t += rnd.expovariate(1 / 4.0)           # ~4 s apart: open -> half-open happens inside buckets
        rows.append((i, _ts(t), rnd.choice(["m", "m", "n"]), rnd.random() > 0.35))
    df = spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP, model STRING, ok BOOLEAN")
    cols = ("state", "use_fallback", "total_failures", "total_fallbacks")
    walk = {r["event_id"]: tuple(r[c] for c in cols) for r in breaker_states(df, method="walk").collect()}
    for b in (30.0, 95.0):
        split = {r["event_id"]: tuple(r[c] for c in cols)
                 for r in breaker_states(df, method="split", bucket_sec=b).collect()}
        assert split == walk
    assert {v[0] for v in walk.values()} == {"closed", "open", "half_open"}


def _replay_learn(events, max_macs=5, age_us=300_000_000):
    """Plain replay of the address-table rules for one switch."""
    table, ports, out = {}, {}, {}
    for eid, t, mac, port in sorted(events, key=lambda e: (e[1], e[0])):
        for m in [m for m, (p, lt) in table.items() if t - lt > age_us]:
            p, _ = table.pop(m)
            ports[p].discard(m)
        s = ports.setdefault(port, set())
        if mac not in s and len(s) >= max_macs:
            out[eid] = False
            continue
        s.add(mac)
        if mac in table and table[mac][0] != port:
            ports[table[mac][0]].discard(mac)
        table[mac] = (port, t)
        out[eid] = True
    return out


def test_learn_macs_matches_replay(spark):
    from netsieve.operators.stateful import learn_macs
    rnd = random.Random(41)
    ev = [(i, rnd.uniform(0, 1500), f"m{rnd.randint(0, 14)}", rnd.randint(1, 2)) for i in range(700)]
    df = spark.createDataFrame([(e, _ts(t), 3, m, p) for e, t, m, p in ev],
                               "event_id LONG, ts TIMESTAMP, dpid INT, eth_src STRING, in_port INT")
    got = {r["event_id"]: r["learned"] for r in learn_macs(df).collect()}
    exp = _replay_learn([(e, round(t * 1e6), m, p) for e, t, m, p in ev])
    assert got == exp and not all(exp.values())


def test_chains_take_any_tie_and_keep_nullable_longs(spark):
    """A text tie, a key and a carried BIGINT with NULLs beyond 2**53."""
    big = 2 ** 53 + 1
    rows = [(f"e{i:03d}", big if i % 3 else None, big + i if i % 4 else None, float(i // 2), 5.0, i % 5 != 0, [i]) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id string, k long, n long, sec double, timeout_sec double, ok boolean, extra array<long>") \
        .withColumn("ts", F.timestamp_seconds("sec")).repartition(3)
    carried = {r[0]: (r[1], r[2], r[6]) for r in rows}
    for fn, cols in ((lambda m: admit(df, ["k"], limit=2, window_sec=4.0, method=m), ["admitted", "window_start"]),
                     (lambda m: block_episodes(df, ["k"], method=m), ["opens", "start_ts", "expiry_ts"]),
                     (lambda m: breaker_states(df, "k", reset_sec=3.0, fail_max=2, method=m), ["state", "use_fallback", "total_failures"])):
        split, walk = ({r["event_id"]: r for r in fn(m).collect()} for m in ("split", "walk"))
        assert split.keys() == walk.keys() == carried.keys()
        for e, r in split.items():
            assert (r["k"], r["n"], r["extra"]) == carried[e]
            assert [r[c] for c in cols] == [walk[e][c] for c in cols]


def test_group_runs_over_many_batches(spark):
    """One group far larger than an Arrow batch, many small ones around it."""
    from pyspark.sql import types as T

    from netsieve.operators._runs import group_runs
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(400).select(F.when(F.col("id") < 200, 5).otherwise(F.col("id") % 9).alias("k"), "id")
        got = group_runs(df, ["k"], ["id"], lambda c: (None, {"n": [len(c["id"])] * len(c["id"])}), ["id"], ["k", "id"], [("n", T.LongType())]).collect()
        want = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
        assert len(got) == 400 and all(r["n"] == want[r["k"]] for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
