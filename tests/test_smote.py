"""M5: exact nearest rows and synthetic minority rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netsieve.operators.ml import smote
from netsieve.operators.neighbours import _tops, nearest_rows


def plain(rows, k):
    ids, x = [r[0] for r in rows], np.array([r[1:] for r in rows], float).reshape(len(rows), -1)
    out = {}
    for i, a in zip(ids, x):
        d = np.zeros(len(x))
        for c in range(x.shape[1]):
            d += (a[c] - x[:, c]) * (a[c] - x[:, c])
        out[i] = [(float(e), j) for e, j in sorted(zip(d.tolist(), ids)) if j != i][:k]
    return out


def found(df, k, **options):
    out = {}
    for r in nearest_rows(df, "id", ["x", "y", "z"], k, **options).orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["d"], r["neighbour"]))
        assert len(out[r["id"]]) == r["rank"]
    return out


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id {kind}, x double, y double, z double")


@pytest.mark.parametrize("cell,tile", [(25, 16), (400, 1024)])
def test_nearest_rows_equal_brute_force(spark, cell, tile):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(700, 3)), rng.normal(size=(500, 3)) * 0.01 + 5, np.tile([[7.0, -7.0, 0.0]], (400, 1)),
                        rng.integers(0, 4, (380, 3)).astype(float), rng.normal(size=(20, 3)) * 1e6])
    rows = [(k, *v) for k, v in enumerate(x.tolist())]
    assert found(frame(spark, rows).repartition(5), 5, cell=cell, tile=tile) == plain(rows, 5)


def test_nearest_rows_of_odd_tables(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, -0.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0)]
    odd = rows + [(4, None, 0.0, 0.0), (5, float("nan"), 0.0, 0.0), (6, float("inf"), 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    assert found(frame(spark, odd), 5) == plain(rows, 5)
    assert found(frame(spark, rows[:1]), 5) == {}
    assert found(frame(spark, []), 5) == {}
    text = [(f"r{k}", float(k % 7), 0.0, 0.0) for k in range(40)]
    assert found(frame(spark, text, "string"), 3, cell=4) == plain(text, 3)


def test_smote_brings_classes_to_one_size(spark):
    rng = np.random.default_rng(5)
    rows = [(f"a{k}", 0, *v) for k, v in enumerate(rng.normal(size=(331, 2)).tolist())]
    rows += [(f"b{k}", 1, *v) for k, v in enumerate((rng.normal(size=(47, 2)) + 9).tolist())]
    rows += [("c", 2, 1.0, 2.0), ("d", 3, None, 1.0), ("e", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id string, label int, p double, q double")
    out = smote(df, "id", cols=["p", "q"]).collect()
    count = {c: sum(r["label"] == c for r in out) for c in (0, 1, 2, 3, None)}
    assert count == {0: 331, 1: 331, 2: 331, 3: 1, None: 1}
    own = {r[0]: r[2:] for r in rows}
    near = {i: {j for _, j in ns} for i, ns in plain([(r[0], *r[2:]) for r in rows if r[1] == 1], 5).items()}
    per = {}
    for r in out:
        if r["base"] is None:
            assert own[r["id"]] == (r["p"], r["q"])
            continue
        assert 0 <= r["u"] < 1
        if r["label"] == 2:
            assert r["neighbour"] is None and (r["p"], r["q"]) == (1.0, 2.0)
            continue
        assert r["neighbour"] in near[r["base"]]
        a, b = own[r["base"]], own[r["neighbour"]]
        assert (r["p"], r["q"]) == pytest.approx([s + r["u"] * (t - s) for s, t in zip(a, b)])
        per[r["base"]] = per.get(r["base"], 0) + 1
    assert set(per.values()) == {6, 7} and len({r["id"] for r in out}) == len(out)
    again = smote(df.repartition(7, F.rand(3)), "id", cols=["p", "q"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_tops_of_a_tile_equal_plain_sorting():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (700, 2)).astype(float)  # many ties
    asks = np.arange(700) < 300
    node = np.concatenate((np.arange(300), np.arange(100, 500)))  # some ask and are asked
    lists = [[f"{i}", f"{i}b"][: 1 + i % 2] for i in range(100, 500)]
    flat = [i for ids in lists for i in ids]
    at, d, which = _tops(node, v, asks, pa.array(lists), 5)
    got = {}
    for a, x, w in zip(at.tolist(), d.tolist(), which.tolist()):
        got.setdefault(a, []).append((x, flat[w]))
    for a in range(300):
        rows = [(float(((v[a] - v[300 + j]) ** 2).sum()), i) for j, ids in enumerate(lists) if node[300 + j] != node[a] for i in ids]
        assert got[a] == sorted(rows)[:5]
