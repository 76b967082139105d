"""Splits, balancing, ROC/AUC and KS against brute force."""
import random

import numpy as np

from pyspark.sql import functions as F

from netsieve.operators.metrics import auc, binary_metrics, ks_drift, roc_points
from netsieve.operators.ml import stratified_split, temporal_split, undersample


def _labelled(spark, n=400, pos=0.3):
    rnd = random.Random(11)
    rows = [(i, int(rnd.random() < pos), round(rnd.random(), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id LONG, label INT, score DOUBLE"), rows


def test_stratified_split_sizes_exact(spark):
    df, rows = _labelled(spark)
    s = stratified_split(df, "id", 0.75, 42).toPandas()
    for lab in (0, 1):
        n = sum(1 for r in rows if r[1] == lab)
        assert (s[(s.label == lab) & (s.split == "train")].shape[0]) == round(0.75 * n)


def test_temporal_split_first_rows(spark):
    df, _ = _labelled(spark)
    s = temporal_split(df, ["id"], 0.7).toPandas()
    assert set(s[s.split == "train"]["id"]) == set(range(280))


def test_undersample_parity(spark):
    df, _ = _labelled(spark)
    u = undersample(df, "id", 42).toPandas()
    c = u.groupby("label").size()
    assert c[0] == c[1]


def test_auc_equals_pairwise(spark):
    df, rows = _labelled(spark)
    a = auc(df).first()["auc"]
    pos = [r[2] for r in rows if r[1] == 1]
    neg = [r[2] for r in rows if r[1] == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(a - brute) < 1e-12
    pts = roc_points(df).toPandas().sort_values(["fpr", "tpr"])
    trap = np.trapezoid(pts["tpr"], pts["fpr"])
    assert abs(trap - brute) < 1e-9
    assert pts["tpr"].is_monotonic_increasing


def test_ks_statistic_brute_force(spark):
    rnd = random.Random(2)
    a = [rnd.gauss(0, 1) for _ in range(300)]
    b = [rnd.gauss(0.3, 1) for _ in range(250)]
    ta = spark.createDataFrame([(x,) for x in a], "f DOUBLE")
    tb = spark.createDataFrame([(x,) for x in b], "f DOUBLE")
    got = ks_drift(ta, tb, ["f"]).first()
    grid = sorted(set(a + b))
    d = max(abs(sum(x <= g for x in a) / len(a) - sum(x <= g for x in b) / len(b)) for g in grid)
    assert abs(got["statistic"] - d) < 1e-12
    assert 0.0 <= got["p_value"] <= 1.0


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label INT, prediction INT")
    r = binary_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_auc_of_large_counts(spark):
    """Rank sums beyond 64 bits: 3e9 rows a class."""
    from netsieve.operators import metrics
    counts = spark.createDataFrame([(0.1, 1_000_000_000, 2_000_000_000), (0.2, 0, 1_000_000_000), (0.9, 2_000_000_000, 0)], "score double, pos long, neg long")
    old = metrics._score_counts
    metrics._score_counts = lambda *a: counts
    try:
        r = metrics.auc(counts).first()
    finally:
        metrics._score_counts = old
    assert r["auc"] == (1e9 * 1e9 + 2e9 * 3e9) / (3e9 * 3e9)
    assert (r["positives"], r["negatives"]) == (3_000_000_000, 3_000_000_000)


def test_dataset_report_wants_both_labels(spark):
    from netsieve.operators.aggregates import dataset_report
    from netsieve.schema import FEATURE_NAMES
    from pyspark.sql import functions as F
    df = spark.range(4).select(*[F.lit(-1.0 if n not in ("packet_count", "byte_count") else 1.0).alias(n) for n in FEATURE_NAMES], F.lit(0).alias("label"))
    got = {r["check"]: r["status"] for r in dataset_report(df).collect()}
    assert got["labels"] == "FAIL" and got["negatives"] == "PASS"


def test_splits_equal_sorting(spark):
    """Cuts by refined histograms against plain sorting, for uneven classes, with
    one row, and without any; the wide table is not sorted."""
    from decimal import ROUND_HALF_EVEN, Decimal

    from pyspark.sql import functions as F

    from netsieve.operators.ml import seeded_hash
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, 2).when(F.col("id") % 3 == 0, 1).when(F.col("id") == 7, 5).otherwise(0).alias("label"), F.lit("x").alias("wide"))
    rows = df.withColumn("h", seeded_hash("id", 9)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["label"], []).append((r["h"], r["id"]))
    small = min(map(len, by.values()))
    got = undersample(df, "id", 9)
    assert {r["id"] for r in got.collect()} == {i for v in by.values() for _, i in sorted(v)[:small]} and got.columns == df.columns
    for frac in (0.75, 0.1, 0.0, 1.0):
        want = {i for v in by.values() for _, i in sorted(v)[:int(Decimal(len(v) * frac).quantize(0, ROUND_HALF_EVEN))]}
        split = stratified_split(df, "id", frac, 9)
        assert {r["id"] for r in split.where("split = 'train'").collect()} == want and split.count() == 3000
        first = temporal_split(df, ["label", "id"], frac)
        order = sorted((r["label"], r["id"]) for r in rows)
        assert {r["id"] for r in first.where("split = 'train'").collect()} == {i for _, i in order[:int(3000 * frac)]}
    assert stratified_split(df.limit(0), "id").collect() == [] and temporal_split(df.limit(0), ["id"]).collect() == []
    plan = stratified_split(df, "id", 0.75, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan or "wide" not in plan.split("Sort [")[1].split("\n")[0]


def test_copies_at_the_cut_are_divided(spark):
    """A third of a class shares one id, with other contents or as copies: counts
    stay exact wherever the cut falls, and other partitions give the same rows."""
    from pyspark.sql import functions as F

    label = (F.col("id") % 2).cast("int").alias("label")
    unique = spark.range(600).select("id", label, F.lit(0).alias("v"))
    shared = spark.range(300).select((F.col("id") % 2 - 7).alias("id"), label, F.when(label == 0, F.col("id")).otherwise(1).cast("int").alias("v"))
    df = unique.unionByName(shared).repartition(5)
    divided = {}
    for fifths in (1, 2, 3, 4):  # a third of the hashes' order is one id: one of these cuts it
        s = stratified_split(df, "id", fifths / 5, 42).cache()
        n = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
        assert n == {(l, side): (90 if side == "train" else -90) * fifths + (0 if side == "train" else 450) for l in (0, 1) for side in ("train", "test")}
        for r in s.where("id < 0").groupBy("label").agg(F.count_distinct("split").alias("sides")).where("sides = 2").collect():
            divided.setdefault(r["label"], (fifths, s))
    assert set(divided) == {0, 1}
    for fifths, s in divided.values():
        assert sorted(map(tuple, s.collect())) == sorted(map(tuple, stratified_split(df.repartition(3, "v"), "id", fifths / 5, 42).collect()))
    fewer = undersample(df.where("label = 1 or id >= 300"), "id", 42).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in fewer} == {0: 150, 1: 150}


def test_one_row_tables_are_worked_out_once(spark):
    """Scaler, class weights and ranges are read from their checkpoint by each pass
    over the rows they are joined to, and hold no plan of the rows."""
    from netsieve.operators.ml import apply_scaler, feature_ranges, fit_scaler, with_class_weights
    df = spark.range(40).select(F.col("id").cast("double").alias("a"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    scaled = apply_scaler(df, fit_scaler(df, ["a"]), ["a"])
    for x in (fit_scaler(df, ["a"]), feature_ranges(df, ["a"]), scaled, with_class_weights(scaled)):
        assert "Aggregate" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["label"], r["weight"]) for r in with_class_weights(df).collect()} == {(1, 2.0), (0, 40 / 60)}
    assert feature_ranges(df, ["a"]).first()[0] == 39.0 and abs(scaled.agg(F.avg("a")).first()[0]) < 1e-9


def test_training_partitions_grow_with_the_rows(spark, monkeypatch):
    from netsieve.operators import ml
    df = spark.range(1000).coalesce(1)
    assert ml._fit_partitions(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(ml, "FIT_ROWS", 100)
    cut = ml._fit_partitions(df)
    assert max(cut.rdd.glom().map(len).collect()) <= 100 and cut.distinct().count() == 1000
    assert ml._fit_partitions(spark.range(0)).count() == 0
