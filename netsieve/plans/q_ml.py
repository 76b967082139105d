"""Learning and evaluation queries (M1-M24, A16, A17) on the canonical
table mapped from the derived CIC-2017 flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.operators.metrics import (
    auc, binary_metrics, classification_report, ks_drift, roc_points)
from netsieve.operators.ml import (
    class_weights, fit_scaler, smote, stratified_split, temporal_split, undersample)
from netsieve.plans.catalog import register
from netsieve.plans.q_adapters import CANON_CTE, canonical_flows
from netsieve.schema import FEATURE_NAMES

HASH = "('0x' || substr(md5(flow_id || '|42'), 1, 8))::BIGINT"
SPLIT_CTE = CANON_CTE + f""",
split AS (SELECT c.*, CASE WHEN rn <= n_tr THEN 'train' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH}, flow_id) AS rn,
    round_even(count(*) OVER (PARTITION BY label) * 0.75, 0) AS n_tr FROM canon) c)"""


def split_canonical(spark, sf):
    return stratified_split(canonical_flows(spark, sf), "flow_id", 0.75, 42)


@register("m6_stratified_split", SPLIT_CTE + "\nSELECT flow_id, label, split FROM split")
def m6_stratified_split(spark, sf):
    return split_canonical(spark, sf).select("flow_id", "label", "split")


@register("m7_temporal_split", CANON_CTE + """
SELECT flow_id, CASE WHEN row_number() OVER (ORDER BY cast(flow_id AS bigint)) <= floor(count(*) OVER () * 0.7)
  THEN 'train' ELSE 'test' END AS split FROM canon""")
def m7_temporal_split(spark, sf):
    c = canonical_flows(spark, sf).withColumn("__o", F.col("flow_id").cast("bigint"))
    return temporal_split(c, ["__o"], 0.70).select("flow_id", "split")


@register("m4_undersample", CANON_CTE + f"""
SELECT flow_id, label FROM (
  SELECT flow_id, label, row_number() OVER (PARTITION BY label ORDER BY {HASH}, flow_id) AS rn,
    min(n_c) OVER () AS n_min
  FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n_c FROM canon) a) b WHERE rn <= n_min""")
def m4_undersample(spark, sf):
    return undersample(canonical_flows(spark, sf), "flow_id", 42).select("flow_id", "label")


_D2 = " + ".join(f"(a.{c}::DOUBLE - b.{c}::DOUBLE) * (a.{c}::DOUBLE - b.{c}::DOUBLE)" for c in FEATURE_NAMES)
NEAR_CTE = CANON_CTE + f""",
small AS (SELECT * FROM canon WHERE label = (SELECT label FROM canon GROUP BY label ORDER BY count(*) LIMIT 1)),
pairs AS (SELECT a.flow_id AS id, b.flow_id AS neighbour, {_D2} AS d FROM small a JOIN small b ON a.flow_id <> b.flow_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM pairs) x WHERE rank <= 5)"""


@register("m5_nearest_rows", NEAR_CTE + "\nSELECT id, rank, neighbour, round(sqrt(d), 4) AS distance FROM near")
def m5_nearest_rows(spark, sf):
    """The five nearest flows of each flow of the smaller class, exactly."""
    from netsieve.operators.neighbours import nearest_rows
    c = canonical_flows(spark, sf)
    small = c.groupBy("label").count().orderBy("count").limit(1).select("label")
    return nearest_rows(c.join(F.broadcast(small), "label", "left_semi"), "flow_id", FEATURE_NAMES).select("id", "rank", "neighbour", F.round(F.sqrt("d"), 4).alias("distance"))


@register("m5_smote", NEAR_CTE + f""",
size AS (SELECT count(*) FILTER (WHERE label = (SELECT any_value(label) FROM small)) AS n, count(*) FILTER (WHERE label <> (SELECT any_value(label) FROM small)) AS m FROM canon),
base AS (SELECT s.*, n, m, row_number() OVER (ORDER BY {HASH}, flow_id) AS rn FROM small s, size),
copies AS (SELECT b.*, unnest(range((m - n) // n + CASE WHEN rn <= (m - n) % n THEN 1 ELSE 0 END)) AS copy FROM base b),
keyed AS (SELECT c.*, ('0x' || substr(md5(concat(flow_id, '|', copy, '|42')), 1, 8))::BIGINT AS pick,
  ('0x' || substr(md5(concat(flow_id, '|', copy, '|42|u')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM copies c)
SELECT a.flow_id AS base, w.neighbour, a.copy, round(u, 9) AS u, {", ".join(f"round(a.{c}::DOUBLE + u * (b.{c}::DOUBLE - a.{c}::DOUBLE), 4) AS {c}" for c in FEATURE_NAMES)}
FROM keyed a JOIN near w ON w.id = a.flow_id AND w.rank = 1 + pick % 5 JOIN small b ON b.flow_id = w.neighbour""")
def m5_smote(spark, sf):
    """The synthetic flows that bring the smaller class to the size of the larger."""
    s = smote(canonical_flows(spark, sf), "flow_id").where("base is not null")
    return s.select("base", "neighbour", "copy", F.round("u", 9).alias("u"), *[F.round(c, 4).alias(c) for c in FEATURE_NAMES])


@register("m3_class_weights", CANON_CTE + """
SELECT label, count(*) AS n_c, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
FROM canon GROUP BY label""")
def m3_class_weights(spark, sf):
    return class_weights(canonical_flows(spark, sf))


_SCALER_FEATS = FEATURE_NAMES


@register("m1_fit_scaler", SPLIT_CTE + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std "
    f"FROM split WHERE split = 'train'" for c in _SCALER_FEATS))
def m1_fit_scaler(spark, sf):
    tr = split_canonical(spark, sf).filter(F.col("split") == "train")
    s = fit_scaler(tr)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mean__{c}").alias("mean"),
                                        F.col(f"std__{c}").alias("std")) for c in _SCALER_FEATS]))
    return s.select(rows.alias("r")).select("r.feature", F.round("r.mean", 6).alias("mean"),
                                            F.round("r.std", 6).alias("std"))


PRED_SQL = "(packet_count_per_second > 10000 OR byte_count_per_second > 50000000)"


def predicted(spark, sf):
    c = canonical_flows(spark, sf)
    return c.withColumn("prediction", ((F.col("packet_count_per_second") > 10000) |
                                       (F.col("byte_count_per_second") > 50_000_000)).cast("int"))


@register("a16_binary_metrics", CANON_CTE + f""",
p AS (SELECT label, cast({PRED_SQL} AS int) AS prediction FROM canon),
c AS (SELECT sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END)::BIGINT AS fn FROM p)
SELECT tp, fp, tn, fn, CASE WHEN tp + fp + tn + fn <> 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN (CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END) + (CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END) <> 0
       THEN 2 * (CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END) * (CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END)
            / ((CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END) + (CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END))
       ELSE 0.0 END AS f1
FROM c""")
def a16_binary_metrics(spark, sf):
    return binary_metrics(predicted(spark, sf))


@register("a17_classification_report", CANON_CTE + f""",
p AS (SELECT label AS y, cast({PRED_SQL} AS int) AS p FROM canon),
cls AS (SELECT y AS c FROM p UNION SELECT p FROM p),
per AS (SELECT cast(c AS varchar) AS class,
  CASE WHEN sum(CASE WHEN p = c THEN 1 ELSE 0 END) <> 0 THEN sum(CASE WHEN p = c AND y = c THEN 1 ELSE 0 END) / sum(CASE WHEN p = c THEN 1 ELSE 0 END) ELSE 0.0 END AS precision,
  CASE WHEN sum(CASE WHEN y = c THEN 1 ELSE 0 END) <> 0 THEN sum(CASE WHEN p = c AND y = c THEN 1 ELSE 0 END) / sum(CASE WHEN y = c THEN 1 ELSE 0 END) ELSE 0.0 END AS recall,
  sum(CASE WHEN y = c THEN 1 ELSE 0 END)::BIGINT AS support
  FROM cls, p GROUP BY c),
per2 AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM per2
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM per2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
  round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM per2""")
def a17_classification_report(spark, sf):
    r = classification_report(predicted(spark, sf))
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("m13_roc_points", CANON_CTE + """,
s AS (SELECT packet_count_per_second AS score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
        sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM canon GROUP BY 1),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM s)
SELECT 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT score, CASE WHEN N <> 0 THEN sum(neg) OVER w / N ELSE 0.0 END,
  CASE WHEN P <> 0 THEN sum(pos) OVER w / P ELSE 0.0 END
FROM s, t WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def m13_roc_points(spark, sf):
    c = canonical_flows(spark, sf).withColumn("score", F.col("packet_count_per_second"))
    return roc_points(c)


@register("m14_auc", CANON_CTE + """,
s AS (SELECT packet_count_per_second AS score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::BIGINT AS pos,
        sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)::BIGINT AS neg FROM canon GROUP BY 1),
r AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM s)
SELECT CASE WHEN sum(pos) * sum(neg) <> 0
            THEN cast(sum(pos * (2 * (neg_le - neg) + neg)) AS double) / (2.0 * sum(pos) * sum(neg)) ELSE 0.0 END AS auc,
  sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM r""")
def m14_auc(spark, sf):
    c = canonical_flows(spark, sf).withColumn("score", F.col("packet_count_per_second"))
    return auc(c)


KS_FEATS = FEATURE_NAMES


def _ks_sql() -> str:
    longs = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, cast({c} AS double) AS v, side FROM sides" for c in KS_FEATS)
    series = " + ".join(f"{'' if k % 2 else '-'}exp(-2.0 * {k * k} * lam * lam)" for k in range(1, 101))
    return CANON_CTE + f""",
sides AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY cast(flow_id AS bigint)) <= floor(count(*) OVER () * 0.7)
  THEN 1 ELSE 2 END AS side FROM canon),
l AS ({longs}),
c AS (SELECT feature, v, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS c1, sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS c2
      FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY feature, v),
r AS (SELECT feature, sum(c1) OVER w AS r1, sum(c2) OVER w AS r2, sum(c1) OVER (PARTITION BY feature) AS n1,
        sum(c2) OVER (PARTITION BY feature) AS n2 FROM c
      WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT feature, max(abs(r1 / n1 - r2 / n2)) AS statistic, any_value(n1) AS n1, any_value(n2) AS n2
      FROM r GROUP BY feature),
q AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)) * statistic AS lam FROM d),
p AS (SELECT *, CASE WHEN lam = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * ({series}))) END AS p_value FROM q)
SELECT feature, round(statistic, 12) AS statistic, round(p_value, 9) AS p_value, p_value < 0.05 AS drifted,
  cast(n1 AS bigint) AS n_train, cast(n2 AS bigint) AS n_serve FROM p"""


@register("m18_ks_drift", _ks_sql())
def m18_ks_drift(spark, sf):
    c = canonical_flows(spark, sf).withColumn("__o", F.col("flow_id").cast("bigint"))
    s = temporal_split(c, ["__o"], 0.70)
    tr = s.filter(F.col("split") == "train").select(*KS_FEATS)
    te = s.filter(F.col("split") == "test").select(*KS_FEATS)
    k = ks_drift(tr, te, KS_FEATS)
    return k.select("feature", F.round("statistic", 12).alias("statistic"), F.round("p_value", 9).alias("p_value"),
                    "drifted", "n_train", "n_serve")


@register("m22_baselines", SPLIT_CTE + f""",
tr AS (SELECT * FROM split WHERE split = 'train'), te AS (SELECT * FROM split WHERE split = 'test'),
maj AS (SELECT label AS m FROM tr GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT 'majority' AS baseline, avg(CASE WHEN label = (SELECT m FROM maj) THEN 1.0 ELSE 0.0 END) AS accuracy FROM te
UNION ALL
SELECT 'pps_threshold', avg(CASE WHEN label = cast({PRED_SQL} AS int) THEN 1.0 ELSE 0.0 END) FROM te""")
def m22_baselines(spark, sf):
    """M22 (SQL part): majority-class and pps-threshold accuracy on the test
    split; the logistic baseline is in ``m22_logistic_baseline``."""
    s = split_canonical(spark, sf)
    tr, te = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    maj = (tr.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("n").desc(), F.col("label").asc()).limit(1).select(F.col("label").alias("m")))
    a = te.crossJoin(F.broadcast(maj)).agg(F.avg((F.col("label") == F.col("m")).cast("double")).alias("accuracy")) \
          .select(F.lit("majority").alias("baseline"), "accuracy")
    pred = ((F.col("packet_count_per_second") > 10000) | (F.col("byte_count_per_second") > 50_000_000)).cast("int")
    b = te.agg(F.avg((F.col("label") == pred).cast("double")).alias("accuracy")) \
          .select(F.lit("pps_threshold").alias("baseline"), "accuracy")
    return a.unionByName(b)


@register("s13_write_results", __import__("netsieve.plans.catalog", fromlist=["x"]).ORACLES["a16_binary_metrics"])
def s13_write_results(spark, sf):
    """The metric table written with the result sink and read back."""
    from netsieve.plans.q_logs import _scratch
    from netsieve.sources.datasets import write_results
    path = _scratch(spark, "results")
    write_results(binary_metrics(predicted(spark, sf)), path, fmt="parquet")
    return spark.read.parquet(path)


@register("s15_verify_files")
def s15_verify_files(spark, sf):
    """Manifest of the derived raw dataset folder against an expected
    list in which one hash is wrong and one file is missing."""
    from netsieve.plans.q_adapters import cic2017_dir
    from netsieve.sources.datasets import verify_files
    path = cic2017_dir(spark, sf)
    seen = verify_files(spark, path, spark.createDataFrame([], "name STRING, sha256 STRING"))
    first = seen.agg(F.min("name").alias("n"))
    expected = (seen.crossJoin(first)
                .select("name", F.when(F.col("name") == F.col("n"), F.lit("0" * 64)).otherwise(F.col("sha256"))
                        .alias("sha256"))
                .unionByName(spark.createDataFrame([("UNSW-NB15_missing.csv", "f" * 64)], "name STRING, sha256 STRING")))
    return verify_files(spark, path, expected).select("name", "size", "status")


@register("s15_manifest_summary")
def s15_manifest_summary(spark, sf):
    """S15 totals: files, total size, missing files, overall ok."""
    from netsieve.sources.datasets import manifest_summary
    return manifest_summary(s15_verify_files(spark, sf))
