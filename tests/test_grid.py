"""The run grid and the comparison cover every dataset."""
from pyspark.sql import functions as F

from netsieve.operators.ml import train_forest
from netsieve.plans import q_models
from tests.conftest import SF_CHECK, SF_SMALL

DATASETS = ("cic-ids2017", "cic-ddos2019", "unsw-nb15", "synthetic")


def test_grid_has_every_dataset(spark, monkeypatch):
    """One run is done with a small forest, the others fail and are reported."""
    def fit(c, balance, split, order):
        if (balance, split) != ("undersample", "temporal") or asked[-1] != "synthetic":
            raise ValueError(f"no run for {asked[-1]}")
        return real(c, balance, split, order)

    def dataset(spark, sf, name):
        asked.append(name)
        return table(spark, sf, name) if name == "synthetic" else None

    asked, real, table = [], q_models._fit_run, q_models._dataset
    monkeypatch.setattr(q_models, "_fit_run", fit)
    monkeypatch.setattr(q_models, "_dataset", dataset)
    monkeypatch.setattr(q_models, "forest_for", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(q_models, "train_forest", lambda tr, weight_col=None: train_forest(tr, weight_col=weight_col, num_trees=2, max_depth=3))
    rows = q_models.m17_run_grid(spark, SF_SMALL).collect()
    assert {(r["dataset"], r["split"], r["balance"]) for r in rows} == {
        (d, s, b) for d in DATASETS for s in ("stratified", "temporal") for b in ("none", "class_weight", "undersample")}
    done = [r for r in rows if r["status"] == "ok"]
    assert len(rows) == 24 and [(r["dataset"], r["split"], r["balance"]) for r in done] == [("synthetic", "temporal", "undersample")]
    assert done[0]["accuracy"] > 0.5 and all(r["error"] for r in rows if r["status"] == "failed")


def test_comparison_has_every_real_dataset(spark, monkeypatch):
    asked = []

    def matrix(datasets):
        asked.append(list(datasets))
        return spark.createDataFrame([(a, b) for a in datasets for b in datasets], "train STRING, test STRING")

    monkeypatch.setattr(q_models, "_datasets", lambda spark, sf: dict.fromkeys(DATASETS))
    monkeypatch.setattr(q_models, "transfer_matrix", matrix)
    monkeypatch.setattr(q_models, "_MAPPED_TABLES", {})
    assert q_models.m15_transfer_matrix(spark, SF_SMALL).count() == len(DATASETS) ** 2
    rows = q_models.m16_synthetic_vs_real(spark, SF_SMALL).collect()
    real = set(DATASETS) - {"synthetic"}
    assert len(rows) == 9 and {tuple(r) for r in rows} == {p for d in real for p in (("synthetic", d), (d, "synthetic"), (d, d))}
    assert len(asked) == 1  # the forests are trained once for both queries


def test_guarded_scores_of_the_model(spark, monkeypatch):
    """Closed breaker: the forest's probability; open: the thresholds' one; open just
    where the plain query has it."""
    monkeypatch.setattr(q_models, "train_forest", lambda tr, weight_col=None: train_forest(tr, weight_col=weight_col, num_trees=3, max_depth=4))
    monkeypatch.setattr(q_models, "_MODELS", {})
    from netsieve.plans.q_stateful import m12_score_guarded
    rows = q_models.m12_score_model(spark, SF_CHECK).collect()
    model = {str(r["flow_id"]): r["attack_prob"] for r in q_models.m9_score(spark, SF_CHECK).collect()}
    plain = {str(r["event_id"]): r["used_fallback"] for r in m12_score_guarded(spark, SF_CHECK).collect()}
    assert len(rows) == len(model) > 100
    opened = [r for r in rows if r["used_fallback"]]
    assert 0 < len(opened) < len(rows) and all(r["final_prob"] in (0.1, 0.5) for r in opened)
    assert all(r["final_prob"] == model[r["flow_id"]] for r in rows if not r["used_fallback"])
    assert all(plain[r["flow_id"]] == r["used_fallback"] for r in rows if r["flow_id"] in plain)


def test_folds_beside_each_other(spark, monkeypatch):
    monkeypatch.setattr(q_models, "train_forest", lambda tr, weight_col=None: train_forest(tr, weight_col=weight_col, num_trees=2, max_depth=3))
    r = q_models.m23_cross_validate(spark, SF_SMALL).first()
    assert r["folds"] == 5 and 0.5 < r["accuracy_mean"] <= 1.0 and r["accuracy_std"] < 0.2


def test_a_pair_of_the_matrix_is_scored_once(spark, monkeypatch, tmp_path):
    """Both kinds of figures of a pair come from one pass of the forest over its rows."""
    from pyspark.sql import functions as F

    from netsieve.operators.ml import score
    from netsieve.operators.synthetic import synthetic_flows
    seen = spark.sparkContext.accumulator(0)

    def counted(df, model):
        kept = score(df, model)
        mark = F.udf(lambda y: seen.add(1) or y, "double")
        return kept.withColumn("label", mark("label"))

    monkeypatch.setattr(q_models, "train_forest", lambda tr, weight_col=None: train_forest(tr, weight_col=weight_col, num_trees=2, max_depth=3))
    monkeypatch.setattr(q_models, "score", counted)
    data = {n: synthetic_flows(spark, 400, seed).drop("id", "subtype", "shuffle_key").checkpoint() for n, seed in (("a", 1), ("b", 2))}
    rows = q_models.transfer_matrix(data).collect()
    assert [(r["train"], r["test"]) for r in rows] == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
    assert seen.value == 4 * 100


def test_runs_beside_each_other_map_a_dataset_once(spark, monkeypatch):
    from netsieve.plans import q_adapters, q_logs
    real, written = q_logs._scratch, []

    def scratch(spark, name):
        written.append(name)
        return real(spark, name)

    monkeypatch.setattr(q_logs, "_scratch", scratch)
    monkeypatch.setattr(q_adapters, "_scratch", scratch)
    monkeypatch.setattr(q_models, "_MAPPED_TABLES", {})
    monkeypatch.setattr(q_adapters, "_CANONICAL_TABLES", {})
    for name in ("synthetic", "cic-ids2017"):
        sizes = q_models._at_once(spark, lambda _, name=name: q_models._dataset(spark, SF_SMALL, name).count(), [0, 1, 2, 3])
        assert len(set(sizes)) == 1 and sizes[0] > 0
    assert sorted(written) == ["canonical-table", "mapped-table"]


def test_forest_keeps_the_nodes_of_its_rows(spark):
    """The same trees as a forest that goes down from the root for every level."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from netsieve.operators.ml import FEATURE_NAMES
    from netsieve.operators.synthetic import synthetic_flows
    rows = synthetic_flows(spark, 2000, 7).withColumn("label", F.col("label").cast("double")).select(*FEATURE_NAMES, "label").checkpoint()
    model = train_forest(rows, num_trees=4, max_depth=12).stages[-1]
    assert model.getCacheNodeIds()
    plain = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=4, maxDepth=12, seed=42, maxBins=64).fit(VectorAssembler(inputCols=FEATURE_NAMES, outputCol="v").transform(rows))
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]
