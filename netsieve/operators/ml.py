"""Learning operators on DataFrames.

Splits and samples are driven by keyed hashes (never ``rand()``), so a
re-executed task after an executor loss reproduces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsieve.functions.network import md5_bucket
from netsieve.operators._prefix import _materialise, _released, global_rank, partition_of
from netsieve.schema import FEATURE_NAMES, LABEL


def seeded_hash(id_col: str, seed: int) -> Column:
    """Uniform 32-bit hash of (id, seed) — the same in Spark and the SQL oracle."""
    return md5_bucket(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def seeded_uniform(id_col: str, seed: int, salt: str = "") -> Column:
    """Uniform [0, 1) from the keyed hash."""
    return md5_bucket(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}|{salt}"))) / 4294967296.0


# --- M1 scaling ----------------------------------------------------------------

def fit_scaler(train: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """M1: one row of mean and population std per feature, fitted on the
    training rows only; a zero std becomes 1. The row is worked out once: every
    pass of a fit over the scaled rows would read all of them for it again."""
    cols = cols or FEATURE_NAMES
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"mean__{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"std__{c}")]
    s = train.agg(*aggs)
    return _materialise(s.select(*[F.col(f"mean__{c}") for c in cols],
                                 *[F.when(F.col(f"std__{c}") == 0, F.lit(1.0)).otherwise(F.col(f"std__{c}")).alias(f"std__{c}")
                                   for c in cols]))


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Scale with fitted stats (a one-row table, broadcast by construction)."""
    cols = cols or FEATURE_NAMES
    j = df.crossJoin(F.broadcast(stats))
    j = j.withColumns({c: (F.col(c).cast("double") - F.col(f"mean__{c}")) / F.col(f"std__{c}") for c in cols})
    return j.drop(*stats.columns)


# --- M3, M4 balancing ------------------------------------------------------------

def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """M3: balanced weights n / (k * n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    t = c.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(t)).select(label, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = LABEL, weight_col: str = "weight") -> DataFrame:
    w = _materialise(class_weights(df, label).select(label, F.col("weight").alias(weight_col)))
    return df.join(F.broadcast(w), label)  # one row per class, counted once


def _rank_in_class(df: DataFrame, id_col: str, seed: int, label: str) -> DataFrame:
    """Rank of each row inside its class in keyed-hash order, plus the class
    size. One distributed sort over (label, hash, id); the input is evaluated
    once (the ranked relation is checkpointed), class sizes and offsets come
    from the ranked rows (one row per class, broadcast)."""
    x = df.withColumn("__h", seeded_hash(id_col, seed))
    r = global_rank(x, [F.col(label).asc(), F.col("__h").asc(), F.col(id_col).asc()], "__rank")
    cls = r.groupBy(label).agg((F.min("__rank") - 1).alias("__off"), F.count(F.lit(1)).alias("__n_c"))
    return (r.join(F.broadcast(cls), label)
             .withColumn("__crank", F.col("__rank") - F.col("__off"))
             .drop("__h", "__rank", "__off"))


def _reached(counts: DataFrame, by: str) -> DataFrame:
    """The row of ``counts`` (``__l``, ``__left``, ``by``, ``__n``) in which the
    wanted count is reached, per class; ``__left`` is what it still has to give."""
    upto = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy("__l").orderBy(by)))
    return upto.where("__upto >= __left and __upto - __n < __left").withColumn("__left", F.expr("__left - (__upto - __n)")).drop("__upto")


def _hash_cuts(df: DataFrame, id_col: str, seed: int, label: str, wanted) -> DataFrame:
    """Per class the keyed hash and id (``__ch``, ``__cid``) of the last row when
    the rows with the smallest (hash, id) are taken, and how many (``__left``) of
    the ``__n`` rows with just that hash and id are. ``wanted`` gets (label,
    ``__n_c``) and adds ``__want``, how many. Classes of which none are wanted
    are left out.

    The cut is found by refining a histogram: counts per upper half of the hash,
    then per hash inside the half that holds the cut, then per id of that one
    hash. Only counts are shuffled; the table is neither sorted nor copied."""
    keyed = df.select(F.col(label).alias("__l"), seeded_hash(id_col, seed).alias("__h"), F.col(id_col).alias("__id"))
    upper = F.shiftright("__h", 16)

    first = keyed.groupBy("__l", upper.alias("__u")).agg(F.count(F.lit(1)).alias("__n"))  # at most 65536 rows a class
    sizes = first.groupBy("__l").agg(F.sum("__n").alias("__n_c"))
    want = wanted(sizes.withColumnRenamed("__l", label)).withColumnRenamed(label, "__l")
    # one row per class from here on is what is broadcast
    at = _reached(first.join(F.broadcast(want.select("__l", F.col("__want").cast("long").alias("__left"))), "__l"), "__u").drop("__n")
    inside = keyed.join(F.broadcast(at), "__l").where(upper == F.col("__u"))
    second = inside.groupBy("__l", "__h", "__left").agg(F.count(F.lit(1)).alias("__n"))
    at = _reached(second, "__h").withColumnRenamed("__h", "__ch").drop("__n")
    last = keyed.join(F.broadcast(at), "__l").where("__h = __ch")
    ids = last.groupBy("__l", "__ch", "__left", "__id").agg(F.count(F.lit(1)).alias("__n"))  # ids that share one 32-bit hash
    return _reached(ids, "__id").select(F.col("__l").alias(label), "__ch", F.col("__id").alias("__cid"), "__left", "__n")


def _copies_within(shared: DataFrame, columns: list[str], label: str, name: str) -> DataFrame:
    """Marks ``__left`` of each class's rows, which share hash and id: those with
    the smallest hash of all columns, found by refined counts as above, and of the
    rows alike in that too the first as they lie. The rows are checkpointed, so
    that a lost task cannot number them anew; no task sees more of them than one
    of their partitions."""
    rows = _materialise(shared.select(*columns, "__left", F.xxhash64(*columns).alias("__k"), F.monotonically_increasing_id().alias("__mid")))
    keyed = rows.select(F.col(label).alias("__l"), "__left", "__k")
    upper = F.shiftright("__k", 48)
    at = _reached(keyed.groupBy("__l", "__left", upper.alias("__u")).agg(F.count(F.lit(1)).alias("__n")), "__u").drop("__n")
    inside = keyed.drop("__left").join(F.broadcast(at), "__l").where(upper == F.col("__u"))
    at = _reached(inside.groupBy("__l", "__left", "__k").agg(F.count(F.lit(1)).alias("__n")), "__k")
    at = _materialise(at.select(F.col("__l").alias(label), F.col("__k").alias("__ck"), "__left"))  # one row per class
    x = rows.drop("__left").join(F.broadcast(at), label)
    alike = x.where("__k = __ck").withColumn("__pid", partition_of("__mid"))
    offs = alike.groupBy(label, "__pid").agg(F.count(F.lit(1)).alias("__n"))  # one row per class and partition
    before = Window.partitionBy(label).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = offs.select(label, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    place = F.row_number().over(Window.partitionBy(label, "__pid").orderBy("__mid"))
    alike = alike.withColumn("__loc", place).join(F.broadcast(offs), [label, "__pid"])
    return (x.where("__k != __ck").select(*columns, F.expr("__k < __ck").alias(name))
             .unionByName(alike.select(*columns, F.expr("__off + __loc <= __left").alias(name))))


def _mark_first(df: DataFrame, id_col: str, seed: int, label: str, wanted, name: str) -> DataFrame:
    """The rows with a label, and in ``name`` whether they are among the wanted
    number of their class with the smallest (hash, id). The number is exact also
    where rows share an id. The cuts, one row per class, are found at once."""
    known = df.where(F.col(label).isNotNull())
    cuts = _materialise(_hash_cuts(known, id_col, seed, label, wanted))
    h = F.col("__h")  # below the join it is worked out once for a row, however often it is compared
    inside = (h < F.col("__ch")) | ((h == F.col("__ch")) & (F.col(id_col) <= F.col("__cid")))
    x = known.withColumn("__h", seeded_hash(id_col, seed)).join(F.broadcast(cuts), label, "left")
    marked = F.coalesce(inside, F.lit(False)).alias(name)
    if cuts.where("__left < __n").isEmpty():
        return x.select(*df.columns, marked)
    shared = F.coalesce((h == F.col("__ch")) & (F.col(id_col) == F.col("__cid")) & F.expr("__left < __n"), F.lit(False))
    return x.where(~shared).select(*df.columns, marked).unionByName(_copies_within(x.where(shared), df.columns, label, name))


def undersample(df: DataFrame, id_col: str, seed: int = 42, label: str = LABEL) -> DataFrame:
    """M4: every class cut to the minority size: the rows of each class with
    the smallest keyed hashes (exact counts; ``sampleBy`` is not exact)."""
    def wanted(sizes):
        return sizes.crossJoin(F.broadcast(sizes.agg(F.min("__n_c").alias("__want"))))

    return _mark_first(df, id_col, seed, label, wanted, "__in").where("__in").drop("__in")


COPIES = 10_000  # synthetic rows of one row that are made in one task


def smote(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, label: str = LABEL, cols: list[str] | None = None) -> DataFrame:
    """M5: every class brought to the size of the largest by synthetic rows
    ``x + u * (neighbour - x)`` between a row and one of its ``k`` nearest rows of
    its class.

    Returns id, label, the features as doubles, ``base``, ``neighbour``, ``copy``
    and ``u`` (NULL for the rows of ``df``, which all stay). A class that lacks m
    rows takes ``m // n`` from each of its n rows and one more from those with the
    smallest keyed hashes; which neighbour and which u are keyed hashes too, so the
    counts are exact and a rerun gives the same rows. Rows with a feature that is
    NULL or not finite stay but are not built upon; a class of one row repeats it.
    Ids must be unique."""
    from netsieve.operators.neighbours import nearest_rows

    cols = cols or FEATURE_NAMES
    features = [F.col(c).cast("double").alias(c) for c in cols]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("base", "string"), ("neighbour", "string"), ("copy", "bigint"), ("u", "double"))]
    out = df.select(F.col(id_col).cast("string").alias(id_col), label, *features, *none)
    whole = F.col(id_col).isNotNull()
    for c in cols:
        whole = whole & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    known = df.where(F.col(label).isNotNull())
    sizes = {r[label]: (r["n"], r["whole"]) for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(whole, 1)).alias("whole")).collect()}  # a row per class
    most = max((n for n, _ in sizes.values()), default=0)
    for value, (n, usable) in sorted(sizes.items()):
        if n == most or not usable:
            continue
        each, rest = divmod(most - n, usable)
        rows = known.where((F.col(label) == F.lit(value)) & whole).select(F.col(id_col).alias("base"), label, F.array(*features).alias("v"))
        near = nearest_rows(known.where((F.col(label) == F.lit(value)) & whole), id_col, cols, k)
        near = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
        marked = _mark_first(rows, "base", seed, label, lambda s, w=rest: s.withColumn("__want", F.lit(w)), "__more") if rest else rows.withColumn("__more", F.lit(False))
        made = marked.withColumn("n", F.lit(each) + F.col("__more").cast("int")).where("n > 0").join(near, F.col("base") == F.col("id"), "left")
        # a row's copies are dealt out in heaps
        heaps = made.withColumn("heap", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
        heaps = heaps.repartition(F.xxhash64("base", "heap")) if each >= COPIES else heaps
        one = heaps.withColumn("copy", F.explode(F.sequence(F.col("heap"), F.least(F.col("heap") + COPIES, "n") - 1)))
        one = one.withColumn("key", F.concat_ws("|", F.col("base").cast("string"), F.col("copy").cast("string")))
        pick = F.when(F.size("near") > 0, F.col("near")[(seeded_hash("key", seed) % F.size("near")).cast("int")]["neighbour"])
        one = one.withColumns({"neighbour": pick, "u": seeded_uniform("key", seed, "u")})
        other = rows.select(F.col("base").alias("o_id"), F.col("v").alias("w"))
        one = one.join(other, F.col("neighbour") == F.col("o_id"), "left")
        value_of = lambda i: F.col("v")[i] + F.coalesce(F.col("u") * (F.col("w")[i] - F.col("v")[i]), F.lit(0.0))
        out = out.unionByName(one.select(F.concat(F.lit("synthetic|"), "key").alias(id_col), label, *[value_of(i).alias(c) for i, c in enumerate(cols)],
                                         F.col("base").cast("string").alias("base"), F.col("neighbour").cast("string").alias("neighbour"), "copy", "u"))
    return out


# --- M6, M7, M8 splits ----------------------------------------------------------

def stratified_split(df: DataFrame, id_col: str, train_frac: float = 0.75, seed: int = 42,
                     label: str = LABEL) -> DataFrame:
    """M6: per class, the ``round(train_frac * n_c)`` rows with the smallest
    keyed hash go to train (half-even rounding). Adds ``split``."""
    def wanted(sizes):
        return sizes.withColumn("__want", F.bround(F.col("__n_c") * train_frac, 0))

    return _mark_first(df, id_col, seed, label, wanted, "__in").withColumn("split", F.when(F.col("__in"), "train").otherwise("test")).drop("__in")


def temporal_split(df: DataFrame, order: list[str], train_frac: float = 0.70) -> DataFrame:
    """M7: the first ``floor(train_frac * n)`` rows in ``order`` (which must
    be total) are train. Only the order columns are ranked, to find the last
    train row; the table itself is filtered against that one row."""
    n = df.count()
    last = int(n * train_frac)
    cols = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    with _released():
        ranks = global_rank(df.select(*cols), [F.col(f"__o{i}").asc() for i in range(len(order))], "__rank")
        cut = ranks.where(F.col("__rank") == last).select(F.struct(*[f"__o{i}" for i in range(len(order))]).alias("__cut"))
        one = df.sparkSession.range(1).select(F.lit(0).alias("__one")).join(cut, F.lit(True), "left")  # one row, also without a train row
        one = _materialise(one, outlives=True)  # the ranks are not read again
    before = F.struct(*cols) <= F.col("__cut")
    x = df.crossJoin(F.broadcast(one))
    return x.withColumn("split", F.when(F.coalesce(before, F.lit(False)), "train").otherwise("test")).drop("__one", "__cut")


def predefined_split(df: DataFrame) -> DataFrame:
    """M8: the ``_split`` marks of the loaded files."""
    if "_split" not in df.columns:
        raise ValueError("the table has no column _split: its files do not come in parts")
    return df.withColumn("split", F.col("_split"))


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, label: str = LABEL) -> DataFrame:
    """M23 folds: per class, fold = (rank within class - 1) mod k over the
    keyed hash order: stratified, exact sizes."""
    r = _rank_in_class(df, id_col, seed, label)
    return r.withColumn("fold", F.pmod(F.col("__crank") - 1, F.lit(k)).cast("int")).drop("__crank", "__n_c")


# --- M2, M9, M19 models -------------------------------------------------------

FIT_ROWS = 250_000  # training rows of a partition, about
LARGE_ROWS = 500_000  # from so many training rows on a forest is grown by ``grow_forest``


def _fit_partitions(train: DataFrame, rows: int | None = None) -> DataFrame:
    """``train`` in partitions of about ``FIT_ROWS`` rows at most. A forest keeps its
    binned rows, each with a count for every tree, and reads them again for every
    level: a partition's size is what a task reads. Smaller ones stay as they are."""
    wanted = -(-(train.count() if rows is None else rows) // FIT_ROWS)
    return train.repartition(wanted) if wanted > train.rdd.getNumPartitions() else train


def train_forest(train: DataFrame, weight_col: str | None = None, num_trees: int = 100,
                 max_depth: int = 20, seed: int = 42, features: list[str] | None = None):
    """M2: random forest (100 trees, depth 20, seed 42) in a Spark ML pipeline:
    assemble -> forest. Returns the fitted ``PipelineModel``. Each row's node in each
    tree is kept between levels: going down from the root again for every level took
    half of a fit's time; the trees are the same.

    Counts and nodes of every row in every tree grow past disks on large tables: from
    ``LARGE_ROWS`` rows on ``grow_forest`` grows a forest of the same kind (same rules,
    other random draws) out of blocks of bins."""
    from netsieve.operators.forest import grow_forest, label_facts
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    feats = features or FEATURE_NAMES
    rf = RandomForestClassifier(featuresCol="features_vec", labelCol=LABEL, numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, maxBins=64, cacheNodeIds=True)
    if weight_col:
        rf = rf.setWeightCol(weight_col)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features_vec", handleInvalid="keep"), rf])
    rows = train.select(*feats, LABEL, *([weight_col] if weight_col else [])).withColumn(LABEL, F.col(LABEL).cast("double"))
    facts = label_facts(rows, LABEL, weight_col)
    size = sum(r["n"] for r in facts)
    if size >= LARGE_ROWS:
        return PipelineModel([pipe.getStages()[0], grow_forest(rows, feats, LABEL, weight_col, num_trees, max_depth, seed, 64, "features_vec", facts)])
    return pipe.fit(_fit_partitions(rows, size))


def train_logistic(train: DataFrame, features: list[str] | None = None):
    """M22 baseline: logistic regression pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    feats = features or FEATURE_NAMES
    lr = LogisticRegression(featuresCol="features_vec", labelCol=LABEL, maxIter=100)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features_vec", handleInvalid="keep"), lr])
    return pipe.fit(train.withColumn(LABEL, F.col(LABEL).cast("double")))


def score(df: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """M9: ``attack_prob`` = probability of class 1 (vectorised transform
    over partitions) and ``prediction`` at ``threshold``."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df.withColumn(LABEL, F.col(LABEL).cast("double")) if LABEL in df.columns else df)
    out = out.withColumn("attack_prob", vector_to_array("probability")[1])
    return (out.withColumn("prediction", (F.col("attack_prob") >= threshold).cast("int"))
               .drop("features_vec", "rawPrediction", "probability"))


def importances(model, features: list[str] | None = None) -> list[tuple[str, float]]:
    """Feature importances of the fitted forest (12 values), sorted
    descending (L4: a 12-row sort)."""
    feats = features or FEATURE_NAMES
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(zip(feats, map(float, imp)), key=lambda t: -t[1])


def importances_df(spark, model, features: list[str] | None = None) -> DataFrame:
    rows = [(i + 1, f, v) for i, (f, v) in enumerate(importances(model, features))]
    return spark.createDataFrame(rows, "rank INT, feature STRING, importance DOUBLE")


def score_guarded(df: DataFrame, states: DataFrame, model_key: str, ts: str = "ts") -> DataFrame:
    """Per row, the model probability unless the breaker for its model
    is open at that time (newest breaker state at or before the row, as-of),
    then the threshold verdict (M10) decides."""
    from netsieve.operators.joins import asof_lookup
    st = states.select(model_key, ts, F.col("state").alias("breaker_state"))
    j = asof_lookup(df, st, [model_key], ts, ["breaker_state"])
    use_fb = F.coalesce(F.col("breaker_state") == "open", F.lit(False))
    return (j.withColumn("used_fallback", use_fb)
             .withColumn("final_prob", F.when(use_fb, F.col("fallback_prob")).otherwise(F.col("model_prob")))
             .drop("fact_ts", "age_sec"))


# --- M20, M21 robustness ----------------------------------------------------------

def perturb(df: DataFrame, cols: list[str], eps: float, ranges: DataFrame, id_col: str,
            seed: int = 42, label: str = LABEL) -> DataFrame:
    """Attack rows get each of ``cols`` moved uniformly within
    +-eps * (feature range); normal rows unchanged. ``ranges`` is a one-row
    table of per-feature (max - min)."""
    j = df.crossJoin(F.broadcast(ranges))
    upd = {}
    for c in cols:
        u = seeded_uniform(id_col, seed, f"{c}|{eps}") * 2.0 - 1.0
        upd[c] = F.when(F.col(label) == 1, F.col(c) + u * eps * F.col(f"range__{c}")).otherwise(F.col(c))
    return j.withColumns(upd).drop(*ranges.columns)


def feature_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of (max - min) per feature, worked out once for all perturbations."""
    return _materialise(df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"range__{c}") for c in cols]))


def benign_stats(df: DataFrame, cols: list[str], label: str = LABEL) -> DataFrame:
    n = df.filter(F.col(label) == 0)
    return n.agg(*[F.avg(c).alias(f"mean__{c}") for c in cols], *[F.stddev_pop(c).alias(f"std__{c}") for c in cols])


def evasion(df: DataFrame, scenario: str, cols: list[str], stats: DataFrame, id_col: str,
            seed: int = 42, label: str = LABEL) -> DataFrame:
    """M21 scenarios on attack rows: ``low_and_slow`` (rate features -> benign
    mean), ``mimicry`` (all features ~ N(benign mean, std), floored at 0; the
    normal draw is Box-Muller on keyed-hash uniforms), ``masking`` (the given
    top features -> benign mean)."""
    j = df.crossJoin(F.broadcast(stats))
    att = F.col(label) == 1
    upd = {}
    for c in cols:
        if scenario in ("low_and_slow", "masking"):
            upd[c] = F.when(att, F.col(f"mean__{c}")).otherwise(F.col(c))
        elif scenario == "mimicry":
            u1 = F.greatest(seeded_uniform(id_col, seed, f"{c}|a"), F.lit(1e-12))
            u2 = seeded_uniform(id_col, seed, f"{c}|b")
            z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)
            upd[c] = F.when(att, F.greatest(F.lit(0.0), F.col(f"mean__{c}") + z * F.col(f"std__{c}"))) \
                      .otherwise(F.col(c))
        else:
            raise ValueError(f"unknown scenario {scenario}")
    return j.withColumns(upd).drop(*stats.columns)
