"""Spark ML jobs: labels, forest + scaled logistic soft vote, CV, scoring, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome_label(df: DataFrame) -> DataFrame:
    """P-05: home/draw/away → 1/2/3 (default 2) and the 0-based ``outcome_label`` for Spark ML."""
    outcome = (F.when(F.col("target_home_win") == 1, 1)
               .when(F.col("target_draw") == 1, 2)
               .when(F.col("target_away_win") == 1, 3)
               .otherwise(2))
    return df.withColumn("outcome", outcome).withColumn("outcome_label", F.col("outcome") - 1)


def medians_row(train: DataFrame, cols) -> DataFrame:
    """One row of training medians (A-05); NULL for a feature without values."""
    from .metrics import feature_medians

    found = feature_medians(train, cols)
    return found.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in cols])


def impute_features(df: DataFrame, cols, medians: DataFrame | None) -> DataFrame:
    """P-15: every model column present; NULL or missing → training median, else 0.0.

    ``medians`` is a one-row frame (a global aggregate), joined as a broadcast.
    """
    if medians is None:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double") if c in df.columns
                                             else F.lit(None).cast("double"), F.lit(0.0)) for c in cols})
    med_cols = set(medians.columns)
    m = medians.select(*[F.col(c).alias(f"__med_{c}") for c in cols if c in med_cols])
    joined = df.crossJoin(F.broadcast(m))
    out = {}
    for c in cols:
        val = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        med = F.col(f"__med_{c}") if c in med_cols else F.lit(None).cast("double")
        out[c] = F.coalesce(val, med, F.lit(0.0))
    return joined.withColumns(out).drop(*[f"__med_{c}" for c in cols if c in med_cols])


# --- markets: soft vote of a weighted forest and a standardised logistic regression --------

from pyspark.ml import Pipeline, PipelineModel  # noqa: E402
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier  # noqa: E402
from pyspark.ml.feature import StandardScaler, VectorAssembler  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType  # noqa: E402

from .. import constants as C  # noqa: E402
from .kernels import kernel, map_partitions  # noqa: E402

MARKETS = {"over25": "target_over25", "btts": "target_btts", "outcome": "outcome_label"}
N_CLASSES = {"over25": 2, "btts": 2, "outcome": 3}


def balanced_weights(df: DataFrame, label: str, weight: str = "w") -> DataFrame:
    """A-07 as a column: ``n / (k · n_class)`` (sklearn "balanced"); the class table has k rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    table = counts.crossJoin(tot).select(
        label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(weight))
    return df.join(F.broadcast(table), label)


FOREST_MEMORY_MB = 1024      # node statistics of one pass: a level of all trees goes in one
LOGIT_TOLERANCE = 1e-9       # of the loss: the fit ends where the gradient vanishes, not where it gets small


def logit_reg(n_rows: int, c: float = C.LOGIT_C) -> float:
    """sklearn's C·Σ w·loss + ½‖β‖² equals Spark's mean loss + λ/2‖β‖² with λ = 1/(C·Σw); balanced Σw = n."""
    return 1.0 / (c * max(n_rows, 1))


def market_pipelines(cols, label: str, n_rows: int, num_trees: int = C.FOREST_PARAMS["num_trees"],
                     seed: int = C.SEED, recipe: dict | None = None) -> tuple[Pipeline, Pipeline]:
    """L-01 / L-02: the two members of the soft vote as Spark ML pipelines."""
    r = {**C.FOREST_PARAMS, "logit_c": C.LOGIT_C, "logit_max_iter": C.LOGIT_MAX_ITER, **(recipe or {})}
    assemble = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="w", numTrees=num_trees,
        maxDepth=r["max_depth"], minInstancesPerNode=r["min_leaf"], maxMemoryInMB=FOREST_MEMORY_MB, cacheNodeIds=True,
        featureSubsetStrategy="sqrt", seed=seed, probabilityCol="rf_prob",
        rawPredictionCol="rf_raw", predictionCol="rf_pred")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    logit = LogisticRegression(
        labelCol=label, featuresCol="scaled", weightCol="w", regParam=logit_reg(n_rows, r["logit_c"]),
        elasticNetParam=0.0, standardization=False, maxIter=r["logit_max_iter"], tol=LOGIT_TOLERANCE,
        probabilityCol="lr_prob", rawPredictionCol="lr_raw", predictionCol="lr_pred")
    return Pipeline(stages=[assemble, forest]), Pipeline(stages=[assemble, scaler, logit])


def _walker(spark, forest: PipelineModel, columns: list[int]):
    return kernel(spark, "ForestVotes", forest.stages[-1]._java_obj, np.array(columns, "<i4").tobytes())


def forest_votes(df: DataFrame, forest: PipelineModel, name: str) -> DataFrame:
    """``df`` with the class probabilities of an assembled forest as an array: what its ``transform`` gives to the bit, but some
    hundred rows go through a tree at a time, as all trees together do not fit a processor's cache."""
    at = [df.columns.index(c) for c in forest.stages[0].getInputCols()]
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])
    return map_partitions(df, _walker(df.sparkSession, forest, at), schema)


def forest_size(spark, forest: PipelineModel) -> tuple[int, int, int]:
    """Trees, nodes, and trees that have a split."""
    trees = forest.stages[-1]
    return int(trees.getNumTrees), int(trees.totalNumNodes), int(_walker(spark, forest, []).splitTrees())


class SoftVote:
    """L-03: a fitted pair whose class probabilities are averaged (no Spark voter exists)."""

    def __init__(self, forest: PipelineModel, logit: PipelineModel, n_classes: int):
        self.forest, self.logit, self.n_classes = forest, logit, n_classes

    def transform(self, df: DataFrame, prefix: str = "p", keep_votes: bool = False) -> DataFrame:
        """Class probabilities ``<prefix>0..``; with ``keep_votes`` also both members' as arrays."""
        a = forest_votes(df, self.forest, "rf_prob")
        both = self.logit.transform(a).drop("features", "scaled", "lr_raw", "lr_pred")
        rf, lr = F.col("rf_prob"), vector_to_array("lr_prob")
        # a class absent from the training labels has no slot in the vectors: probability 0
        cls = lambda v, k: F.coalesce(F.get(v, k), F.lit(0.0))
        out = both.withColumns({f"{prefix}{k}": (cls(rf, k) + cls(lr, k)) / 2 for k in range(self.n_classes)})
        if keep_votes:
            out = out.withColumns({"rf_votes": rf, "lr_votes": lr})
        return out.drop("rf_prob", "lr_prob")

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(f"{path}/forest")
        self.logit.write().overwrite().save(f"{path}/logit")

    @classmethod
    def load(cls, path: str, n_classes: int) -> "SoftVote":
        return cls(PipelineModel.load(f"{path}/forest"), PipelineModel.load(f"{path}/logit"), n_classes)

    def importances(self, spark, cols) -> DataFrame:
        """L-10: forest importances with names (one value per feature: a model-sized table)."""
        imp = self.forest.stages[-1].featureImportances.toArray().tolist()
        return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature string, importance double")


def fit_market(train: DataFrame, cols, market: str, num_trees: int = C.FOREST_PARAMS["num_trees"],
               seed: int = C.SEED, n_rows: int | None = None) -> SoftVote:
    label = MARKETS[market]
    weighted = balanced_weights(train, label)
    n = n_rows if n_rows is not None else weighted.count()
    fp, lp = market_pipelines(cols, label, n, num_trees, seed)
    return SoftVote(fp.fit(weighted), lp.fit(weighted), N_CLASSES[market])


def prepare_training(train: DataFrame, cols, medians: DataFrame | None = None) -> DataFrame:
    """Training matrix: imputed features (deviation N10: Spark ML cannot take NULL) + labels,
    checkpointed to the shared folder — it feeds 3 markets × (5 folds + 1) fits."""
    m = medians if medians is not None else medians_row(train, cols)
    x = outcome_label(impute_features(train, cols, m))
    # persisted only while the reliable checkpoint is written (so the lineage is computed once)
    x.persist()
    ck = x.checkpoint()
    x.unpersist()
    return ck


def out_of_fold(x: DataFrame, cols, market: str, folds: DataFrame, k: int = C.CV_FOLDS,
                num_trees: int = C.FOREST_PARAMS["num_trees"], seed: int = C.SEED) -> DataFrame:
    """L-07: every row scored by the model fitted on the other folds (each row once)."""
    from concurrent.futures import ThreadPoolExecutor

    xf = x.join(folds, "match_id").checkpoint()      # read by every fit and every scoring
    sizes = {r.fold: r.n for r in xf.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}    # k rows
    total = sum(sizes.values())

    def one(f: int) -> DataFrame:
        model = fit_market(xf.filter(F.col("fold") != f), cols, market, num_trees, seed, n_rows=total - sizes.get(f, 0))
        return model.transform(xf.filter(F.col("fold") == f))

    # the k fits are independent Spark jobs: submit them concurrently (as CrossValidator's parallelism)
    with ThreadPoolExecutor(max_workers=k) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_accuracy(oof: DataFrame, market: str, label: str | None = None) -> DataFrame:
    """L-06: per-fold accuracy of the out-of-fold predictions (argmax class)."""
    label = label or MARKETS[market]
    n = N_CLASSES[market]
    probs = F.array(*[F.col(f"p{k}") for k in range(n)])
    pred = F.array_position(probs, F.array_max(probs)) - 1
    return oof.groupBy("fold").agg(F.avg(F.when(pred == F.col(label), 1).otherwise(0)).alias("accuracy"))


def score_matches(rows: DataFrame, models: dict[str, SoftVote], cols, medians: DataFrame | None) -> DataFrame:
    """L-08 core: impute → the three markets chained as projections (no joins) → prediction columns."""
    x = impute_features(rows, cols, medians)
    x = models["over25"].transform(x, "o_")
    x = models["btts"].transform(x, "b_")
    x = models["outcome"].transform(x, "r_")
    return x.select("match_id", "match_date", "home_team", "away_team",
                    F.col("o_1").alias("over_2_5_probability"), F.col("b_1").alias("btts_probability"),
                    F.col("r_0").alias("prob_home_win"), F.col("r_1").alias("prob_draw"),
                    F.col("r_2").alias("prob_away_win"))


def save_model_store(spark, path: str, models: dict[str, SoftVote], cols, medians: DataFrame) -> None:
    """K-04: three model pairs + feature lists + medians as one small parquet table."""
    for name, mdl in models.items():
        mdl.save(f"{path}/{name}")
    meds = medians.unpivot([], list(cols), "feature", "median")
    rows = [(mk, c, i) for mk in models for i, c in enumerate(cols)]
    lists = spark.createDataFrame(rows, "market string, feature string, ord int")
    lists.join(meds, "feature", "left").write.mode("overwrite").parquet(f"{path}/features")


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_model_store(spark, path: str):
    """K-04: the saved pairs by market (missing ones left out) and the feature table, None if absent."""
    models = {mk: SoftVote.load(f"{path}/{mk}", N_CLASSES[mk]) for mk in MARKETS
              if _exists(spark, f"{path}/{mk}/forest") and _exists(spark, f"{path}/{mk}/logit")}
    table = spark.read.parquet(f"{path}/features") if _exists(spark, f"{path}/features") else None
    return models, table


SUMMARY = "market string, n_rows long, n_features int, cv_mean double, cv_std double"


def train_markets(train: DataFrame, path: str, num_trees: int = C.FOREST_PARAMS["num_trees"], k: int = C.CV_FOLDS,
                  min_rows: int = C.MIN_TRAIN_ROWS) -> DataFrame:
    """L-04 / F-09: cross-validate and fit the three markets on a training set; the parts go to the registry ``path``.

    Returns one row per market; with fewer than ``min_rows`` rows nothing is trained and the result is empty.
    """
    from .model_registry import ModelRegistry

    return ModelRegistry(train, path, min_rows=min_rows, num_trees=num_trees, folds=k).summary()


def evaluate(preds: DataFrame) -> DataFrame:
    """L-09: ``preds`` (y, p) → base rate, metrics, AUC and tier accuracies as ``(metric, value)``."""
    from . import metrics as MT

    wide = (preds.agg(F.avg("y").alias("base_rate"))
            .crossJoin(MT.classification_metrics(preds).drop("n")).crossJoin(MT.auc_roc(preds).select("auc")))   # one row each
    names = wide.columns
    one = wide.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", "value")
    tiers = MT.confidence_tiers(preds, MT.tiers_frame(preds.sparkSession))
    return one.unionByName(tiers.select(
        F.concat(F.lit("tier_"), F.format_string("%.2f", "tier"), F.lit("_accuracy")).alias("metric"), F.col("accuracy").alias("value")))


def node_table(spark, forest_path: str) -> DataFrame:
    """The nodes of a saved forest: tree, id, left, right (-1 in leaves), feature, threshold, gain, impurity, prediction,
    class weights and rows."""
    stage = [r for r in sorted(_names(spark, f"{forest_path}/stages")) if "RandomForest" in r][0]
    n = F.col("nodeData")
    return spark.read.parquet(f"{forest_path}/stages/{stage}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
        n["gain"].alias("gain"), n["impurity"].alias("impurity"), n["prediction"].alias("prediction"),
        n["impurityStats"].alias("weights"), n["rawCount"].alias("rows"))


def _names(spark, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]


NEAR = 1e-9                  # agreement of recomputed shares, gains and votes


def _total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)


def _gini(weights: Column) -> Column:
    return 1 - F.aggregate(weights, F.lit(0.0), lambda a, x: a + x * x) / (_total(weights) * _total(weights))


def audit_forest(nodes: DataFrame, ranges: DataFrame, max_depth: int = C.FOREST_PARAMS["max_depth"],
                 min_leaf: int = C.FOREST_PARAMS["min_leaf"]) -> DataFrame:
    """L-01 check, recomputed from the node table: one row per tree.

    ``ranges`` has (feature, low, high) of the training columns by index.  ``is_split``: the tree has a split;
    ``adds_up``: class weights and rows of every split are the sums of its children's, every node but the root has one
    parent; ``gains_hold``: the impurity of every split is that of its class weights, its gain is positive and the difference it
    should be; ``shares_hold``: each prediction is a class of greatest weight; ``leaves_hold``: no node has fewer than
    ``min_leaf`` rows; ``inside``: each threshold lies inside the range of its feature; ``shallow``: no path is longer than
    ``max_depth``.
    """
    splits = nodes.where("left >= 0")
    child = nodes.select("tree", F.col("id").alias("child"), F.col("weights").alias("cw"), F.col("rows").alias("cr"))
    left = child.select("tree", F.col("child").alias("left"), F.col("cw").alias("lw"), F.col("cr").alias("lr"))
    right = child.select("tree", F.col("child").alias("right"), F.col("cw").alias("rw"), F.col("cr").alias("rr"))
    joined = splits.join(left, ["tree", "left"]).join(right, ["tree", "right"]).join(ranges, "feature", "left")
    total, lt, rt = _total(F.col("weights")), _total(F.col("lw")), _total(F.col("rw"))
    sums = F.forall(F.arrays_zip("weights", "lw", "rw"), lambda z: F.abs(z["weights"] - z["lw"] - z["rw"]) <= NEAR * (1 + z["weights"]))
    gain = _gini(F.col("weights")) - lt / total * _gini(F.col("lw")) - rt / total * _gini(F.col("rw"))
    per_split = joined.groupBy("tree").agg(
        F.count("*").alias("splits"),
        F.bool_and(sums & (F.col("rows") == F.col("lr") + F.col("rr"))).alias("sums"),
        F.bool_and((F.col("gain") > 0) & (F.abs(F.col("gain") - gain) <= NEAR)
                   & (F.abs(F.col("impurity") - _gini(F.col("weights"))) <= NEAR)).alias("gains"),
        F.bool_and(F.coalesce((F.col("threshold") >= F.col("low")) & (F.col("threshold") < F.col("high")), F.lit(False))).alias("inside"))
    best = F.array_position("weights", F.array_max("weights")) - 1
    tied = F.get("weights", F.col("prediction").cast("int")) == F.array_max("weights")
    per_tree = nodes.groupBy("tree").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("left") >= 0).alias("declared"),
        F.bool_and(tied).alias("shares"),
        F.min("rows").alias("least"))
    level, depths = nodes.where("id = 0").select("tree", "id", "left", "right"), None
    for depth in range(max_depth + 1):                          # the levels of all trees at once
        ended = level.groupBy("tree").agg(F.count("*").alias("n")).withColumn("depth", F.lit(depth))
        depths = ended if depths is None else depths.unionByName(ended)
        level = (level.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("id"))
                 .join(nodes.select("tree", "id", "left", "right"), ["tree", "id"]))
    reached = depths.groupBy("tree").agg(F.sum("n").alias("reached"))
    return per_tree.join(per_split, "tree", "left").join(reached, "tree", "left").select(
        "tree", F.coalesce(F.col("splits") > 0, F.lit(False)).alias("is_split"),
        F.coalesce(F.col("sums") & (F.col("splits") == F.col("declared")) & (F.col("nodes") == 2 * F.col("declared") + 1), F.lit(False)).alias("adds_up"),
        F.coalesce("gains", F.lit(False)).alias("gains_hold"),
        F.col("shares").alias("shares_hold"), (F.col("least") >= min_leaf).alias("leaves_hold"),
        F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce(F.col("reached") == F.col("nodes"), F.lit(False)).alias("shallow"))


def column_ranges(x: DataFrame, cols) -> DataFrame:
    """(feature index, low, high) of the training columns."""
    wide = x.agg(*[F.struct(F.lit(i).alias("feature"), F.min(c).alias("low"), F.max(c).alias("high")).alias(f"r{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[f"r{i}" for i in range(len(cols))])))


def forest_importances(nodes: DataFrame, cols) -> DataFrame:
    """L-10 recomputed from the node table: (feature, importance), the mean over trees of normalised gain x weight."""
    total = _total(F.col("weights"))
    per = nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * total).alias("g"))
    tree = per.groupBy("tree").agg(F.sum("g").alias("t"))
    share = per.join(tree, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("s"))
    whole = share.agg(F.sum("s").alias("all"))
    names = nodes.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "feature int, name string")
    return names.join(share, "feature", "left").crossJoin(whole).select(                                        # one row
        F.col("name").alias("feature"), F.coalesce(F.col("s") / F.col("all"), F.lit(0.0)).alias("importance"))


def logit_scores(coefficients: DataFrame) -> list:
    """Linear scores of the saved coefficients as expressions over the feature columns, one per class vector."""
    rows = coefficients.collect()                                                                               # model-sized
    out = []
    for k in sorted({r["class"] for r in rows}):
        z = F.lit(next(float(r.coefficient) for r in rows if r["class"] == k and r.feature is None))
        for r in rows:
            if r["class"] == k and r.feature is not None and r.std:
                z = z + F.lit(r.coefficient) * ((F.col(r.feature) - F.lit(r.mean)) / F.lit(r.std))
        out.append(z)
    return out


def logit_votes(z: list) -> list:
    """Class probabilities of linear scores: logistic for one, softmax for more."""
    if len(z) == 1:
        p = 1 / (1 + F.exp(-z[0]))
        return [1 - p, p]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


def logit_gradient(rows: DataFrame, coefficients: DataFrame, reg: float) -> DataFrame:
    """L-02 check: the gradient of the weighted penalised mean loss at the saved coefficients.

    ``rows`` has ``label``, ``w`` and the features.  One row per class vector and parameter: class, feature (null: intercept)
    and gradient, which is 0 at the optimum and nowhere else, as the loss is strictly convex.
    """
    table = coefficients.collect()                                                                              # model-sized
    z = logit_scores(coefficients)
    names = [f"__z{k}" for k in range(len(z))]
    scored = rows.select("*", *[e.alias(n) for e, n in zip(z, names)])
    votes = logit_votes([F.col(n) for n in names])
    first = 1 if len(z) == 1 else 0                              # a binary model has the vector of class 1 only
    residual = [F.col("w") * (votes[k + first] - (F.col("label") == k + first).cast("double")) for k in range(len(z))]
    known = scored.select("w", *dict.fromkeys(r.feature for r in table if r.feature),
                          *[e.alias(f"__r{k}") for k, e in enumerate(residual)])
    parts, keys = [], []
    for i, r in enumerate(table):
        x = F.lit(1.0) if r.feature is None else (F.col(r.feature) - F.lit(r.mean)) / F.lit(r.std) if r.std else F.lit(0.0)
        penalty = 0.0 if r.feature is None else reg * r.coefficient
        parts.append((F.sum(F.col(f"__r{r['class']}") * x) / F.sum("w") + F.lit(penalty)).alias(f"g{i}"))
        keys.append(F.struct(F.lit(r["class"]).alias("class"), F.lit(r.feature).cast("string").alias("feature"), F.col(f"g{i}").alias("gradient")))
    return known.agg(*parts).select(F.inline(F.array(*keys)))


def read_medians(spark, path: str) -> DataFrame:
    """The saved (feature, median) rows of a model store."""
    return spark.read.parquet(f"{path}/features").select("feature", "median").distinct()


def score_from_store(spark, path: str, rows: DataFrame) -> DataFrame:
    """L-08: score ``rows`` with a saved model store; an empty result when a market's model is missing, and
    without a feature table the features of ``rows`` with 0.0 for missing values."""
    return score_with(rows, *load_model_store(spark, path))


def score_with(rows: DataFrame, models: dict[str, SoftVote], table: DataFrame | None) -> DataFrame:
    """L-08 on loaded models and their feature table (see :func:`score_from_store`)."""
    lists = {mk: [] for mk in MARKETS}
    medians = None
    if table is not None:
        for r in table.orderBy("market", "ord").collect():        # markets x features
            lists[r.market].append(r.feature)
        medians = table.select("feature", "median").distinct().agg(*[
            F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in dict.fromkeys(sum(lists.values(), []))])
    from .features import feature_columns

    cols = list(dict.fromkeys(sum(lists.values(), []))) or feature_columns(rows)
    if set(models) != set(MARKETS):
        return rows.limit(0).select("match_id", "match_date", "home_team", "away_team", *[
            F.lit(None).cast("double").alias(c) for c in
            ("over_2_5_probability", "btts_probability", "prob_home_win", "prob_draw", "prob_away_win")])
    return score_matches(rows, models, cols, medians)
