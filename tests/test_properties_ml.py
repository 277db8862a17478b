"""SURVEY §5 properties: partition invariance, pruning equivalence, ML sanity checks."""

import random
import tempfile

from pyspark.sql import functions as F

from pitchside.operators import features as feat
from pitchside.operators import metrics as MT
from pitchside.operators import models as ML
from pitchside.plans import views as V
from pitchside.plans.oracle import W09_COLS

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_form_invariant_under_repartitioning(spark):
    m = V.training_frame(V.match_view(spark, SF))
    a = feat.team_form_features(m).select(*W09_COLS)
    b = feat.team_form_features(m.repartition(7, "away_team").sortWithinPartitions(F.rand(1))).select(*W09_COLS)
    assert _rows(a, W09_COLS) == _rows(b, W09_COLS)


def test_pruned_live_rows_equal_unpruned(spark):
    m = V.training_frame(V.match_view(spark, SF))
    day = m.groupBy("match_date").count().orderBy(F.desc("count"), "match_date").first().match_date
    a = feat.live_feature_rows(m, str(day), prune=True)
    b = feat.live_feature_rows(m, str(day), prune=False)
    assert a.count() > 0 and _rows(a, a.columns) == _rows(b, b.columns)


def _separable(spark, n=400):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        x = rnd.random()
        y = 1 if x > 0.5 else 0
        rows.append((i, x, rnd.random(), y, y, 1 - y, 0, 0))
    return spark.createDataFrame(rows, "match_id long, f1 double, f2 double, target_over25 int, target_btts int, "
                                       "target_home_win int, target_draw int, target_away_win int")


def test_soft_vote_probabilities_and_accuracy(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    df = ML.outcome_label(_separable(spark))
    model = ML.fit_market(df, ["f1", "f2"], "over25", num_trees=10)
    scored = model.transform(df)
    r = scored.agg(F.min("p1").alias("lo"), F.max("p1").alias("hi"),
                   F.max(F.abs(F.col("p0") + F.col("p1") - 1)).alias("gap"),
                   F.avg(F.when((F.col("p1") >= 0.5).cast("int") == F.col("target_over25"), 1)
                         .otherwise(0)).alias("acc")).first()
    assert 0 <= r.lo <= r.hi <= 1 and r.gap < 1e-9 and r.acc > 0.9
    three = ML.fit_market(df, ["f1", "f2"], "outcome", num_trees=5).transform(df)
    gap = three.agg(F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1)).alias("g")).first().g
    assert gap < 1e-9


def test_out_of_fold_scores_each_row_once(spark):
    df = ML.outcome_label(_separable(spark, 300))
    folds = MT.stratified_folds(df.select("match_id", "target_over25"), "match_id", "target_over25")
    oof = ML.out_of_fold(df, ["f1", "f2"], "over25", folds.select("match_id", "fold"), num_trees=5)
    ids = [r.match_id for r in oof.select("match_id").collect()]
    assert sorted(ids) == list(range(300))
    acc = ML.cv_accuracy(oof, "over25").agg(F.avg("accuracy")).first()[0]
    assert acc > 0.85


def test_model_store_roundtrip_gives_equal_scores(spark):
    df = ML.outcome_label(_separable(spark, 200))
    cols = ["f1", "f2"]
    models = {mk: ML.fit_market(df, cols, mk, num_trees=5) for mk in ML.MARKETS}
    med = ML.medians_row(df, cols)
    path = tempfile.mkdtemp(prefix="pitchside-models-")
    ML.save_model_store(spark, path, models, cols, med)
    loaded, table = ML.load_model_store(spark, path)
    a = ML.score_matches(df.withColumn("match_date", F.current_date()).withColumn("home_team", F.lit("A"))
                         .withColumn("away_team", F.lit("B")), models, cols, med)
    b = ML.score_matches(df.withColumn("match_date", F.current_date()).withColumn("home_team", F.lit("A"))
                         .withColumn("away_team", F.lit("B")), loaded, cols, med)
    assert sorted(map(tuple, a.drop("match_date").collect())) == sorted(map(tuple, b.drop("match_date").collect()))
    assert table.count() == 3 * len(cols)
