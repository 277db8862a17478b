"""Model registry: parts on demand, commits, fingerprints; certificates that a constant model fails."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from pitchside.operators import models as ML
from pitchside.operators.model_registry import ModelRegistry, class_weight, fingerprint

TREES = dict(num_trees=4, folds=3)
COLUMNS = "match_id long, h_roll_scored double, h_roll_conceded double, target_over25 int, target_btts int, target_home_win int, " \
          "target_draw int, target_away_win int"


def training(spark, n=240, seed=3):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        x, z = rnd.random(), rnd.choice([None, rnd.random()])
        out = rnd.randrange(3)
        rows.append((i, x, z, int(x + 0.3 * rnd.random() > 0.6), int(rnd.random() > 0.5), int(out == 0), int(out == 1), int(out == 2)))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    return ModelRegistry(training(spark), str(tmp_path_factory.mktemp("models")), **TREES)


def parts(reg):
    out = {}
    for market in ML.MARKETS:
        for part in reg.files.names(f"{reg.path}/{market}"):
            out[f"{market}/{part}"] = [n for n in reg.files.names(f"{reg.path}/{market}/{part}") if n.endswith(".done")]
    return out


def test_parts_are_made_on_demand_and_once(spark, registry, monkeypatch):
    oof = registry.out_of_fold("over25")
    assert sorted(r.match_id for r in oof.collect()) == list(range(240))
    assert set(parts(registry)) == {"over25/frame", "over25/fold-0", "over25/fold-1", "over25/fold-2"}
    acc = ML.cv_accuracy(oof, "over25", "label").agg(F.avg("accuracy")).first()[0]
    assert acc > 0.8
    assert registry.model("over25").importances(spark, registry.features).count() == 2
    assert "over25/full" in parts(registry) and "btts/full" not in parts(registry)
    # a registry opened on the same rows in another order finds all parts and fits nothing
    again = ModelRegistry(training(spark).orderBy(F.desc("match_id")), os.path.dirname(registry.path), **TREES)
    assert again.path == registry.path
    monkeypatch.setattr(ModelRegistry, "_fit", lambda *a: pytest.fail("fitted again"))
    assert again.out_of_fold("over25").count() == 240 and again.model("over25") is not None


def test_training_rows_and_recipe_name_the_folder(spark, registry):
    root = os.path.dirname(registry.path)
    assert ModelRegistry(training(spark, 239), root, **TREES).path != registry.path
    assert ModelRegistry(training(spark), root, num_trees=5, folds=3).path != registry.path
    rows = training(spark, 20)
    assert fingerprint(rows, {}) == fingerprint(rows.repartition(5), {}) != fingerprint(rows.union(rows.limit(1)), {})


def test_a_crash_leaves_no_part_and_two_writers_agree(registry, monkeypatch):
    with pytest.raises(ZeroDivisionError):
        registry._part("extra", lambda folder: (os.makedirs(folder), 1 / 0))
    assert registry._committed("extra") is None

    def slow_writer(folder):
        os.makedirs(folder)
        registry._part("extra", lambda other: os.makedirs(other))       # another writer commits first

    found = registry._part("extra", slow_writer)
    assert found == registry._committed("extra") == registry._part("extra", lambda f: pytest.fail("made again"))
    assert len([n for n in registry.files.names(f"{registry.path}/extra") if n.endswith(".done")]) == 2


def test_too_few_rows_train_nothing(spark, tmp_path):
    reg = ModelRegistry(training(spark, 49), str(tmp_path), **TREES)
    assert reg.summary().collect() == [] and reg.model("over25") is None and reg.models() == {} and parts(reg) == {}
    assert ML.train_markets(training(spark, 10), str(tmp_path), 4, 3).collect() == []


def test_logistic_gradient_vanishes_at_the_fit_only(spark, registry):
    for market in ("over25", "outcome"):
        rows = registry.frame(market)
        counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        rows = rows.withColumn("w", class_weight(counts, "label"))
        table = registry.coefficients(market)

        def steepest(t):
            return max(abs(r.gradient) for r in ML.logit_gradient(rows, t, ML.logit_reg(240)).collect())

        assert steepest(table) < 1e-6
        assert steepest(table.withColumn("coefficient", F.lit(0.0))) > 1e-3
        assert steepest(table.withColumn("coefficient", F.col("coefficient") * 1.01)) > 1e-5
        # the votes of the saved coefficients are those of the model
        got = registry.model(market).transform(rows, keep_votes=True)
        votes = ML.logit_votes(ML.logit_scores(table))
        assert got.select(F.max(F.abs(F.get("lr_votes", 1) - votes[1]))).first()[0] < 1e-9


def test_gradient_against_plain_numbers(spark):
    rows = [(0.0, 1.0, 0.5), (1.0, 2.0, 1.5), (1.0, 4.0, 2.0)]
    table = [(0, "x", 2.0, 1.5, 0.7), (0, None, None, None, -0.2)]
    df = spark.createDataFrame(rows, "label double, x double, w double")
    got = {r.feature: r.gradient for r in ML.logit_gradient(
        df, spark.createDataFrame(table, "class int, feature string, mean double, std double, coefficient double"), 0.1).collect()}
    g = b = 0.0
    for y, x, w in rows:
        s = (x - 2.0) / 1.5
        r = w * (1 / (1 + math.exp(-(0.7 * s - 0.2))) - y)
        g, b = g + r * s, b + r
    assert abs(got["x"] - (g / 4.0 + 0.07)) < 1e-12 and abs(got[None] - b / 4.0) < 1e-12


def test_forest_audit_and_importances(spark, registry):
    nodes = ML.node_table(spark, f"{registry.folder('over25')}/forest").cache()
    ranges = ML.column_ranges(registry.matrix(), registry.features)

    def checks(table, **how):
        return [r.asDict() for r in ML.audit_forest(table, ranges, **how).collect()]

    good = checks(nodes)
    assert len(good) == 4 and all(all(v for k, v in r.items() if k != "tree") for r in good)
    model = {r.feature: r.importance for r in registry.model("over25").importances(spark, registry.features).collect()}
    again = {r.feature: r.importance for r in ML.forest_importances(nodes, registry.features).collect()}
    assert all(abs(model[f] - again[f]) < 1e-9 for f in model)
    # a constant model has trees without splits; changed tables fail where they were changed
    constant = nodes.where("id = 0").withColumns({"left": F.lit(-1), "right": F.lit(-1)})
    assert not any(r["is_split"] or r["adds_up"] or r["gains_hold"] for r in checks(constant))
    root = (F.col("tree") == 1) & (F.col("id") == 0)
    for column, value, failed in (("gain", F.col("gain") * 1.01, "gains_hold"), ("rows", F.col("rows") + 1, "adds_up"),
                                  ("threshold", F.lit(99.0), "inside")):
        bad = checks(nodes.withColumn(column, F.when(root, value).otherwise(F.col(column))))
        assert [r["tree"] for r in bad if not r[failed]] == [1], column
    assert any(not r["shallow"] for r in checks(nodes, max_depth=1)) and any(not r["leaves_hold"] for r in checks(nodes, min_leaf=10_000))
