"""Forests on matrices of several blocks; the logistic regression alone; parsing each payload once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchside.operators import forest as FO
from pitchside.operators import model_registry as MR
from pitchside.operators import models as ML
from pitchside.sources import payloads as P

from test_registry import training


def test_best_splits_against_brute_force():
    rnd = np.random.default_rng(1)
    counts, w, least = rnd.integers(0, 4, (7, 3, FO.BINS, 3)), np.array([0.5, 1.0, 2.0]), 5
    counts[:, 1:] = counts[:, :1]                              # every candidate sees the same rows
    for j in (1, 2):
        counts[:, j] = counts[:, j][:, rnd.permutation(FO.BINS)]
    counts[0], counts[1, :, 1:] = 0, 0                         # a node without rows, one without a second value
    gain, j, cut, total, left = FO.best_splits(counts, w, least)

    def impurity(c):
        return 1 - ((c * w) ** 2).sum() / (c * w).sum() ** 2

    assert list(gain[:2]) == [-1, -1]
    for node in range(2, 7):
        best = -1
        for k in range(3):
            for b in range(FO.BINS):
                l, r = counts[node, k, :b + 1].sum(0), counts[node, k, b + 1:].sum(0)
                if min(l.sum(), r.sum()) >= least:
                    whole = ((l + r) * w).sum()
                    best = max(best, impurity(l + r) - (l * w).sum() / whole * impurity(l) - (r * w).sum() / whole * impurity(r))
        assert abs(best - gain[node]) < 1e-12
        assert (left[node] == counts[node, j[node], :cut[node] + 1].sum(0)).all() and (total[node] == counts[node, 0].sum(0)).all()


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    """A registry whose matrix has three partitions: its forests are grown from blocks."""
    size, MR.PART_BYTES = MR.PART_BYTES, 100 * 8 * 5
    reg = MR.ModelRegistry(training(spark, 300), str(tmp_path_factory.mktemp("blocks")), num_trees=5, folds=3)
    assert reg.partitions() == 3
    yield reg
    MR.PART_BYTES = size


def test_logit_needs_no_forest(spark, blocks, monkeypatch):
    monkeypatch.setattr(MR, "fit_blocks", lambda *a: pytest.fail("fitted a forest"))
    assert blocks.coefficients("over25").count() == 3
    assert "full" not in blocks.files.names(f"{blocks.path}/over25")


def test_forest_of_blocks_is_a_whole_one(spark, blocks, monkeypatch):
    monkeypatch.setattr(ML.RandomForestClassifier, "fit", lambda *a: pytest.fail("fitted in one piece"))
    for market, classes in (("over25", 2), ("outcome", 3)):
        nodes = ML.node_table(spark, f"{blocks.folder(market)}/forest").cache()
        checks = [r.asDict() for r in ML.audit_forest(nodes, ML.column_ranges(blocks.matrix(), blocks.features)).collect()]
        assert len(checks) == 5 and all(all(v for k, v in r.items() if k != "tree") for r in checks)
        model = blocks.model(market)
        again = {r.feature: r.importance for r in ML.forest_importances(nodes, blocks.features).collect()}
        assert all(abs(r.importance - again[r.feature]) < 1e-9 for r in model.importances(spark, blocks.features).collect())
        # every row is in a tree as often as its blocks drew it: 300 rows, mean 1 a row
        roots = [r.rows for r in nodes.where("id = 0").collect()]
        assert len(set(roots)) > 1 and all(200 < n < 400 for n in roots)
        votes = model.transform(blocks.frame(market), keep_votes=True).select(F.size("rf_votes").alias("n"), "rf_votes").collect()
        assert len(votes) == 300 and all(r.n == classes and abs(sum(r.rf_votes) - 1) < 1e-9 for r in votes)
    oof = blocks.out_of_fold("over25")
    assert oof.count() == 300
    assert ML.cv_accuracy(oof, "over25", "label").agg(F.avg("accuracy")).first()[0] > 0.8


def test_each_payload_is_parsed_once(spark):
    docs = spark.createDataFrame([("2026-01-01", '{"errors":[],"response":[{"fixture":{"id":1}},{"fixture":{"id":2}}]}'),
                                  ("2026-01-02", '{"errors":{"a":"b"},"response":[{"fixture":{"id":3}}]}'),
                                  ("2026-01-03", '{"response":[{"fixture":{"id":4}}]}'), ("2026-01-04", "no json"), ("2026-01-05", None)],
                                 "request_date string, body string")
    rows = P.parse_fixtures(docs)
    assert sorted(r.match_id for r in rows.collect()) == [1, 2, 4]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
