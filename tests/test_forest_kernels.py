"""The compiled loops of the forest: class counts against plain loops, votes against Spark's, counts that do not grow with the blocks."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from pitchside.operators import forest as FO
from pitchside.operators import model_registry as MR
from pitchside.operators import models as ML

from test_registry import training

MASK = (1 << 64) - 1


def mix(z):
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & MASK
    return z ^ (z >> 31)


def bag(seed, tree, block, n):
    """How often each row of a block is drawn for a tree."""
    up_to = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(9)])
    state = mix((mix((mix((seed + 0x9E3779B97F4A7C15) & MASK) + tree) & MASK) + block) & MASK)
    draws = [(mix((state + (i // 4) * 0x9E3779B97F4A7C15) & MASK) >> 16 * (i % 4)) & 0xFFFF for i in range(n)]
    return [min(8, int(np.searchsorted(up_to, (u + 0.5) / (1 << 16)))) for u in draws]


def test_counts_against_plain_loops(spark):
    rnd = np.random.default_rng(5)
    n_trees, n_features, k, classes, groups, seed, level = 5, 7, 6, 3, 2, 42, 2
    sizes = {(3 << 32) + 1: 37, 8: 5001}                           # not a multiple of four; more than the rows taken at a time
    data = {b: (rnd.integers(0, FO.BINS, (n, n_features)), rnd.integers(0, classes, n)) for b, n in sizes.items()}
    rows = [(b, len(y), bytearray((x * classes + y[:, None]).astype(np.uint8).tobytes())) for b, (x, y) in data.items()]
    blocks = spark.createDataFrame(rows, "block long, rows int, codes binary")
    trees = FO.Trees(n_trees, 3, classes)
    trees.feature[:, :3], trees.cut[:, :3] = rnd.integers(0, n_features, (n_trees, 3)), rnd.integers(0, FO.BINS, (n_trees, 3))
    open_nodes = np.ones((n_trees, 4), bool)
    trees.feature[1, 2], open_nodes[1, 2:] = -1, False             # a leaf above the level
    open_nodes[2, 1], open_nodes[3] = False, False                 # a node that is not split, a tree that is done
    chosen = FO.candidates(seed, n_trees, level, n_features, k)
    found = {}
    for r in FO.level_counts(FO.deal(blocks, groups, 1), trees, open_nodes, chosen[open_nodes], level, groups, n_features, seed).collect():
        got = np.frombuffer(r.counts, np.int32).reshape(-1, k, FO.BINS, classes)
        found[r.tree] = found.get(r.tree, 0) + got
    assert sorted(found) == [0, 1, 2, 4]
    for t in found:
        slots = {p: i for i, p in enumerate(np.flatnonzero(open_nodes[t]))}
        want = np.zeros((len(slots), k, FO.BINS, classes), int)
        for b, (x, y) in data.items():
            for row, label, w in zip(x, y, bag(seed, t, b, len(y))):
                node = 0
                while node < 3 and trees.feature[t, node] >= 0:
                    node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.cut[t, node])
                if node - 3 in slots:
                    for j, f in enumerate(chosen[t, node - 3]):
                        want[slots[node - 3], j, row[f], label] += w
        assert (found[t] == want).all()


def test_candidates_are_distinct_features_in_every_node():
    for k in (3, 7):
        got = FO.candidates(1, 4, 3, 7, k)
        assert got.shape == (4, 8, k) and all(len(set(c)) == k and max(c) < 7 for c in got.reshape(-1, k).tolist())
        assert (got == FO.candidates(1, 4, 3, 7, k)).all() and len({tuple(c) for c in got.reshape(-1, k).tolist()}) > 1


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    size, MR.PART_BYTES = MR.PART_BYTES, 100 * 8 * 5
    reg = MR.ModelRegistry(training(spark, 600), str(tmp_path_factory.mktemp("kernels")), num_trees=6, folds=3)
    assert reg.partitions() == 6
    yield reg
    MR.PART_BYTES = size


def test_votes_are_those_of_spark(spark, blocks, monkeypatch):
    model = blocks.model("outcome")
    x = blocks.frame("outcome")
    odd = x.limit(3).withColumn("h_roll_scored", F.lit(float("nan"))).unionByName(x.limit(2).withColumn("h_roll_conceded", F.lit(None).cast("double")))
    rows = x.unionByName(odd).withColumn("row", F.monotonically_increasing_id()).persist()
    want = {r.row: r.p for r in model.forest.transform(rows).select("row", ML.vector_to_array("rf_prob").alias("p")).collect()}
    assert len(want) == 605 and len({tuple(p) for p in want.values()}) > 10
    monkeypatch.setattr(RandomForestClassificationModel, "transform", lambda *a: pytest.fail("every row walks all trees"))
    got = ML.forest_votes(rows, model.forest, "p").collect()
    assert {r.row: r.p for r in got} == want                       # to the bit
    assert ML.forest_votes(rows.limit(0), model.forest, "p").count() == 0
    scored = model.transform(x, keep_votes=True)
    assert scored.columns == [*x.columns, "p0", "p1", "p2", "rf_votes", "lr_votes"] and scored.count() == 600
    trees = model.forest.stages[-1]
    assert ML.forest_size(spark, model.forest) == (6, trees.totalNumNodes, sum(t.depth > 0 for t in trees.trees))
    rows.unpersist()


def test_exchanged_counts_do_not_grow_with_the_blocks(spark, blocks, tmp_path):
    rows = blocks.frame("over25")
    cuts = FO.feature_cuts(rows, blocks.features)
    stored = FO.write_blocks(rows, blocks.features, cuts, 2, str(tmp_path))
    assert stored.count() >= 3 and stored.agg(F.sum("rows")).first()[0] == 600
    trees, root = FO.Trees(6, 2, 2), np.ones((6, 1), bool)
    chosen = FO.candidates(1, 6, 0, 2, 2)
    counted = FO.level_counts(FO.deal(stored, 3, 2), trees, root, chosen[root], 0, 3, 2, 1).collect()
    assert len(counted) == 6 * 2                                   # a row per tree and slice, not per tree and block
    assert FO.deal(stored, 3, 2).rdd.getNumPartitions() == 3 * 2
