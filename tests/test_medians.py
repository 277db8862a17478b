"""Exact order statistics by sketch brackets against sorting."""

import math
import random
import statistics

import pytest

from pitchside.operators import metrics as MT

SHAPES = {
    "many": lambda r: r.gauss(0, 1), "few": lambda r: float(r.randrange(3)), "atom": lambda r: 0.5 if r.random() < 0.6 else r.random(),
    "skew": lambda r: r.random() ** 9 * 1e6, "holes": lambda r: r.choice([None, math.nan, r.random()]), "none": lambda r: None,
    "ends": lambda r: r.choice([-1e300, 1e300, 0.0]), "one": lambda r: 4.25,
}


def rows(n, seed=1):
    rnd = random.Random(seed)
    return [tuple(f(rnd) for f in SHAPES.values()) for _ in range(n)]


def want(data):
    out = {}
    for k, name in enumerate(SHAPES):
        v = [r[k] for r in data if r[k] is not None and not math.isnan(r[k])]
        if v:
            out[name] = statistics.median(v)
    return out


@pytest.mark.parametrize("n,gathered", [(0, 10_000), (1, 10_000), (2, 10_000), (999, 10_000), (5000, 10_000), (20_001, 150), (20_000, 20)])
def test_medians_are_exact(spark, monkeypatch, n, gathered):
    monkeypatch.setattr(MT, "MEDIAN_VALUES", gathered)          # few: the search goes on in smaller brackets
    data = rows(n)
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in SHAPES)).repartition(5)
    assert {r.feature: r.median for r in MT.feature_medians(df, list(SHAPES)).collect()} == want(data)


def test_a_sketch_that_misses_is_searched_again(spark, monkeypatch):
    monkeypatch.setattr(MT, "MEDIAN_ERROR", -0.1)               # brackets beside the middle
    monkeypatch.setattr(MT, "MEDIAN_VALUES", 50)
    data = rows(700)
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in SHAPES))
    assert {r.feature: r.median for r in MT.feature_medians(df, list(SHAPES)).collect()} == want(data)


def test_any_ranks(spark):
    data = sorted(random.Random(2).sample(range(10_000), 3000))
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    got = MT.order_statistics(df, {"v": lambda n: (0, 17, n // 3, n - 1)})
    assert got == {"v": [float(data[i]) for i in (0, 17, 1000, 2999)]}


def test_no_window_and_no_shuffle_of_rows(spark):
    df = spark.createDataFrame(rows(100), ", ".join(f"{c} double" for c in SHAPES))
    r = MT._Ranks("many", (5,), -1.0, 1.0, 90)
    plan = df.agg(MT.F.kll_sketch_agg_double(r.values(), MT.F.lit(100)))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
