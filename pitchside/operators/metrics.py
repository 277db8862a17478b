"""Evaluation metrics as aggregates: base rates, classification metrics, AUC, tiers, CV."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.columns import nan_to_null
from ..session import run_dir
from .ranking import count_before, sequence_number

DIGITS = 10        # whole-table float sums: rounded so partitioning cannot change the last bits


def over25_base_rate(scores: DataFrame, min_rows: int = C.MIN_BACKTEST_ROWS) -> DataFrame:
    """A-03 / F-09: finished count, over-2.5 count and share (a NULL total counts as under).

    Fewer than ``min_rows`` finished matches → no row (the reference prints nothing).
    """
    total = F.col("home_score") + F.col("away_score")
    agg = scores.agg(F.count(F.lit(1)).alias("total_games"),
                     F.sum(F.when(total > 2.5, 1).otherwise(0)).cast("long").alias("over25_games"))
    return agg.filter(F.col("total_games") >= min_rows).withColumn(
        "over25_pct", F.bround(F.col("over25_games") / F.col("total_games") * 100, DIGITS))


MEDIAN_SKETCH = 1000         # size of the quantile sketches
MEDIAN_ERROR = 2 * 2.3 / MEDIAN_SKETCH ** 0.9     # twice the rank error that a sketch of that size has almost surely
MEDIAN_VALUES = 10_000       # values of a feature that are gathered to pick from


@dataclass
class _Ranks:
    """Ranks of a column still searched among its ``size`` values strictly between ``low`` and ``high`` (None: open)."""
    column: str
    ranks: tuple[int, ...]
    low: float | None
    high: float | None
    size: int

    def values(self) -> Column:
        v, inside = F.col(self.column), F.col(self.column).isNotNull()
        if self.low is not None:
            inside = inside & (v > self.low)
        if self.high is not None:
            inside = inside & (v < self.high)
        return F.when(inside, v)


def order_statistics(values: DataFrame, ranks: dict[str, Callable[[int], tuple[int, ...]]]) -> dict[str, list[float]]:
    """Exact values at ranks of double columns; ``ranks`` gives the wanted 0-based ranks of a column from its number of values.

    A mergeable quantile sketch brackets the ranks by two values of the column; one aggregate counts below, at and between
    them and gathers what lies between, if that is at most ``MEDIAN_VALUES`` by the sketch's error.  A rank that hits a
    bracket's end is that value, however often it occurs; one that lies outside (the sketch missed), or between ends too far
    apart to gather, is searched on there.  Every aggregate is one row with partial steps: nothing is shuffled or sorted.
    """
    open_ = [_Ranks(c, (), None, None, -1) for c in ranks]
    wanted: dict[str, tuple[int, ...]] = {}
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}      # by rank in the whole column
    jobs = [(r, 0) for r in open_]                                    # with the number of values before the bracket
    while jobs:
        ends = []
        for k, (r, _) in enumerate(jobs):
            sketch = F.kll_sketch_agg_double(r.values(), F.lit(MEDIAN_SKETCH))
            at = [0.5] if r.size < 0 else [(x + 0.5) / r.size for x in (min(r.ranks), max(r.ranks))]
            near = [F.lit(min(max(q, 0.0), 1.0)) for q in (at[0] - MEDIAN_ERROR, at[-1] + MEDIAN_ERROR)]
            n = F.count(r.values())
            ends.append(F.struct(n.alias("n"), *[F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, q)).alias(x)
                                                 for q, x in zip(near, ("a", "b"))]).alias(f"e{k}"))
        got = values.agg(*ends).first()
        cuts, splits = [], []
        for k, (r, before) in enumerate(jobs):
            n, a, b = got[f"e{k}"]
            if r.size < 0:
                r = _Ranks(r.column, tuple(dict.fromkeys(ranks[r.column](n))) if n else (), None, None, n)
                wanted[r.column] = r.ranks
            if r.ranks:
                v = r.values()
                between = F.when((v > a) & (v < b), v)
                few = 2 * MEDIAN_ERROR * r.size <= MEDIAN_VALUES or r.size <= MEDIAN_VALUES
                splits.append(F.struct(F.count_if(v < a).alias("under"), F.count_if(v == a).alias("at_a"), F.count(between).alias("mid"),
                                       F.count_if(v == b).alias("at_b"), (F.collect_list(between) if few else F.lit(None).cast("array<double>"))
                                       .alias("list")).alias(f"s{len(cuts)}"))
                cuts.append((r, before, a, b, few))
        jobs = []
        if not cuts:
            break
        got = values.agg(*splits).first()
        for k, (r, before, a, b, few) in enumerate(cuts):
            under, at_a, mid, at_b, listed = got[f"s{k}"]
            at_b = 0 if a == b else at_b
            listed = sorted(listed) if few else None
            inner: dict[tuple, list[int]] = {}
            for x in r.ranks:
                if x < under:
                    inner.setdefault((r.low, a, under, 0), []).append(x)
                elif x < under + at_a:
                    found[r.column][before + x] = a
                elif x < under + at_a + mid:
                    if few:
                        found[r.column][before + x] = listed[x - under - at_a]
                    else:
                        inner.setdefault((a, b, mid, under + at_a), []).append(x - under - at_a)
                elif x < under + at_a + mid + at_b:
                    found[r.column][before + x] = b
                else:
                    skip = under + at_a + mid + at_b
                    inner.setdefault((b, r.high, r.size - skip, skip), []).append(x - skip)
            jobs += [(_Ranks(r.column, tuple(xs), low, high, size), before + skip) for (low, high, size, skip), xs in inner.items()]
    return {c: [found[c][x] for x in wanted[c]] for c in ranks}


def feature_medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A-05: exact interpolated median per feature as ``(feature, median)`` rows; a feature without values has none.

    The feature columns are stored once and searched by :func:`order_statistics`.
    """
    spark = train.sparkSession
    path = run_dir(spark, "median_values")
    train.select(*[nan_to_null(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).write.parquet(path)
    middle = lambda n: ((n - 1) // 2, n // 2)
    got = order_statistics(spark.read.parquet(path), {f"v{i}": middle for i in range(len(cols))})
    rows = [(c, sum(got[f"v{i}"]) / len(got[f"v{i}"])) for i, c in enumerate(cols) if got[f"v{i}"]]        # one per feature
    return spark.createDataFrame(rows, "feature string, median double")


def target_base_rates(train: DataFrame) -> DataFrame:
    """A-06: mean of each of the five targets."""
    return train.agg(*[F.avg(c).alias(f"rate_{c}") for c in C.TARGET_COLS])


def class_weights(train: DataFrame, labels: dict[str, str]) -> DataFrame:
    """A-07: "balanced" weights n / (k · n_class) per market (``labels``: market → label column)."""
    long = None
    for market, col in labels.items():
        part = train.select(F.lit(market).alias("market"), F.col(col).cast("int").alias("label"))
        long = part if long is None else long.unionByName(part)
    counts = long.groupBy("market", "label").agg(F.count(F.lit(1)).alias("n_class"))
    per = counts.groupBy("market").agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.join(per, "market").select(
        "market", "label", "n_class",
        F.bround(F.col("n") / (F.col("k") * F.col("n_class")), DIGITS).alias("weight"))


def classification_metrics(preds: DataFrame, y: str = "y", p: str = "p", cut: float = 0.5) -> DataFrame:
    """A-08: accuracy, Brier, precision, recall at ``cut``; an empty denominator gives 0."""
    yhat = F.when(F.col(p) >= cut, 1).otherwise(0)
    yy = F.col(y)
    m = preds.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(yhat == yy, 1).otherwise(0)).alias("correct"),
        F.sum(F.pow(F.col(p) - yy, 2)).alias("sq"),
        F.sum(F.when((yhat == 1) & (yy == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(yhat == 1, 1).otherwise(0)).alias("pp"),
        F.sum(F.when(yy == 1, 1).otherwise(0)).alias("ap"),
    )
    safe = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0))), F.lit(0.0))
    return m.select(
        "n",
        F.bround(F.col("correct") / F.col("n"), DIGITS).alias("accuracy"),
        F.bround(F.col("sq") / F.col("n"), DIGITS).alias("brier"),
        F.bround(safe("tp", "pp"), DIGITS).alias("precision"),
        F.bround(safe("tp", "ap"), DIGITS).alias("recall"))


AUC_BUCKETS = 1 << 16     # score bands for the running count (the band totals are one small window)


def auc_roc(preds: DataFrame, y: str = "y", p: str = "p", buckets: int = AUC_BUCKETS) -> DataFrame:
    """A-09: ROC AUC with ties counted half (mid-rank formula), exact; rows without a score are left out.

    Scores are first reduced to distinct values with positive/negative
    counts; "negatives below this score" is a bucketed running count
    (:func:`count_before`), so no step sorts the whole table in one task.
    """
    per = preds.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("long").alias("neg"))
    bucket = F.least(F.greatest(F.floor(F.col("score") * buckets), F.lit(-1)), F.lit(buckets))
    below = count_before(per, key="score", weight="neg", bucket=bucket, name="neg_below")
    num = F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg")))
    agg = below.agg(num.alias("num2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select("n_pos", "n_neg", F.bround(
        F.col("num2") / (2.0 * F.col("n_pos") * F.col("n_neg")), DIGITS).alias("auc"))


def tiers_frame(spark: SparkSession, tiers: Sequence[float] = C.CONFIDENCE_TIERS) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in tiers],
                                 T.StructType([T.StructField("tier", T.DoubleType(), False)]))


def tier_membership(preds: DataFrame, tiers: DataFrame, p: str = "p") -> DataFrame:
    """J-07: each prediction joins every tier with p >= t or p <= 1 - t (overlapping, non-equi).

    The tier table is the fixed list of thresholds (4 rows), broadcast.
    """
    cond = (F.col(p) >= F.col("tier")) | (F.col(p) <= 1 - F.col("tier"))
    return preds.crossJoin(F.broadcast(tiers)).filter(cond)


def confidence_tiers(preds: DataFrame, tiers: DataFrame, y: str = "y", p: str = "p",
                     min_rows: int = C.MIN_TIER_ROWS) -> DataFrame:
    """A-10: per tier — games, accuracy at 0.5, share of all predictions; tiers < 30 rows skipped."""
    total = preds.agg(F.count(F.lit(1)).alias("__all"))
    yhat = F.when(F.col(p) >= 0.5, 1).otherwise(0)
    per = tier_membership(preds, tiers, p).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_games"),
        F.sum(F.when(yhat == F.col(y), 1).otherwise(0)).alias("__ok"))
    return per.filter(F.col("n_games") >= min_rows).crossJoin(total).select(
        "tier", "n_games",
        F.bround(F.col("__ok") / F.col("n_games"), DIGITS).alias("accuracy"),
        F.bround(F.col("n_games") / F.col("__all") * 100, DIGITS).alias("pct_of_all"))


FOLD_HASH_MUL, FOLD_HASH_MOD = 40503, 1_000_000_007   # ~1e9 distinct keys; id * mul fits in 64 bits
FOLD_BUCKET = 1 << 16                                  # ~15k numbering buckets per class


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = C.CV_FOLDS,
                     seed: int = C.SEED) -> DataFrame:
    """L-05: shuffled, stratified fold ids: within each class, rows in a seeded
    pseudo-random order are dealt round-robin to ``k`` folds (class counts per
    fold differ by at most one).  The in-class position is a bucketed row number,
    so a dominant class is not numbered in one task.
    """
    h = F.pmod(F.col(id_col) * FOLD_HASH_MUL + seed, F.lit(FOLD_HASH_MOD))
    staged = df.withColumn("__h", h)
    numbered = sequence_number(staged, order=[F.col("__h"), F.col(id_col)],
                               buckets=[F.floor(F.col("__h") / FOLD_BUCKET)], partition=[label], name="__rank")
    return numbered.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__h", "__rank")


def cv_summary(fold_preds: DataFrame, y: str = "y", p: str = "p", fold: str = "fold") -> DataFrame:
    """A-11 / L-06: per-fold accuracy, then their mean and population std."""
    yhat = F.when(F.col(p) >= 0.5, 1).otherwise(0)
    per = fold_preds.groupBy(fold).agg(F.avg(F.when(yhat == F.col(y), 1).otherwise(0)).alias("acc"))
    return per.agg(F.count(F.lit(1)).alias("folds"),
                   F.bround(F.avg("acc"), DIGITS).alias("cv_mean"),
                   F.bround(F.stddev_pop("acc"), DIGITS).alias("cv_std"))


def soft_vote(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """L-03: unweighted mean of class probabilities."""
    acc = None
    for c in cols:
        acc = F.col(c) if acc is None else acc + F.col(c)
    return df.withColumn(name, acc / len(cols))
