"""Metric keys: A-03, A-05..A-11, J-07, L-03, L-05, F-09, P-15."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import features as feat
from ..operators import metrics as MT
from ..operators.models import impute_features, medians_row, outcome_label
from ..session import scratch_dir
from ..sources import store as S
from . import views as V
from .oracle import FEATURE_COLS, ORACLE, TARGET_COLS, features_sql, with_m
from .q_features import TRAINING_SQL, matches
from .registry import query

PREDS_CTE = """
preds AS (SELECT doc_id, quality AS y, ((doc_id * 37) % 101) / 100 AS p, ((doc_id * 53) % 101) / 100 AS p2
          FROM labels)"""


def preds(spark, sf_dir):
    return V.preds_view(spark, sf_dir)


def train(spark, sf_dir):
    return feat.training_set(matches(spark, sf_dir))


def pred_sql(body, *more):
    return f"WITH {PREDS_CTE}{''.join(',' + c for c in more)}\n{body}"


def _r(expr, d=10):
    return f"round_even({expr}, {d})"


# --- A-03 --------------------------------------------------------------------------

@query("over25_base_rate")
def q_over25_base_rate(spark, sf_dir):
    return MT.over25_base_rate(S.finished_scores(spark, V.store_view(V.match_view(spark, sf_dir))))


ORACLE["over25_base_rate"] = with_m(f"""
SELECT * FROM (
  SELECT count(*) AS total_games,
    CAST(sum(CASE WHEN home_score + away_score > 2.5 THEN 1 ELSE 0 END) AS BIGINT) AS over25_games,
    {_r('sum(CASE WHEN home_score + away_score > 2.5 THEN 1 ELSE 0 END) / count(*) * 100')} AS over25_pct
  FROM m WHERE status = 'FINISHED') WHERE total_games >= 5""")


# --- A-05, A-06, A-07, F-09, P-15 over the training set -----------------------------------

@query("feature_medians")
def q_feature_medians(spark, sf_dir):
    t = train(spark, sf_dir)
    return MT.feature_medians(t, feat.feature_columns(t)).withColumn("median", F.bround("median", 10))


ORACLE["feature_medians"] = (
    "SELECT feature, " + _r("median(value)") + " AS median FROM (UNPIVOT (SELECT "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLS) + " FROM (" + TRAINING_SQL
    + ")) ON " + ", ".join(FEATURE_COLS) + " INTO NAME feature VALUE value) GROUP BY feature")


@query("target_base_rates")
def q_target_base_rates(spark, sf_dir):
    return MT.target_base_rates(train(spark, sf_dir))


ORACLE["target_base_rates"] = (
    "SELECT " + ", ".join(f"avg({c}) AS rate_{c}" for c in TARGET_COLS) + " FROM (" + TRAINING_SQL + ")")

MARKETS = {"over25": "target_over25", "btts": "target_btts", "outcome": "outcome_label"}


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return MT.class_weights(outcome_label(train(spark, sf_dir)), MARKETS)


ORACLE["class_weights"] = f"""
WITH t AS ({TRAINING_SQL}),
lab AS (
  SELECT 'over25' AS market, CAST(target_over25 AS INTEGER) AS label FROM t
  UNION ALL SELECT 'btts', CAST(target_btts AS INTEGER) FROM t
  UNION ALL SELECT 'outcome', CASE WHEN target_home_win = 1 THEN 0 WHEN target_draw = 1 THEN 1
                                   WHEN target_away_win = 1 THEN 2 ELSE 1 END FROM t
),
c AS (SELECT market, label, count(*) AS n_class FROM lab GROUP BY ALL),
tot AS (SELECT market, sum(n_class) AS n, count(*) AS k FROM c GROUP BY market)
SELECT market, label, n_class, {_r('n / (k * n_class)')} AS weight FROM c JOIN tot USING (market)"""


@query("min_rows_guard")
def q_min_rows_guard(spark, sf_dir):
    """F-09: the training abort: rows of the training set, and whether there are enough (>= 50) to train."""
    return train(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("trains", F.col("n_rows") >= C.MIN_TRAIN_ROWS)


ORACLE["min_rows_guard"] = f"SELECT count(*) AS n_rows, count(*) >= {C.MIN_TRAIN_ROWS} AS trains FROM ({TRAINING_SQL})"


@query("impute_features")
def q_impute_features(spark, sf_dir):
    """P-15: scheduled matches' features with NULLs → training medians (→ 0.0 if none)."""
    m = matches(spark, sf_dir)
    scratch_dir(spark)
    f = feat.team_form_features(m).checkpoint()      # read twice: medians and scheduled rows
    t = f.filter(F.col("status") == "FINISHED").dropna(subset=C.FEATURE_COLS[:4])
    cols = feat.feature_columns(f)
    live = f.filter(F.col("status") == "SCHEDULED")
    medians = medians_row(t, cols).select(*[F.bround(c, 10).alias(c) for c in cols])
    return impute_features(live, cols, medians).select("match_id", *cols)


ORACLE["impute_features"] = features_sql(
    "SELECT match_id, " + ", ".join(
        f"coalesce(CAST(feats.{c} AS DOUBLE), md.{c}, 0.0) AS {c}" for c in FEATURE_COLS)
    + " FROM feats, md WHERE status = 'SCHEDULED'",
    "md AS (SELECT " + ", ".join(f"{_r(f'median({c})')} AS {c}" for c in FEATURE_COLS)
    + " FROM feats WHERE status = 'FINISHED' AND h_roll_scored IS NOT NULL AND h_roll_conceded IS NOT NULL"
      " AND a_roll_scored IS NOT NULL AND a_roll_conceded IS NOT NULL)")


# --- A-08..A-11, J-07, L-03, L-05 on PREDS -------------------------------------------------

@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    return MT.classification_metrics(preds(spark, sf_dir))


ORACLE["classification_metrics"] = pred_sql(f"""
SELECT count(*) AS n,
  {_r('sum(CASE WHEN (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) = y THEN 1 ELSE 0 END) / count(*)')} AS accuracy,
  {_r('sum(pow(p - y, 2)) / count(*)')} AS brier,
  {_r('coalesce(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 0), 0.0)')} AS precision,
  {_r('coalesce(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END), 0), 0.0)')} AS recall
FROM preds""")


@query("auc_roc")
def q_auc_roc(spark, sf_dir):
    return MT.auc_roc(preds(spark, sf_dir))


ORACLE["auc_roc"] = pred_sql(f"""
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  {_r('sum(pos * (2 * neg_below + neg)) / (2.0 * sum(pos) * sum(neg))')} AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS neg_below
      FROM (SELECT p AS score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM preds GROUP BY p))""")

TIERS_CTE = """
tiers AS (SELECT CAST(t AS DOUBLE) AS tier FROM (VALUES (0.55), (0.60), (0.65), (0.70)) v(t))"""


@query("tier_range_join")
def q_tier_range_join(spark, sf_dir):
    return MT.tier_membership(preds(spark, sf_dir), MT.tiers_frame(spark)).select("doc_id", "tier")


ORACLE["tier_range_join"] = pred_sql(
    "SELECT doc_id, tier FROM preds JOIN tiers ON p >= tier OR p <= 1 - tier", TIERS_CTE)


@query("confidence_tiers")
def q_confidence_tiers(spark, sf_dir):
    return MT.confidence_tiers(preds(spark, sf_dir), MT.tiers_frame(spark))


ORACLE["confidence_tiers"] = pred_sql(f"""
SELECT tier, count(*) AS n_games,
  {_r('sum(CASE WHEN (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) = y THEN 1 ELSE 0 END) / count(*)')} AS accuracy,
  {_r('count(*) / (SELECT count(*) FROM preds) * 100')} AS pct_of_all
FROM preds JOIN tiers ON p >= tier OR p <= 1 - tier
GROUP BY tier HAVING count(*) >= 30""", TIERS_CTE)

FOLDS_CTE = """
folds AS (
  SELECT doc_id, y, p, p2,
    CAST((row_number() OVER (PARTITION BY y ORDER BY ((doc_id * 40503 + 42) % 1000000007 + 1000000007) % 1000000007,
                                                      doc_id) - 1) % 5 AS INTEGER) AS fold
  FROM preds
)"""


@query("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    return MT.stratified_folds(preds(spark, sf_dir), "doc_id", "y").select("doc_id", "y", "fold")


ORACLE["stratified_folds"] = pred_sql("SELECT doc_id, y, fold FROM folds", FOLDS_CTE)


@query("cv_summary")
def q_cv_summary(spark, sf_dir):
    return MT.cv_summary(MT.stratified_folds(preds(spark, sf_dir), "doc_id", "y"))


ORACLE["cv_summary"] = pred_sql(f"""
SELECT count(*) AS folds, {_r('avg(acc)')} AS cv_mean, {_r('stddev_pop(acc)')} AS cv_std
FROM (SELECT fold, avg(CASE WHEN (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) = y THEN 1 ELSE 0 END) AS acc
      FROM folds GROUP BY fold)""", FOLDS_CTE)


@query("soft_vote")
def q_soft_vote(spark, sf_dir):
    df = MT.soft_vote(preds(spark, sf_dir), ["p", "p2"], "vote_p")
    return df.select("doc_id", "vote_p", (1 - F.col("vote_p")).alias("vote_q"))


ORACLE["soft_vote"] = pred_sql("SELECT doc_id, (p + p2) / 2 AS vote_p, 1 - (p + p2) / 2 AS vote_q FROM preds")
