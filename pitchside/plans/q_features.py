"""Feature-family keys: W-01..W-12, U-02, J-01, J-08, P-04, P-05, P-09..P-14, F-01..F-04."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import features as feat
from ..operators.rolling import lag_one
from ..session import run_dir
from ..sources import store as S
from . import views as V
from .oracle import (FEATURE_COLS, ORACLE, TARGET_COLS, TARGETS_SQL, W09_COLS, features_sql,
                     sides_cte, with_m)
from .registry import query


def matches(spark, sf_dir):
    return V.training_frame(V.match_view(spark, sf_dir))


def _slug(sf_dir: str) -> str:
    return sf_dir.rstrip("/").split("/")[-1].replace(".", "_")


# --- W-09 flagship -------------------------------------------------------------

@query("team_form_features")
def q_team_form_features(spark, sf_dir):
    return feat.team_form_features(matches(spark, sf_dir)).select(*W09_COLS)


ORACLE["team_form_features"] = features_sql(f"SELECT {', '.join(W09_COLS)} FROM feats")


# --- U-02, W-01..W-08 ------------------------------------------------------------

SIDE_COLS = ["match_id", "match_date", "team", "is_home", "scored", "conceded",
             "shots", "shots_ot", "corners", "over25", "btts"]


@query("union_sides")
def q_union_sides(spark, sf_dir):
    return feat.team_sides(matches(spark, sf_dir)).select(*SIDE_COLS)


ORACLE["union_sides"] = with_m(f"SELECT {', '.join(SIDE_COLS)} FROM ind", sides_cte())

_W_KEYS = {"roll_scored": "scored", "roll_conceded": "conceded", "roll_shots": "shots",
           "roll_shots_ot": "shots_ot", "roll_corners": "corners", "roll_over25": "over25",
           "roll_btts": "btts"}


def _roll_query(col):
    def q(spark, sf_dir):
        return feat.rolling_side_stats(matches(spark, sf_dir)).select(
            "match_id", "team", "is_home", col)
    return q


for _key, _v in _W_KEYS.items():
    query(_key)(_roll_query(_key))
    ORACLE[_key] = features_sql(f"SELECT match_id, team, is_home, {_key} FROM rolled")


@query("lag_one_game")
def q_lag_one_game(spark, sf_dir):
    sides = feat.team_sides(matches(spark, sf_dir))
    return lag_one(sides, key="team", order=feat.form_order(), values=["scored", "conceded"],
                   bucket=feat.form_bucket()).select(
        "match_id", "team", "is_home", "prev_scored", "prev_conceded")


ORACLE["lag_one_game"] = with_m("""
SELECT match_id, team, is_home,
  CASE WHEN team IS NOT NULL THEN lag(scored) OVER w END AS prev_scored,
  CASE WHEN team IS NOT NULL THEN lag(conceded) OVER w END AS prev_conceded
FROM ind
WINDOW w AS (PARTITION BY team ORDER BY match_date ASC NULLS LAST, match_id, is_home DESC)""",
                                sides_cte())


# --- J-01 join form of the reassembly ---------------------------------------------

@query("reassemble_sides")
def q_reassemble_sides(spark, sf_dir):
    m = matches(spark, sf_dir)
    rolled = feat.rolling_side_stats(m)
    rolls = [c for c in rolled.columns if c.startswith("roll_")]
    h = rolled.filter(F.col("is_home") == 1).select("match_id", *[F.col(c).alias(f"h_{c}") for c in rolls])
    a = rolled.filter(F.col("is_home") == 0).select("match_id", *[F.col(c).alias(f"a_{c}") for c in rolls])
    return m.select("match_id").join(h, "match_id", "left").join(a, "match_id", "left")


ORACLE["reassemble_sides"] = features_sql(
    "SELECT match_id, wide.* EXCLUDE (match_id) FROM m LEFT JOIN wide USING (match_id)")


# --- P-04, P-05 ---------------------------------------------------------------------

@query("match_targets")
def q_match_targets(spark, sf_dir):
    return feat.with_targets(V.match_view(spark, sf_dir)).select(
        "match_id", "total_goals", *C.TARGET_COLS)


ORACLE["match_targets"] = with_m(f"SELECT match_id, {TARGETS_SQL} FROM m")


@query("outcome_label")
def q_outcome_label(spark, sf_dir):
    from ..operators.models import outcome_label
    t = feat.with_targets(V.match_view(spark, sf_dir))
    return outcome_label(t).select("match_id", "outcome", "outcome_label")


ORACLE["outcome_label"] = with_m(f"""
SELECT match_id,
  CASE WHEN target_home_win = 1 THEN 1 WHEN target_draw = 1 THEN 2
       WHEN target_away_win = 1 THEN 3 ELSE 2 END AS outcome,
  CASE WHEN target_home_win = 1 THEN 0 WHEN target_draw = 1 THEN 1
       WHEN target_away_win = 1 THEN 2 ELSE 1 END AS outcome_label
FROM (SELECT match_id, {TARGETS_SQL} FROM m)""")


# --- P-09..P-12 -----------------------------------------------------------------------

@query("implied_over25")
def q_implied_over25(spark, sf_dir):
    return feat.implied_odds(matches(spark, sf_dir)).select("match_id", "ip_avg_over25", "ip_b365_over25")


ORACLE["implied_over25"] = features_sql("SELECT match_id, ip_avg_over25, ip_b365_over25 FROM feats")


@query("implied_1x2")
def q_implied_1x2(spark, sf_dir):
    return feat.implied_odds(matches(spark, sf_dir)).select(
        "match_id", "ip_avg_home", "ip_avg_draw", "ip_b365_home", "ip_b365_draw")


ORACLE["implied_1x2"] = features_sql(
    "SELECT match_id, ip_avg_home, ip_avg_draw, ip_b365_home, ip_b365_draw FROM feats")

COMPOSITE_COLS = ["comb_scoring", "comb_conceded", "home_adv_score", "comb_shots_ot",
                  "shot_ratio", "comb_over25"]


@query("composite_features")
def q_composite_features(spark, sf_dir):
    return feat.team_form_features(matches(spark, sf_dir)).select("match_id", *COMPOSITE_COLS)


ORACLE["composite_features"] = features_sql(f"SELECT match_id, {', '.join(COMPOSITE_COLS)} FROM feats")


@query("league_encode")
def q_league_encode(spark, sf_dir):
    return feat.league_encode(V.match_view(spark, sf_dir)).select("match_id", "competition", "league_enc")


ORACLE["league_encode"] = features_sql("SELECT match_id, competition, league_enc FROM feats")


@query("league_map_join")
def q_league_map_join(spark, sf_dir):
    m = V.match_view(spark, sf_dir)
    return feat.league_encode(m.select("match_id", "competition"), feat.league_codes(m)) \
        .groupBy("competition", "league_enc").agg(F.count(F.lit(1)).alias("n_matches"))


ORACLE["league_map_join"] = features_sql(
    "SELECT competition, league_enc, count(*) AS n_matches FROM feats GROUP BY competition, league_enc")


# --- P-13: the store path (no shots, corners or odds columns) ---------------------------

ADAPTIVE_COLS = (["match_id"] + [f"{s}_roll_{v}" for s in "ha" for v in ("scored", "conceded", "over25", "btts")]
                 + ["comb_scoring", "comb_conceded", "home_adv_score", "comb_shots_ot", "shot_ratio",
                    "h_roll_corners", "a_roll_corners", "comb_over25", "h_roll_shots", "a_roll_shots",
                    "league_enc"])
STORE8_CTE = """
store8 AS (
  SELECT match_id, match_date, competition, home_team, away_team, home_score, away_score, status,
    CAST(NULL AS DOUBLE) AS h_shots, CAST(NULL AS DOUBLE) AS a_shots,
    CAST(NULL AS DOUBLE) AS h_shots_ot, CAST(NULL AS DOUBLE) AS a_shots_ot,
    CAST(NULL AS DOUBLE) AS h_corners, CAST(NULL AS DOUBLE) AS a_corners,
    CAST(NULL AS DOUBLE) AS odds_avg_over25, CAST(NULL AS DOUBLE) AS odds_b365_over25,
    CAST(NULL AS DOUBLE) AS odds_home, CAST(NULL AS DOUBLE) AS odds_draw, CAST(NULL AS DOUBLE) AS odds_away,
    CAST(NULL AS DOUBLE) AS b365_home, CAST(NULL AS DOUBLE) AS b365_draw, CAST(NULL AS DOUBLE) AS b365_away
  FROM m
)"""


def store_matches(spark, sf_dir):
    return S.read_match_store(spark, V.store_view(V.match_view(spark, sf_dir)))


@query("adaptive_features")
def q_adaptive_features(spark, sf_dir):
    return feat.team_form_features(store_matches(spark, sf_dir)).select(*ADAPTIVE_COLS)


ORACLE["adaptive_features"] = features_sql(f"SELECT {', '.join(ADAPTIVE_COLS)} FROM feats",
                                           src="store8", pre=(STORE8_CTE,))


# --- P-14, F-01..F-04, W-10, W-11, J-08 ---------------------------------------------------

TRAIN_ID = ["match_id", "match_date", "competition", "home_team", "away_team"]


@query("feature_select")
def q_feature_select(spark, sf_dir):
    f = feat.team_form_features(feat.with_targets(matches(spark, sf_dir)))
    return f.select(*C.TRAIN_ID_COLS, *feat.feature_columns(f), *C.TARGET_COLS)


ORACLE["feature_select"] = features_sql(
    f"SELECT {', '.join(TRAIN_ID + FEATURE_COLS + TARGET_COLS)} FROM (SELECT *, {TARGETS_SQL} FROM feats)")


@query("drop_missing_scores")
def q_drop_missing_scores(spark, sf_dir):
    return V.store_view(V.match_view(spark, sf_dir)).dropna(subset=["home_score", "away_score"])


ORACLE["drop_missing_scores"] = with_m("""
SELECT match_id, match_date, match_time, competition, home_team, away_team,
  CAST(home_score AS INTEGER) AS home_score, CAST(away_score AS INTEGER) AS away_score,
  status, odds_home, odds_draw, odds_away
FROM m WHERE home_score IS NOT NULL AND away_score IS NOT NULL""")


@query("finished_only")
def q_finished_only(spark, sf_dir):
    f = feat.team_form_features(matches(spark, sf_dir)).filter(F.col("status") == "FINISHED")
    return f.select("match_id", "h_roll_scored", "a_roll_scored", "comb_over25")


ORACLE["finished_only"] = features_sql(
    "SELECT match_id, h_roll_scored, a_roll_scored, comb_over25 FROM feats WHERE status = 'FINISHED'")

TRAINING_SQL = features_sql(
    f"SELECT {', '.join(TRAIN_ID + FEATURE_COLS + TARGET_COLS)} FROM (SELECT *, {TARGETS_SQL} FROM feats) "
    "WHERE status = 'FINISHED' AND h_roll_scored IS NOT NULL AND h_roll_conceded IS NOT NULL "
    "AND a_roll_scored IS NOT NULL AND a_roll_conceded IS NOT NULL")


@query("training_set")
def q_training_set(spark, sf_dir):
    return feat.training_set(matches(spark, sf_dir))


ORACLE["training_set"] = TRAINING_SQL


@query("training_from_csv")
def q_training_from_csv(spark, sf_dir):
    """W-10 on its default source: season CSV files → features → training rows."""
    from ..sources.training import training_matches
    root = run_dir(spark, "training_csv", _slug(sf_dir))
    V.write_season_csvs(V.match_view(spark, sf_dir), root)
    return feat.training_set(training_matches(spark, root, V.store_view(V.match_view(spark, sf_dir))))


@query("drop_cold_start")
def q_drop_cold_start(spark, sf_dir):
    return feat.training_set(matches(spark, sf_dir)).select(*C.FEATURE_COLS[:4], "match_id")


ORACLE["drop_cold_start"] = (
    "SELECT match_id, h_roll_scored, h_roll_conceded, a_roll_scored, a_roll_conceded FROM ("
    + TRAINING_SQL + ")")

# the busiest day, the earliest of several
RUN_DATE = "(SELECT match_date FROM m GROUP BY match_date ORDER BY count(*) DESC, match_date LIMIT 1)"
LIVE_COLS = ["match_id", "match_date", "home_team", "away_team"] + FEATURE_COLS


@query("asof_day")
def q_asof_day(spark, sf_dir):
    return feat.live_feature_rows(matches(spark, sf_dir), V.run_date(V.match_view(spark, sf_dir)), prune=False)


ORACLE["asof_day"] = features_sql(
    f"SELECT {', '.join(LIVE_COLS)} FROM feats WHERE match_date = {RUN_DATE}")


@query("live_feature_rows")
def q_live_feature_rows(spark, sf_dir):
    return feat.live_feature_rows(matches(spark, sf_dir), V.run_date(V.match_view(spark, sf_dir)), prune=True)


ORACLE["live_feature_rows"] = ORACLE["asof_day"]


@query("prune_to_active_teams")
def q_prune_to_active_teams(spark, sf_dir):
    m = matches(spark, sf_dir)
    sides = feat.team_sides(m).join(feat.teams_on(m, V.run_date(V.match_view(spark, sf_dir))), "team", "left_semi")
    return sides.select("match_id", "team", "is_home")


ORACLE["prune_to_active_teams"] = with_m(f"""
SELECT match_id, team, is_home FROM ind
WHERE team IN (SELECT home_team FROM m WHERE match_date = {RUN_DATE}
               UNION SELECT away_team FROM m WHERE match_date = {RUN_DATE})""", sides_cte())


# --- W-12: score-a-list flow (history ∪ listed fixtures → features → chosen day) ----------

@query("fixture_list_features")
def q_fixture_list_features(spark, sf_dir):
    m = matches(spark, sf_dir)
    run = V.run_date(V.match_view(spark, sf_dir))
    path = run_dir(spark, "fixture_list", _slug(sf_dir))
    upcoming = m.filter((F.col("status") == "SCHEDULED") & (F.col("match_date") >= F.to_date(F.lit(run))))
    S.write_fixture_list(upcoming, path)
    return feat.fixture_list_features(m, S.read_fixture_list(spark, path), run)


LISTED_CTE = f"""
listed AS (
  SELECT * FROM m WHERE NOT (status = 'SCHEDULED' AND match_date >= {RUN_DATE})
  UNION ALL BY NAME
  SELECT match_id, match_date, competition, home_team, away_team, 'SCHEDULED' AS status
  FROM m WHERE status = 'SCHEDULED' AND match_date >= {RUN_DATE}
)"""
ORACLE["fixture_list_features"] = features_sql(
    f"SELECT {', '.join(LIVE_COLS)} FROM feats WHERE match_date = {RUN_DATE}",
    src="listed", pre=(LISTED_CTE,))
