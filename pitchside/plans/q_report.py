"""Report keys: P-16..P-18, A-04, F-05, F-06, T-01..T-04, T-06, T-08, A-13..A-15, X-01, J-02, K-03."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import features as feat
from ..operators import report as R
from ..operators.ranking import sequence_number
from ..session import run_dir
from ..sources import store as S
from . import views as V
from .oracle import ORACLE, sides_cte, with_m
from .registry import query


def _slug(sf_dir):
    return sf_dir.rstrip("/").split("/")[-1].replace(".", "_")


META = ["match_time", "odds_home", "odds_draw", "odds_away"]


def scored(spark, sf_dir):
    """Model-shaped predictions for every scheduled match (proxy probabilities)."""
    return V.slate_view(V.match_view(spark, sf_dir))


def post(spark, sf_dir):
    return R.prediction_post(scored(spark, sf_dir))


def picks(spark, sf_dir):
    return R.high_conf_picks(post(spark, sf_dir))


SLATE_CTES = ("""
sl0 AS (
  SELECT *, CAST((match_id * 11) % 50 + 1 AS DOUBLE) AS w1, CAST((match_id * 13) % 50 + 1 AS DOUBLE) AS w2,
    CAST((match_id * 17) % 50 + 1 AS DOUBLE) AS w3
  FROM m WHERE status = 'SCHEDULED'
)""", """
slate AS (
  SELECT match_id, match_date, competition, home_team, away_team, match_time, odds_home, odds_draw,
    odds_away, p_over25 AS over_2_5_probability, ((match_id * 53) % 101) / 100 AS btts_probability,
    w1 / (w1 + w2 + w3) AS prob_home_win, w2 / (w1 + w2 + w3) AS prob_draw, w3 / (w1 + w2 + w3) AS prob_away_win
  FROM sl0
)""", """
post AS (
  SELECT * REPLACE (round_even(over_2_5_probability, 4) AS over_2_5_probability,
                    round_even(btts_probability, 4) AS btts_probability,
                    round_even(prob_home_win, 4) AS prob_home_win, round_even(prob_draw, 4) AS prob_draw,
                    round_even(prob_away_win, 4) AS prob_away_win),
    (over_2_5_probability >= CAST(0.62 AS DOUBLE) OR over_2_5_probability <= 1 - CAST(0.62 AS DOUBLE))
      AS high_conf_pick,
    round_even(abs(over_2_5_probability - 0.5), 4) AS over25_confidence
  FROM slate
)""", """
picks AS (SELECT * FROM post WHERE high_conf_pick)""")


def slate_sql(body, *more):
    return with_m(body, *SLATE_CTES, *more)


POST_COLS = ["match_id", "match_date", "home_team", "away_team", "over_2_5_probability",
             "btts_probability", "prob_home_win", "prob_draw", "prob_away_win",
             "over25_confidence", "high_conf_pick"]


@query("prediction_post")
def q_prediction_post(spark, sf_dir):
    return post(spark, sf_dir).select(*POST_COLS)


ORACLE["prediction_post"] = slate_sql(f"SELECT {', '.join(POST_COLS)} FROM post")


@query("display_row")
def q_display_row(spark, sf_dir):
    return R.display_row(post(spark, sf_dir))


def _p(expr, d):
    return f"printf('%.{d}f', round_even({expr}, {d}))"


ORACLE["display_row"] = slate_sql(f"""
SELECT match_id, coalesce(match_time, '—') AS time_text, home_team, away_team,
  {_p('over_2_5_probability * 100', 1)} || '%' AS over25_text,
  {_p('btts_probability * 100', 1)} || '%' AS btts_text,
  {_p('prob_home_win * 100', 0)} || '% / ' || {_p('prob_draw * 100', 0)} || '% / '
    || {_p('prob_away_win * 100', 0)} || '%' AS x12_text,
  CASE WHEN odds_home IS NOT NULL AND odds_home <> 0
       THEN {_p('odds_home', 2)} || ' / ' || {_p('odds_draw', 2)} || ' / ' || {_p('odds_away', 2)}
       ELSE '—' END AS odds_text,
  CASE WHEN high_conf_pick THEN '✅' ELSE '' END AS star
FROM post""")


@query("confidence_band")
def q_confidence_band(spark, sf_dir):
    return R.confidence_band(post(spark, sf_dir))


ORACLE["confidence_band"] = slate_sql(f"""
SELECT match_id, over25_confidence * 200 AS conf_pct,
  CASE WHEN over25_confidence * 200 > 60 THEN 'green' ELSE 'amber' END AS bar,
  {_p('least(over25_confidence * 200, 100.0)', 0)} AS bar_width
FROM post""")


@query("slate_kpis")
def q_slate_kpis(spark, sf_dir):
    return R.slate_kpis(R.min_probability(post(spark, sf_dir), 0))


ORACLE["slate_kpis"] = slate_sql("""
SELECT match_date, count(*) AS fixtures, CAST(sum(CASE WHEN high_conf_pick THEN 1 ELSE 0 END) AS BIGINT) AS high_conf,
  round_even(avg(over_2_5_probability) * 100, 9) AS avg_over25_pct
FROM post GROUP BY match_date""")


@query("min_probability")
def q_min_probability(spark, sf_dir):
    return R.min_probability(post(spark, sf_dir), 60).select("match_id", "over_2_5_probability")


ORACLE["min_probability"] = slate_sql(
    "SELECT match_id, over_2_5_probability FROM post WHERE over_2_5_probability >= CAST(0.6 AS DOUBLE)")


@query("high_conf_picks")
def q_high_conf_picks(spark, sf_dir):
    return picks(spark, sf_dir).select("match_id", "over_2_5_probability", "high_conf_pick")


ORACLE["high_conf_picks"] = slate_sql("SELECT match_id, over_2_5_probability, high_conf_pick FROM picks")


# --- T-* -----------------------------------------------------------------------------

@query("rank_by_probability")
def q_rank_by_probability(spark, sf_dir):
    return sequence_number(post(spark, sf_dir), order=R.slate_order(),
                           buckets=R.slate_buckets(), partition=["match_date"],
                           name="rank").select("match_date", "match_id", "rank")


ORACLE["rank_by_probability"] = slate_sql("""
SELECT match_date, match_id,
  row_number() OVER (PARTITION BY match_date ORDER BY over_2_5_probability DESC, match_id) AS rank
FROM post""")


@query("order_by_kickoff")
def q_order_by_kickoff(spark, sf_dir):
    return sequence_number(post(spark, sf_dir), order=[F.col("match_time"), F.col("match_id")],
                           buckets=[F.coalesce(F.col("match_time"), F.lit("")),
                                    F.floor(F.col("match_id") / 65536)], partition=["match_date"],
                           name="kickoff_rank").select("match_date", "match_id", "match_time", "kickoff_rank")


ORACLE["order_by_kickoff"] = slate_sql("""
SELECT match_date, match_id, match_time,
  row_number() OVER (PARTITION BY match_date ORDER BY match_time, match_id) AS kickoff_rank
FROM post""")


@query("order_by_date")
def q_order_by_date(spark, sf_dir):
    d = F.col("match_date")
    return sequence_number(
        V.match_view(spark, sf_dir).select("match_id", "match_date"),
        order=[d.asc_nulls_last(), F.col("match_id")],
        buckets=[d.isNull(), F.coalesce(d, F.to_date(F.lit("1970-01-01"))),
                 F.floor(F.col("match_id") / 65536)],
        name="rn")


ORACLE["order_by_date"] = with_m(
    "SELECT match_id, match_date, row_number() OVER (ORDER BY match_date NULLS LAST, match_id) AS rn FROM m")


@query("order_by_team_date")
def q_order_by_team_date(spark, sf_dir):
    d = F.col("match_date")
    sides = feat.team_sides(V.match_view(spark, sf_dir)).select("match_id", "match_date", "team", "is_home")
    return sequence_number(sides, order=feat.form_order(),
                           buckets=[d.isNull(), F.coalesce(d, F.to_date(F.lit("1970-01-01"))),
                                    F.floor(F.col("match_id") / 65536)],
                           partition=["team"], name="game_no").select("match_id", "team", "is_home", "game_no")


ORACLE["order_by_team_date"] = with_m("""
SELECT match_id, team, is_home,
  row_number() OVER (PARTITION BY team ORDER BY match_date NULLS LAST, match_id, is_home DESC) AS game_no
FROM sides""", sides_cte())


@query("first_picks")
def q_first_picks(spark, sf_dir):
    return R.first_picks(picks(spark, sf_dir), 3).select("match_date", "match_id", "pick_no")


ORACLE["first_picks"] = slate_sql("""
SELECT * FROM (SELECT match_date, match_id,
  CAST(row_number() OVER (PARTITION BY match_date ORDER BY over_2_5_probability DESC, match_id) AS INTEGER)
    AS pick_no
  FROM picks) WHERE pick_no <= 3""")


@query("sorted_dates")
def q_sorted_dates(spark, sf_dir):
    dates = post(spark, sf_dir).select("match_date").distinct()
    return sequence_number(dates, order=[F.col("match_date")], buckets=[F.year("match_date")],
                           name="date_rank")


ORACLE["sorted_dates"] = slate_sql(
    "SELECT match_date, row_number() OVER (ORDER BY match_date) AS date_rank FROM (SELECT DISTINCT match_date FROM post)")


# --- A-13..A-15, X-01 -------------------------------------------------------------------

@query("daily_digest")
def q_daily_digest(spark, sf_dir):
    return R.daily_digest(picks(spark, sf_dir))


_HEAD = C.DIGEST_HEADER.format(brand=C.DIGEST_BRAND).replace("\n", "")
_FOOT = C.DIGEST_FOOTER.format(brand=C.DIGEST_BRAND)
ORACLE["daily_digest"] = slate_sql(f"""
SELECT match_date, row_number() OVER (PARTITION BY match_date ORDER BY over_2_5_probability DESC, match_id) AS line_no,
  '🔥 *' || home_team || ' vs ' || away_team || '*'
    || CASE WHEN coalesce(match_time, '') <> '' THEN '  ⏰ ' || match_time ELSE '' END
    || chr(10) || '   Over 2.5: *' || {_p('over_2_5_probability * 100', 1)} || '%*'
    || '  ·  BTTS: *' || {_p('coalesce(btts_probability, 0) * 100', 1)} || '%*' || chr(10) || chr(10) AS text
FROM picks
UNION ALL SELECT DISTINCT match_date, CAST(0 AS BIGINT), '{_HEAD}' || chr(10) || chr(10) FROM picks
UNION ALL SELECT match_date, count(*) + 1, '{_FOOT}' FROM picks GROUP BY match_date""")

SLOTS_SQL = f"""
slots AS (
  SELECT match_date, count(*) AS n_picks,
    coalesce(max(CASE WHEN rn = 1 THEN line END), '—') AS slot1,
    coalesce(max(CASE WHEN rn = 2 THEN line END), '—') AS slot2,
    CASE WHEN count(*) > 3 THEN max(CASE WHEN rn = 3 THEN line END) || ' (+' || CAST(count(*) - 3 AS VARCHAR)
         || ' more, see app)' ELSE coalesce(max(CASE WHEN rn = 3 THEN line END), '—') END AS slot3
  FROM (SELECT match_date, home_team || ' vs ' || away_team || ': Over 2.5 '
          || {_p('over_2_5_probability * 100', 0)} || '%' AS line,
          row_number() OVER (PARTITION BY match_date ORDER BY over_2_5_probability DESC, match_id) AS rn
        FROM picks)
  GROUP BY match_date
)"""


@query("digest_slots")
def q_digest_slots(spark, sf_dir):
    return R.digest_slots(picks(spark, sf_dir))


ORACLE["digest_slots"] = slate_sql("SELECT * FROM slots", SLOTS_SQL)


@query("digest_payload_json")
def q_digest_payload_json(spark, sf_dir):
    return R.digest_payload_json(R.digest_slots(picks(spark, sf_dir)))


def _json_sql(*fields):
    """json.dumps text of text fields: '", "' and '": "' between, escapes beyond ASCII."""
    members = " || ', ' || ".join(f"'\"{i}\": ' || CAST(to_json(CAST({f} AS VARCHAR)) AS VARCHAR)" for i, f in enumerate(fields, 1))
    return ("array_to_string(list_transform(string_split('{' || " + members + " || '}', ''), "
            "lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE printf('\\u%04x', unicode(c)) END), '')")


ORACLE["digest_payload_json"] = slate_sql(f"""
SELECT match_date, {_json_sql("strftime(match_date, '%d %B %Y')", "n_picks", "slot1", "slot2", "slot3")} AS content_variables
FROM slots""", SLOTS_SQL)


@query("oneline_payload_json")
def q_oneline_payload_json(spark, sf_dir):
    return R.oneline_payload_json(R.digest_oneline(picks(spark, sf_dir)))


@query("digest_oneline")
def q_digest_oneline(spark, sf_dir):
    return R.digest_oneline(picks(spark, sf_dir))


ONELINE_SQL = f"""
SELECT match_date, n_picks,
  CASE WHEN length(d) > 900 THEN substr(d, 1, 880) || '...(+' || CAST(n_picks - 1 AS VARCHAR) || ' more, see app)'
       ELSE d END AS details
FROM (SELECT match_date, count(*) AS n_picks,
        string_agg(home_team || ' v ' || away_team || ': O2.5 ' || {_p('over_2_5_probability * 100', 0)} || '%',
                   ' | ' ORDER BY over_2_5_probability DESC, match_id) AS d
      FROM picks GROUP BY match_date)"""
ORACLE["digest_oneline"] = slate_sql(ONELINE_SQL)
ORACLE["oneline_payload_json"] = slate_sql(f"""
SELECT match_date, n_picks, {_json_sql("'Pitchside'", "n_picks || ' High-Confidence Pick' || CASE WHEN n_picks <> 1 THEN 's' ELSE '' END",
                                       "'today'", "details")} AS content_variables
FROM ({ONELINE_SQL})""")


# --- J-02, K-03 ---------------------------------------------------------------------------

def attached(spark, sf_dir):
    preds = post(spark, sf_dir).drop(*META)
    meta = S.match_meta(spark, V.store_view(V.match_view(spark, sf_dir)))
    return preds.join(meta, "match_id", "left").select(*POST_COLS, *META)


@query("attach_metadata")
def q_attach_metadata(spark, sf_dir):
    return attached(spark, sf_dir)


ATTACH_SQL = slate_sql(f"""
SELECT {', '.join('post.' + c for c in POST_COLS)}, m.match_time, m.odds_home, m.odds_draw, m.odds_away
FROM post LEFT JOIN m USING (match_id)""")
ORACLE["attach_metadata"] = ATTACH_SQL


@query("predictions_csv")
def q_predictions_csv(spark, sf_dir):
    df = attached(spark, sf_dir)
    path = run_dir(spark, "predictions_csv", _slug(sf_dir))
    df.write.mode("overwrite").option("header", True).csv(path)
    return spark.read.option("header", True).schema(df.schema).csv(path)


ORACLE["predictions_csv"] = ATTACH_SQL
