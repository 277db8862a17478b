"""Ingest keys: S-03, S-04, A-01, A-02, P-06..P-08, F-07, F-08, J-03..J-05."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import odds as O
from ..sources import payloads as P
from . import views as V
from .oracle import ORACLE, with_m
from .registry import query


def fixture_docs(spark, sf_dir):
    return V.fixture_payloads(V.match_view(spark, sf_dir))


def odds_docs(spark, sf_dir):
    return V.odds_payloads(spark, sf_dir, V.match_view(spark, sf_dir))


def parsed_fixtures(spark, sf_dir):
    return P.parse_fixtures(fixture_docs(spark, sf_dir))


def odds_map(spark, sf_dir):
    return P.parse_odds(odds_docs(spark, sf_dir))


def odds_snapshot(spark, sf_dir):
    """The parsed odds map, materialised once (a reliable checkpoint in the shared folder): the
    enrichment reads it three times (exact lookup, substring index, fuzzy odds)."""
    from ..session import scratch_dir
    scratch_dir(spark)
    return odds_map(spark, sf_dir).checkpoint()


# --- SQL twins of the landed payloads (computed from M, no JSON) -------------------

FEED_CTES = ("""
fm AS (
  SELECT match_id, match_date,
    CASE WHEN competition IN ('1-URGENT', '2-HIGH') THEN home_team
         WHEN competition = '5-LOW' THEN 'Club ' || substr(home_team, 2) ELSE home_team || ' FC' END AS home_team,
    CASE WHEN competition IN ('1-URGENT', '2-HIGH') THEN away_team
         WHEN competition = '5-LOW' THEN 'Club ' || substr(away_team, 2) ELSE away_team || ' FC' END AS away_team
  FROM m)""", """
fl AS (
  SELECT l_orderkey AS match_id, l_partkey AS pk, l_suppkey AS sk,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_quantity, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS book_pos
  FROM lineitem WHERE l_orderkey IN (SELECT match_id FROM fm)
)""", """
fb AS (
  SELECT match_id, pk FROM (
    SELECT match_id, pk, row_number() OVER (PARTITION BY match_id ORDER BY book_pos) AS r
    FROM fl WHERE sk % 6 < 4) WHERE r = 1
)""", """
fe AS (
  SELECT fm.*, c.copy,
    CAST(floor(fm.match_id / 2000) AS BIGINT) * 4294967296
      + row_number() OVER (PARTITION BY fm.match_date, floor(fm.match_id / 2000)
                           ORDER BY c.copy, fm.match_id) - 1 AS pos
  FROM fm CROSS JOIN (VALUES (0), (1)) AS c(copy)
  WHERE c.copy = 0 OR fm.match_id % 15 = 0
)""", """
fo AS (
  SELECT fe.match_date AS feed_date, fe.pos, fe.match_id, fe.copy, fe.home_team, fe.away_team,
    CASE WHEN fe.match_id % 35 = 0 OR fb.pk IS NULL OR fb.pk % 4 = 0 THEN CAST(2.1 AS DOUBLE)
         WHEN fb.pk % 11 = 0 THEN (11 + fb.pk % 40 + 3) / 10 + fe.copy * 0.5
         WHEN fb.pk % 5 <> 0 THEN (11 + fb.pk % 40) / 10 + fe.copy * 0.5
         ELSE CAST(2.1 AS DOUBLE) END AS odds_home,
    CASE WHEN fe.match_id % 35 = 0 OR fb.pk IS NULL OR fb.pk % 4 = 0 OR fb.pk % 3 = 0
         THEN CAST(3.2 AS DOUBLE) ELSE (11 + fb.pk % 40 + 2) / 10 + fe.copy * 0.5 END AS odds_draw,
    CASE WHEN fe.match_id % 35 = 0 OR fb.pk IS NULL OR fb.pk % 4 = 0 OR fb.pk % 7 = 0
         THEN CAST(3.4 AS DOUBLE) ELSE (11 + fb.pk % 40 + 1) / 10 + fe.copy * 0.5 END AS odds_away
  FROM fe LEFT JOIN fb USING (match_id)
)""", """
fmap AS (
  SELECT feed_date, lower(home_team) || ' vs ' || lower(away_team) AS norm_key, min(pos) AS pos,
    arg_max(odds_home, pos) AS odds_home, arg_max(odds_draw, pos) AS odds_draw,
    arg_max(odds_away, pos) AS odds_away
  FROM fo GROUP BY feed_date, norm_key
)""")

FIXTURE_CTES = ("""
fx AS (
  SELECT match_id, match_date,
    CASE WHEN match_id % 13 = 0 THEN '15:00' ELSE match_time END AS match_time,
    CASE WHEN match_id % 17 = 0 THEN 'Unknown League' ELSE competition END AS competition,
    home_team, away_team,
    CAST(home_score AS INTEGER) AS home_score, CAST(away_score AS INTEGER) AS away_score,
    CASE WHEN status = 'SCHEDULED' THEN 'NS' ELSE ['FT', 'AET', 'PEN'][match_id % 3 + 1] END AS status_short,
    status
  FROM m WHERE dayofmonth(match_date) NOT IN (13, 29)
)""", """
fk AS (
  SELECT *, lower(coalesce(home_team, 'None')) AS h, lower(coalesce(away_team, 'None')) AS a,
    lower(coalesce(home_team, 'None')) || ' vs ' || lower(coalesce(away_team, 'None')) AS k
  FROM fx
)""", """
ex AS (
  SELECT fk.match_id, fmap.norm_key, fmap.odds_home, fmap.odds_draw, fmap.odds_away
  FROM fk JOIN fmap ON fmap.feed_date = fk.match_date AND fmap.norm_key = fk.k
)""", """
fz AS (
  SELECT fk.match_id, min(fmap.pos) AS pos, arg_min(fmap.odds_home, fmap.pos) AS odds_home,
    arg_min(fmap.odds_draw, fmap.pos) AS odds_draw, arg_min(fmap.odds_away, fmap.pos) AS odds_away
  FROM fk JOIN fmap ON fmap.feed_date = fk.match_date
    AND (contains(fmap.norm_key, fk.h) OR contains(fmap.norm_key, fk.a))
  WHERE fk.match_id NOT IN (SELECT match_id FROM ex)
  GROUP BY fk.match_id
)""")


def ingest_sql(body: str) -> str:
    return with_m(body, *FEED_CTES, *FIXTURE_CTES)


FIX_COLS = ["match_id", "match_date", "match_time", "competition", "home_team", "away_team",
            "home_score", "away_score", "status_short", "status"]


# --- S-03, P-06, P-07, P-08 --------------------------------------------------------

@query("fixtures_json_ingest")
def q_fixtures_json_ingest(spark, sf_dir):
    return parsed_fixtures(spark, sf_dir)


ORACLE["fixtures_json_ingest"] = ingest_sql(f"SELECT {', '.join(FIX_COLS)} FROM fx")


@query("status_normalise")
def q_status_normalise(spark, sf_dir):
    return parsed_fixtures(spark, sf_dir).select("match_id", "status_short", "status")


ORACLE["status_normalise"] = ingest_sql("SELECT match_id, status_short, status FROM fx")


@query("fixture_fields")
def q_fixture_fields(spark, sf_dir):
    return parsed_fixtures(spark, sf_dir).select("match_id", "match_date", "match_time", "competition")


ORACLE["fixture_fields"] = ingest_sql("SELECT match_id, match_date, match_time, competition FROM fx")


@query("norm_match_key")
def q_norm_match_key(spark, sf_dir):
    from ..functions.columns import norm_match_key
    return parsed_fixtures(spark, sf_dir).select(
        "match_id", norm_match_key(F.col("home_team"), F.col("away_team")).alias("norm_key"))


ORACLE["norm_match_key"] = ingest_sql("SELECT match_id, k AS norm_key FROM fk")


# --- S-04, A-01, A-02, F-07, F-08 ----------------------------------------------------

@query("odds_per_match")
def q_odds_per_match(spark, sf_dir):
    return P.odds_per_match(P.odds_entries(odds_docs(spark, sf_dir)))


ORACLE["odds_per_match"] = ingest_sql(
    "SELECT feed_date, pos, home_team, away_team, odds_home, odds_draw, odds_away FROM fo")


@query("odds_json_ingest")
def q_odds_json_ingest(spark, sf_dir):
    return odds_map(spark, sf_dir)


ORACLE["odds_json_ingest"] = ingest_sql(
    "SELECT feed_date, pos, norm_key, odds_home, odds_draw, odds_away FROM fmap")


@query("odds_map_dedupe")
def q_odds_map_dedupe(spark, sf_dir):
    """The whole per-day map with the number of feed entries behind each key."""
    per = P.odds_per_match(P.odds_entries(odds_docs(spark, sf_dir)))
    return P.odds_map(per, count="copies")


ORACLE["odds_map_dedupe"] = ingest_sql("""
SELECT fmap.*, d.copies FROM fmap JOIN (
  SELECT feed_date, lower(home_team) || ' vs ' || lower(away_team) AS norm_key, count(*) AS copies
  FROM fo GROUP BY ALL) d USING (feed_date, norm_key)""")


@query("bookmaker_whitelist")
def q_bookmaker_whitelist(spark, sf_dir):
    return P.whitelisted_bookmakers(P.odds_entries(odds_docs(spark, sf_dir))).drop("b")


FEED_BOOKS_SQL = """
  SELECT fe.match_date AS feed_date, fe.pos, fl.book_pos,
    ['sportybet', 'onexbet', 'bet365', 'betway'][fl.sk % 6 + 1] AS bookmaker, fl.pk
  FROM fe JOIN fl USING (match_id)
  WHERE fe.match_id % 35 <> 0 AND fl.sk % 6 < 4"""

ORACLE["bookmaker_whitelist"] = ingest_sql(
    f"SELECT feed_date, pos, book_pos, bookmaker FROM ({FEED_BOOKS_SQL})")


@query("h2h_market")
def q_h2h_market(spark, sf_dir):
    return P.h2h_markets(P.odds_entries(odds_docs(spark, sf_dir)))


ORACLE["h2h_market"] = ingest_sql(f"""
SELECT feed_date, pos, book_pos, bookmaker, 0 AS market_pos,
  CAST((pk % 5 <> 0)::INT + (pk % 7 <> 0)::INT + (pk % 3 <> 0)::INT + (pk % 11 = 0)::INT AS INTEGER)
    AS n_outcomes
FROM ({FEED_BOOKS_SQL}) WHERE pk % 4 <> 0""")


# --- J-03, J-04, J-05 -------------------------------------------------------------------

@query("odds_exact")
def q_odds_exact(spark, sf_dir):
    ex = O.exact_odds(parsed_fixtures(spark, sf_dir), odds_snapshot(spark, sf_dir))
    return ex.filter(F.col("__xh").isNotNull()).select(
        "match_id", F.col("__key").alias("norm_key"), F.col("__xh").alias("odds_home"),
        F.col("__xd").alias("odds_draw"), F.col("__xa").alias("odds_away"))


ORACLE["odds_exact"] = ingest_sql("SELECT * FROM ex")


@query("odds_fuzzy")
def q_odds_fuzzy(spark, sf_dir):
    snap = odds_snapshot(spark, sf_dir)
    ex = O.exact_odds(parsed_fixtures(spark, sf_dir), snap)
    return O.fuzzy_positions(ex.filter(F.col("__xh").isNull()), snap).select("match_id", "pos")


ORACLE["odds_fuzzy"] = ingest_sql("SELECT match_id, pos FROM fz")


@query("odds_enrich")
def q_odds_enrich(spark, sf_dir):
    # like the stored output of the ingest job, the parsed fixtures are materialised once
    # (the enrichment reads them in its exact and fuzzy branches)
    return O.enrich_odds(parsed_fixtures(spark, sf_dir).checkpoint(), odds_snapshot(spark, sf_dir))


ORACLE["odds_enrich"] = ingest_sql(f"""
SELECT {', '.join('fx.' + c for c in FIX_COLS)},
  coalesce(ex.odds_home, fz.odds_home, CAST(2.1 AS DOUBLE)) AS odds_home,
  coalesce(ex.odds_draw, fz.odds_draw, CAST(3.2 AS DOUBLE)) AS odds_draw,
  coalesce(ex.odds_away, fz.odds_away, CAST(3.4 AS DOUBLE)) AS odds_away,
  CASE WHEN ex.match_id IS NOT NULL THEN 'exact' WHEN fz.match_id IS NOT NULL THEN 'fuzzy'
       ELSE 'default' END AS odds_source
FROM fx LEFT JOIN ex USING (match_id) LEFT JOIN fz USING (match_id)""")
