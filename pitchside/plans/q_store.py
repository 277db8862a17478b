"""Source / sink keys: S-01, S-02, S-05..S-08, P-01..P-03, U-01, U-03, K-01, K-02."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert as U
from ..operators.season_store import SeasonStore
from ..session import run_dir
from ..sources import season_csv as SC
from ..sources import store as S
from . import views as V
from .oracle import FEATURE_COLS, ORACLE, TARGET_COLS, TARGETS_SQL, features_sql, with_m
from .q_features import TRAIN_ID
from .registry import query


def _slug(sf_dir: str) -> str:
    return sf_dir.rstrip("/").split("/")[-1].replace(".", "_")


def season_frame(spark, sf_dir):
    root = run_dir(spark, "season_csv", _slug(sf_dir))
    V.write_season_csvs(V.match_view(spark, sf_dir), root)
    return SC.read_season_csv(spark, root)


SEASON_COLS = ["season", "competition", "date_text", "home_team", "away_team", "home_score",
               "away_score", "h_shots", "a_shots", "h_shots_ot", "a_shots_ot", "h_corners",
               "a_corners", "avg_over25", "b365_over25", "avg_home", "avg_draw", "avg_away",
               "b365_home", "b365_draw", "b365_away", "match_date", "status", "match_id",
               "total_goals", "target_over25", "target_btts", "target_home_win", "target_draw",
               "target_away_win"]


def _itext(c, full=False):
    e = f"CAST(CAST({c} AS INTEGER) AS VARCHAR)"
    return f"CASE WHEN full_layout THEN {e} END" if full else e


def _otext(c, full=False):
    cond = f"{c} IS NOT NULL" + (" AND full_layout" if full else "")
    return f"CASE WHEN {cond} THEN printf('%.2f', {c}) END"


SEASON_TEXT = [  # (canonical, text expression) in the reader's fixed column order
    ("competition", "competition"),
    ("date_text", "CASE WHEN match_id % 97 = 0 THEN 'not a date' WHEN match_id % 7 = 0 "
                  "THEN strftime(match_date, '%d/%m/%y') ELSE strftime(match_date, '%d/%m/%Y') END"),
    ("home_team", "home_team"), ("away_team", "away_team"),
    ("home_score", _itext("home_score")), ("away_score", _itext("away_score")),
    ("h_shots", _itext("h_shots", True)), ("a_shots", _itext("a_shots", True)),
    ("h_shots_ot", _itext("h_shots_ot", True)), ("a_shots_ot", _itext("a_shots_ot", True)),
    ("h_corners", _itext("h_corners", True)), ("a_corners", _itext("a_corners", True)),
    ("avg_over25", _otext("odds_avg_over25")), ("b365_over25", _otext("odds_b365_over25", True)),
    ("avg_home", _otext("odds_home")), ("avg_draw", _otext("odds_draw")), ("avg_away", _otext("odds_away")),
    ("b365_home", _otext("b365_home", True)), ("b365_draw", _otext("b365_draw", True)),
    ("b365_away", _otext("b365_away", True)),
]
SEASON_CTES = ("""
sc AS (
  SELECT * FROM (
    SELECT *, CAST(year(match_date) AS VARCHAR) AS season,
      competition IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS full_layout,
      row_number() OVER (ORDER BY CAST(year(match_date) AS VARCHAR), competition, match_date, match_id) AS line
    FROM m WHERE home_score IS NOT NULL AND away_score IS NOT NULL)
)""", """
st AS (
  SELECT match_id AS src_id, match_date AS src_date, line, season, """ + ",\n    ".join(
    f"{e} AS t_{k}" for k, e in SEASON_TEXT) + """
  FROM sc
)""", """
sb AS (
  SELECT *, concat_ws('|', season, """ + ", ".join(f"coalesce(t_{k}, '')" for k, _ in SEASON_TEXT) + """) AS base
  FROM st
)""", """
sv AS (
  SELECT season, t_competition AS competition, t_date_text AS date_text, t_home_team AS home_team,
    t_away_team AS away_team, """ + ",\n    ".join(
    f"CAST(t_{k} AS DOUBLE) AS {k}" for k, _ in SEASON_TEXT[4:]) + """,
    CASE WHEN src_id % 97 = 0 THEN NULL ELSE src_date END AS match_date,
    'FINISHED' AS status,
    -line AS match_id
  FROM sb
)""")


def season_sql(body: str) -> str:
    return with_m(body, *SEASON_CTES)


@query("season_csv_scan")
def q_season_csv_scan(spark, sf_dir):
    return season_frame(spark, sf_dir).select(*SEASON_COLS)


ORACLE["season_csv_scan"] = season_sql(
    f"SELECT {', '.join(SEASON_COLS[:-6])}, {TARGETS_SQL} FROM sv")


@query("normalise_columns")
def q_normalise_columns(spark, sf_dir):
    return season_frame(spark, sf_dir).select(
        "match_id", "competition", "home_team", "away_team", "home_score", "away_score")


ORACLE["normalise_columns"] = season_sql(
    "SELECT match_id, competition, home_team, away_team, home_score, away_score FROM sv")


@query("parse_match_date")
def q_parse_match_date(spark, sf_dir):
    return season_frame(spark, sf_dir).select("match_id", "date_text", "match_date")


ORACLE["parse_match_date"] = season_sql("SELECT match_id, date_text, match_date FROM sv")


@query("surrogate_match_id")
def q_surrogate_match_id(spark, sf_dir):
    return season_frame(spark, sf_dir).select("match_id", "season", "competition", "home_team", "away_team")


ORACLE["surrogate_match_id"] = season_sql(
    "SELECT match_id, season, competition, home_team, away_team FROM sv")


@query("union_seasons")
def q_union_seasons(spark, sf_dir):
    return season_frame(spark, sf_dir).groupBy("season", "competition").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("h_shots").alias("n_with_shots"),
        F.count("b365_home").alias("n_with_b365"))


ORACLE["union_seasons"] = season_sql("""
SELECT season, competition, count(*) AS n_rows, count(h_shots) AS n_with_shots,
  count(b365_home) AS n_with_b365
FROM sv GROUP BY season, competition""")


@query("season_plain_layout")
def q_season_plain_layout(spark, sf_dir):
    """S-01 on the plain ``<season>/<file>.csv`` layout: the season is the folder's name."""
    root = run_dir(spark, "season_plain", _slug(sf_dir))
    V.write_plain_season_csvs(V.match_view(spark, sf_dir), root)
    return SC.read_season_csv(spark, root).select("match_id", "season", "competition", "home_team", "avg_over25", "b365_home")


ORACLE["season_plain_layout"] = with_m("""
SELECT -row_number() OVER (ORDER BY year(match_date), competition, match_date, match_id) AS match_id,
  CAST(year(match_date) AS VARCHAR) AS season, competition, home_team,
  CASE WHEN odds_avg_over25 IS NOT NULL THEN CAST(printf('%.2f', odds_avg_over25) AS DOUBLE) END AS avg_over25,
  CASE WHEN b365_home IS NOT NULL THEN CAST(printf('%.2f', b365_home) AS DOUBLE) END AS b365_home
FROM m WHERE home_score IS NOT NULL AND away_score IS NOT NULL""")


PLANTED_LEAGUE = "6-PLANTED"
BROKEN_FILE = b"\x1f\x8b\x08\x00 no gzip stream"


def plant_bad_files(spark, root: str, seasons: list[str], league: str) -> None:
    """In every season a damaged and an empty file beside the good ones, and a file without score columns."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for season in seasons:
        folder = f"{root}/season={season}/league={league}"
        for name, content in (("broken.csv.gz", BROKEN_FILE), ("empty.csv", b""), ("other.csv", b"Date,HomeTeam\n01/01/2020,A\n")):
            out = fs.create(hadoop.Path(f"{folder}/{name}"))
            out.write(bytearray(content))
            out.close()


@query("season_file_audit")
def q_season_file_audit(spark, sf_dir):
    """S-01: what of the season tree is not read: a league expected in every season that has no file, and the damaged,
    empty and scoreless files planted in every season of the matches."""
    m = V.match_view(spark, sf_dir)
    root = run_dir(spark, "season_audit", _slug(sf_dir))
    V.write_season_csvs(m, root)
    pairs = m.select(F.year("match_date").cast("string").alias("season"), F.col("competition").alias("league")).distinct()
    seasons = [r.season for r in pairs.select("season").distinct().orderBy("season").collect()]       # one row per season
    plant_bad_files(spark, root, seasons, pairs.agg(F.min("league")).first()[0])
    path = F.format_string("season=%s/league=%s", "season", "league")
    planted = pairs.select("season").distinct().select(F.format_string(f"season=%s/league={PLANTED_LEAGUE}", "season").alias("path"))
    return SC.season_audit(spark, root, pairs.select(path.alias("path")).unionByName(planted)).select("path", "reason", "bytes")


ORACLE["season_file_audit"] = with_m(f"""
SELECT 'season=' || season || '/league=' || p.folder AS path, p.reason, p.bytes
FROM (SELECT DISTINCT CAST(year(match_date) AS VARCHAR) AS season FROM m),
  (SELECT min(competition) || '/broken.csv.gz' AS folder, 'unreadable' AS reason, {len(BROKEN_FILE)}::BIGINT AS bytes FROM m
   UNION ALL SELECT min(competition) || '/empty.csv', 'empty', 0 FROM m
   UNION ALL SELECT min(competition) || '/other.csv', 'no scores', 27 FROM m
   UNION ALL SELECT '{PLANTED_LEAGUE}', 'missing', NULL) p""")


# W-10 on the season files: the file columns under the names of the match view
CSV_MATCHES = """
csvm AS (
  SELECT match_id, match_date, competition, home_team, away_team, home_score, away_score, status,
    h_shots, a_shots, h_shots_ot, a_shots_ot, h_corners, a_corners,
    avg_over25 AS odds_avg_over25, b365_over25 AS odds_b365_over25,
    avg_home AS odds_home, avg_draw AS odds_draw, avg_away AS odds_away, b365_home, b365_draw, b365_away
  FROM sv
)"""
ORACLE["training_from_csv"] = features_sql(
    f"SELECT {', '.join(TRAIN_ID + FEATURE_COLS + TARGET_COLS)} FROM (SELECT *, {TARGETS_SQL} FROM feats) "
    "WHERE status = 'FINISHED' AND h_roll_scored IS NOT NULL AND h_roll_conceded IS NOT NULL "
    "AND a_roll_scored IS NOT NULL AND a_roll_conceded IS NOT NULL",
    src="csvm", pre=(*SEASON_CTES, CSV_MATCHES))


# --- S-02, S-05..S-08 ---------------------------------------------------------------

def store_df(spark, sf_dir):
    return V.store_view(V.match_view(spark, sf_dir))


STORE_SQL_COLS = ("match_id, match_date, match_time, competition, home_team, away_team, "
                  "CAST(home_score AS INTEGER) AS home_score, CAST(away_score AS INTEGER) AS away_score, "
                  "status, odds_home, odds_draw, odds_away")


@query("match_store_scan")
def q_match_store_scan(spark, sf_dir):
    return S.read_match_store(spark, store_df(spark, sf_dir))


ORACLE["match_store_scan"] = with_m(
    "SELECT match_id, match_date, competition, home_team, away_team, "
    "CAST(CAST(home_score AS INTEGER) AS DOUBLE) AS home_score, "
    "CAST(CAST(away_score AS INTEGER) AS DOUBLE) AS away_score, status FROM m")


@query("fixture_list_scan")
def q_fixture_list_scan(spark, sf_dir):
    path = run_dir(spark, "fixture_list_all", _slug(sf_dir))
    m = V.match_view(spark, sf_dir).filter(F.col("status") == "SCHEDULED")
    S.write_fixture_list(m, path)
    return S.read_fixture_list(spark, path)


ORACLE["fixture_list_scan"] = with_m(
    "SELECT match_date, competition, home_team, away_team, match_id FROM m WHERE status = 'SCHEDULED'")


@query("fixture_date_pick")
def q_fixture_date_pick(spark, sf_dir):
    """F-10 / T-08 input: the listed fixtures of the first listed date."""
    path = run_dir(spark, "fixture_list_all", _slug(sf_dir))
    m = V.match_view(spark, sf_dir).filter(F.col("status") == "SCHEDULED")
    S.write_fixture_list(m, path)
    listed = S.read_fixture_list(spark, path)
    first = listed.agg(F.min("match_date").alias("picked"))
    return listed.join(first, listed.match_date == first.picked, "left_semi")


ORACLE["fixture_date_pick"] = with_m("""
SELECT match_date, competition, home_team, away_team, match_id FROM m
WHERE status = 'SCHEDULED' AND match_date = (
  SELECT min(match_date) FROM m WHERE status = 'SCHEDULED')""")


@query("match_meta_scan")
def q_match_meta_scan(spark, sf_dir):
    return S.match_meta(spark, store_df(spark, sf_dir))


ORACLE["match_meta_scan"] = with_m("SELECT match_id, match_time, odds_home, odds_draw, odds_away FROM m")


@query("finished_scores_scan")
def q_finished_scores_scan(spark, sf_dir):
    return S.finished_scores(spark, store_df(spark, sf_dir))


ORACLE["finished_scores_scan"] = with_m(
    "SELECT CAST(home_score AS INTEGER) AS home_score, CAST(away_score AS INTEGER) AS away_score "
    "FROM m WHERE status = 'FINISHED'")


@query("store_profile")
def q_store_profile(spark, sf_dir):
    return S.store_profile(spark, store_df(spark, sf_dir))


ORACLE["store_profile"] = with_m("""
SELECT (SELECT count(*) FROM m) AS total_rows,
  (SELECT string_agg(competition, ',' ORDER BY competition) FROM (
     SELECT DISTINCT competition FROM m WHERE competition IS NOT NULL ORDER BY competition LIMIT 10))
     AS competitions,
  (SELECT string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY match_id) FROM (
     SELECT match_id FROM m ORDER BY match_id LIMIT 5)) AS first_ids,
  'match_id,match_date,match_time,competition,home_team,away_team,home_score,away_score,status,odds_home,odds_draw,odds_away'
    AS columns""")


@query("sample_rows")
def q_sample_rows(spark, sf_dir):
    """T-07: the first five store rows (by match_id)."""
    return store_df(spark, sf_dir).orderBy("match_id").limit(5)


ORACLE["sample_rows"] = with_m(f"SELECT {STORE_SQL_COLS} FROM m ORDER BY match_id LIMIT 5")


@query("distinct_competitions")
def q_distinct_competitions(spark, sf_dir):
    return store_df(spark, sf_dir).select("competition").where(F.col("competition").isNotNull()).distinct()


ORACLE["distinct_competitions"] = with_m(
    "SELECT DISTINCT competition FROM m WHERE competition IS NOT NULL")


# --- K-01, K-02, U-03 ---------------------------------------------------------------------

STORE_CUT, BATCH_FROM, RESENT_TO = "1999-01-01", "1998-12-01", "1999-01-01"


def store_batches(spark, sf_dir):
    """The store as of ``STORE_CUT`` and one re-fetch batch from ``BATCH_FROM`` on (overlapping
    days are updates, later days inserts) with final scores; the overlap days were sent twice
    in the batch (the later ordinal wins)."""
    store = store_df(spark, sf_dir)
    d = F.col("match_date")
    v1 = store.filter(d < F.to_date(F.lit(STORE_CUT)))
    fetched = store.filter(d >= F.to_date(F.lit(BATCH_FROM)))
    changed = fetched.withColumns({
        "home_score": F.coalesce("home_score", F.lit(0)) + 1, "status": F.lit("FINISHED")})
    again = fetched.filter(d < F.to_date(F.lit(RESENT_TO))).withColumns({
        "home_score": F.coalesce("home_score", F.lit(0)) + 1,
        "away_score": F.coalesce("away_score", F.lit(0)) + 1, "status": F.lit("FINISHED")})
    batch = U.stamp(changed, 1).unionByName(U.stamp(again.withColumn("o", F.lit(1)), 1, "o").drop("o"))
    return v1, batch


BATCH_CTES = (f"""
v1 AS (SELECT {STORE_SQL_COLS} FROM m WHERE match_date < DATE '{STORE_CUT}')""", f"""
sb0 AS (SELECT {STORE_SQL_COLS} FROM m WHERE match_date >= DATE '{BATCH_FROM}')""", f"""
batch AS (
  SELECT * REPLACE (coalesce(home_score, 0) + 1 AS home_score, 'FINISHED' AS status),
    CAST(1 AS BIGINT) AS batch_seq, CAST(0 AS BIGINT) AS batch_ord
  FROM sb0
  UNION ALL
  SELECT * REPLACE (coalesce(home_score, 0) + 1 AS home_score, coalesce(away_score, 0) + 1 AS away_score,
                    'FINISHED' AS status),
    CAST(1 AS BIGINT), CAST(1 AS BIGINT)
  FROM sb0 WHERE match_date < DATE '{RESENT_TO}'
)""", """
hist AS (
  SELECT *, CAST(-1 AS BIGINT) AS batch_seq, CAST(0 AS BIGINT) AS batch_ord FROM v1
  UNION ALL BY NAME SELECT * FROM batch
)""")


@query("union_history_and_upsert")
def q_union_history_and_upsert(spark, sf_dir):
    v1, batch = store_batches(spark, sf_dir)
    return U.union_history(v1, batch)


ORACLE["union_history_and_upsert"] = with_m("SELECT * FROM hist", *BATCH_CTES)


@query("match_upsert")
def q_match_upsert(spark, sf_dir):
    """K-01 on the season store: the old rows as batch 0, the re-fetched ones as batch 1, which is then replayed."""
    store = SeasonStore(spark, run_dir(spark, "store", _slug(sf_dir)))
    v1, batch = store_batches(spark, sf_dir)
    store.init()
    store.upsert(U.stamp(v1, 0), 0)
    version = store.upsert(batch, 1)
    assert store.upsert(batch, 1) == version       # a replayed batch is skipped
    return store.read(version)


ORACLE["match_upsert"] = with_m("""
SELECT * EXCLUDE (batch_seq, batch_ord, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY batch_seq DESC, batch_ord DESC) AS rn
  FROM hist) WHERE rn = 1""", *BATCH_CTES)


@query("match_store_init")
def q_match_store_init(spark, sf_dir):
    base = run_dir(spark, "store_init", _slug(sf_dir))
    U.init_store(spark, f"{base}/v=000000")
    empty = U.read_version(spark, base, 0)
    U.write_version(U.upsert_matches(empty, U.stamp(store_df(spark, sf_dir), 1)), base, 1)
    return U.read_version(spark, base, 1)


ORACLE["match_store_init"] = with_m(f"SELECT {STORE_SQL_COLS} FROM m")
