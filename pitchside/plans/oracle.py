"""Independent DuckDB SQL for every value-checked query key.

The driver registers the parquet tables as views; these strings only use
those views.  ``M`` (the match view) is written once here as a CTE and
prefixed to each query.
"""

from __future__ import annotations

M_CTE = """
li AS (
  SELECT l_orderkey,
    count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS hg,
    count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS ag,
    sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) % 7 + 1 ELSE 2 END) AS hs,
    sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) % 7 + 1 ELSE 2 END) AS as_,
    sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) % 5 ELSE 1 END) AS hst,
    sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) % 5 ELSE 1 END) AS ast,
    sum(CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END) AS hc,
    sum(CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END) AS ac
  FROM lineitem GROUP BY l_orderkey
),
m AS (
  SELECT o_orderkey AS match_id,
    CAST(o_orderdate AS DATE) AS match_date,
    lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' AS match_time,
    o_orderpriority AS competition,
    'T' || CAST(o_custkey % 40 AS VARCHAR) AS home_team,
    'T' || CAST((o_custkey * 7 + o_orderkey) % 40 AS VARCHAR) AS away_team,
    CASE WHEN o_orderstatus = 'O' THEN 'SCHEDULED' ELSE 'FINISHED' END AS status,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(hg AS DOUBLE) END AS home_score,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(ag AS DOUBLE) END AS away_score,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(hs AS DOUBLE) END AS h_shots,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(as_ AS DOUBLE) END AS a_shots,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(hst AS DOUBLE) END AS h_shots_ot,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(ast AS DOUBLE) END AS a_shots_ot,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(hc AS DOUBLE) END AS h_corners,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(ac AS DOUBLE) END AS a_corners,
    CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE (12 + o_custkey % 30) / 10 END AS odds_home,
    (25 + o_orderkey % 20) / 10 AS odds_draw,
    (15 + (o_custkey + o_orderkey) % 40) / 10 AS odds_away,
    CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE (28 + o_orderkey % 20) / 20 END AS odds_avg_over25,
    CASE WHEN o_orderkey % 90 = 0 THEN NULL ELSE (27 + o_orderkey % 23) / 20 END AS odds_b365_over25,
    (11 + o_custkey % 33) / 10 AS b365_home,
    (24 + o_orderkey % 21) / 10 AS b365_draw,
    CASE WHEN o_orderkey % 60 = 0 THEN 0.0 ELSE (14 + (o_custkey + 2 * o_orderkey) % 37) / 10 END AS b365_away,
    ((o_orderkey * 37) % 101) / 100 AS p_over25
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey
  WHERE o_custkey % 40 <> (o_custkey * 7 + o_orderkey) % 40
)"""


def with_m(body: str, *ctes: str) -> str:
    """``WITH li, m[, extra ctes] <body>``."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {M_CTE}{extra}\n{body}"


ORACLE: dict[str, str] = {}


def oracle(key: str):
    """Register the SQL returned by the decorated zero-arg function under ``key``."""
    def deco(fn):
        ORACLE[key] = fn()
        return fn
    return deco


# --- team form (W-*, J-01, P-09..P-14, F-02..F-04) ---------------------------

ROLL_VALUES = ["scored", "conceded", "shots", "shots_ot", "corners", "over25", "btts"]


def sides_cte(src: str = "m") -> str:
    return f"""
sides AS (
  SELECT match_id, match_date, home_team AS team, 1 AS is_home, home_score AS scored,
         away_score AS conceded, h_shots AS shots, h_shots_ot AS shots_ot, h_corners AS corners
  FROM {src}
  UNION ALL
  SELECT match_id, match_date, away_team, 0, away_score, home_score, a_shots, a_shots_ot, a_corners
  FROM {src}
),
ind AS (
  SELECT *, CASE WHEN scored + conceded > 2.5 THEN 1 ELSE 0 END AS over25,
            CASE WHEN scored > 0 AND conceded > 0 THEN 1 ELSE 0 END AS btts
  FROM sides
)"""


def _roll(v: str, w: int = 10, mp: int = 3) -> str:
    return (f"CASE WHEN team IS NOT NULL AND count({v}) OVER w >= {mp} "
            f"THEN avg({v}) OVER w END AS roll_{v}")


def rolled_cte(w: int = 10, mp: int = 3, src: str = "ind") -> str:
    cols = ",\n    ".join(_roll(v, w, mp) for v in ROLL_VALUES)
    return f"""
rolled AS (
  SELECT match_id, match_date, team, is_home,
    {cols}
  FROM {src}
  WINDOW w AS (PARTITION BY team ORDER BY match_date ASC NULLS LAST, match_id, is_home DESC
               ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)
)"""


WIDE_CTE = "wide AS (SELECT match_id,\n    " + ",\n    ".join(
    [f"max(CASE WHEN is_home = 1 THEN roll_{v} END) AS h_roll_{v}" for v in ROLL_VALUES]
    + [f"max(CASE WHEN is_home = 0 THEN roll_{v} END) AS a_roll_{v}" for v in ROLL_VALUES]
) + "\n  FROM rolled GROUP BY match_id)"


def leagues_cte(src: str = "m") -> str:
    return f"""
leagues AS (
  SELECT competition, CAST(row_number() OVER (ORDER BY competition) - 1 AS INTEGER) AS league_enc
  FROM (SELECT DISTINCT competition FROM {src} WHERE competition IS NOT NULL)
)"""


def _ip(h: str, d: str, a: str, leg: str) -> str:
    inv = lambda c: f"(1 / nullif({c}, 0))"
    return f"{inv(leg)} / ({inv(h)} + {inv(d)} + {inv(a)})"


def feats_cte(src: str = "m") -> str:
    return f"""
feats AS (
  SELECT {src}.*, wide.* EXCLUDE (match_id),
    h_roll_scored + a_roll_scored AS comb_scoring,
    h_roll_conceded + a_roll_conceded AS comb_conceded,
    h_roll_scored - a_roll_scored AS home_adv_score,
    h_roll_shots_ot + a_roll_shots_ot AS comb_shots_ot,
    h_roll_shots_ot / (a_roll_shots_ot + 0.01) AS shot_ratio,
    (h_roll_over25 + a_roll_over25) / 2 AS comb_over25,
    coalesce(leagues.league_enc, -1) AS league_enc,
    1 / nullif(odds_avg_over25, 0) AS ip_avg_over25,
    1 / nullif(odds_b365_over25, 0) AS ip_b365_over25,
    {_ip("odds_home", "odds_draw", "odds_away", "odds_home")} AS ip_avg_home,
    {_ip("odds_home", "odds_draw", "odds_away", "odds_draw")} AS ip_avg_draw,
    {_ip("b365_home", "b365_draw", "b365_away", "b365_home")} AS ip_b365_home,
    {_ip("b365_home", "b365_draw", "b365_away", "b365_draw")} AS ip_b365_draw
  FROM {src} LEFT JOIN wide USING (match_id) LEFT JOIN leagues USING (competition)
)"""


W09_COLS = (["match_id", "match_date", "competition", "home_team", "away_team", "status"]
            + [f"h_roll_{v}" for v in ROLL_VALUES] + [f"a_roll_{v}" for v in ROLL_VALUES]
            + ["comb_scoring", "comb_conceded", "home_adv_score", "comb_shots_ot", "shot_ratio",
               "comb_over25", "league_enc", "ip_avg_over25", "ip_b365_over25", "ip_avg_home",
               "ip_avg_draw", "ip_b365_home", "ip_b365_draw"])
FEATURE_COLS = [
    "h_roll_scored", "h_roll_conceded", "a_roll_scored", "a_roll_conceded",
    "comb_scoring", "comb_conceded", "h_roll_shots_ot", "a_roll_shots_ot", "comb_shots_ot",
    "h_roll_corners", "a_roll_corners", "h_roll_over25", "a_roll_over25", "comb_over25",
    "h_roll_btts", "a_roll_btts", "home_adv_score", "shot_ratio", "league_enc",
    "ip_avg_over25", "ip_b365_over25", "ip_avg_home", "ip_avg_draw",
]
TARGETS_SQL = """
    home_score + away_score AS total_goals,
    CASE WHEN home_score + away_score > 2.5 THEN 1 ELSE 0 END AS target_over25,
    CASE WHEN home_score > 0 AND away_score > 0 THEN 1 ELSE 0 END AS target_btts,
    CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS target_home_win,
    CASE WHEN home_score = away_score THEN 1 ELSE 0 END AS target_draw,
    CASE WHEN home_score < away_score THEN 1 ELSE 0 END AS target_away_win"""
TARGET_COLS = ["target_over25", "target_btts", "target_home_win", "target_draw", "target_away_win"]


def features_sql(body: str, *more: str, src: str = "m", pre: tuple[str, ...] = (),
                 window: int = 10, min_periods: int = 3) -> str:
    """M (+ ``pre`` ctes defining ``src``) → sides → rolled → wide → feats, then ``body``."""
    return with_m(body, *pre, sides_cte(src), rolled_cte(window, min_periods), WIDE_CTE,
                  leagues_cte(src), feats_cte(src), *more)
