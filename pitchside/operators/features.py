"""Team form features: sides, rolling windows, reassembly, composites, odds.

Input contract (canonical column names, renamed at the scan):
``match_id, match_date, competition, home_team, away_team, home_score,
away_score, status`` plus, when present, ``h_/a_shots``, ``h_/a_shots_ot``,
``h_/a_corners`` and the pre-match odds ``avg_over25, b365_over25,
avg_home/draw/away, b365_home/draw/away``.  Which features exist depends
on which of these columns exist (decided at plan time, like the reference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import inverse_or_null, nan_to_null
from .rolling import prior_rolling_means

SIDE_STATS = {
    "shots": ("h_shots", "a_shots"),
    "shots_ot": ("h_shots_ot", "a_shots_ot"),
    "corners": ("h_corners", "a_corners"),
}
ROLL_VALUES = ["scored", "conceded", "shots", "shots_ot", "corners", "over25", "btts"]
DEFAULT_BUCKET_DAYS = 7
NULL_DATE_ID_SPAN = 1 << 20


def available_stats(df: DataFrame) -> list[str]:
    return [s for s, (h, a) in SIDE_STATS.items() if h in df.columns and a in df.columns]


def with_targets(df: DataFrame) -> DataFrame:
    """P-04: goal total and five 0/1 targets; a missing (NULL or NaN) score gives 0 (never NULL)."""
    h, a = nan_to_null(F.col("home_score")), nan_to_null(F.col("away_score"))
    total = h + a
    return df.withColumns({
        "total_goals": total,
        "target_over25": F.when(total > 2.5, 1).otherwise(0),
        "target_btts": F.when((h > 0) & (a > 0), 1).otherwise(0),
        "target_home_win": F.when(h > a, 1).otherwise(0),
        "target_draw": F.when(h == a, 1).otherwise(0),
        "target_away_win": F.when(h < a, 1).otherwise(0),
    })


def team_sides(matches: DataFrame) -> DataFrame:
    """U-02: the home view and the away view of every match in one pass (explode)."""
    stats = available_stats(matches)

    def side(team: str, is_home: int, scored: str, conceded: str, pick: int) -> Column:
        cols = [F.col(team).alias("team"), F.lit(is_home).alias("is_home"),
                nan_to_null(F.col(scored)).alias("scored"),
                nan_to_null(F.col(conceded)).alias("conceded")]
        cols += [nan_to_null(F.col(SIDE_STATS[s][pick])).alias(s) for s in stats]
        return F.struct(*cols)

    sides = matches.select(
        "match_id", "match_date",
        F.explode(F.array(side("home_team", 1, "home_score", "away_score", 0),
                          side("away_team", 0, "away_score", "home_score", 1))).alias("s"),
    ).select("match_id", "match_date", "s.*")
    s, c = F.col("scored"), F.col("conceded")
    # NULL compares false in the reference, so an unplayed game counts as 0 here
    return sides.withColumns({
        "over25": F.when(s + c > 2.5, 1).otherwise(0),
        "btts": F.when((s > 0) & (c > 0), 1).otherwise(0),
    })


def form_order() -> list[Column]:
    """Team-series order: date (missing last), then match id, home view first."""
    return [F.col("match_date").asc_nulls_last(), F.col("match_id").asc(), F.col("is_home").desc()]


def form_bucket(bucket_days: int = DEFAULT_BUCKET_DAYS) -> Column:
    """Contiguous runs of a team's series: ``bucket_days``-day blocks, undated games by id block."""
    d = F.col("match_date")
    return F.struct(
        d.isNull().alias("undated"),
        F.when(d.isNull(), F.floor(F.col("match_id") / NULL_DATE_ID_SPAN))
        .otherwise(F.floor(F.datediff(d, F.lit("1970-01-01")) / bucket_days)).alias("b"))


def rolling_side_stats(matches: DataFrame, window: int = C.ROLLING_WINDOW,
                       min_periods: int = C.MIN_PERIODS,
                       bucket_days: int | None = DEFAULT_BUCKET_DAYS,
                       active_teams: DataFrame | None = None) -> DataFrame:
    """W-01..W-07 per team-game: ``roll_<v>`` over the team's previous ``window`` games.

    ``active_teams`` (a one-column ``team`` frame) left-semi-prunes the
    team-games before the window (J-08); the window is per team, so the
    kept teams' values are unchanged.
    """
    sides = team_sides(matches)
    if active_teams is not None:
        sides = sides.join(active_teams, "team", "left_semi")
    values = [v for v in ROLL_VALUES if v in sides.columns]
    return prior_rolling_means(
        sides, key="team", order=form_order(), values=values, window=window,
        min_periods=min_periods,
        bucket=None if bucket_days is None else form_bucket(bucket_days))


def reassemble(rolled: DataFrame) -> DataFrame:
    """J-01: one row per match with ``h_roll_*`` / ``a_roll_*`` (one shuffle on match_id)."""
    rolls = [c for c in rolled.columns if c.startswith("roll_")]
    home = F.col("is_home") == 1
    return rolled.groupBy("match_id").agg(
        *[F.max(F.when(home, F.col(c))).alias(f"h_{c}") for c in rolls],
        *[F.max(F.when(~home, F.col(c))).alias(f"a_{c}") for c in rolls],
    )


def composites(df: DataFrame) -> DataFrame:
    """P-11 / P-13: composite signals; absent inputs give NULL columns."""
    nul = F.lit(None).cast("double")
    cols = set(df.columns)
    out = {
        "comb_scoring": F.col("h_roll_scored") + F.col("a_roll_scored"),
        "comb_conceded": F.col("h_roll_conceded") + F.col("a_roll_conceded"),
        "home_adv_score": F.col("h_roll_scored") - F.col("a_roll_scored"),
    }
    if {"h_roll_shots_ot", "a_roll_shots_ot"} <= cols:
        out["comb_shots_ot"] = F.col("h_roll_shots_ot") + F.col("a_roll_shots_ot")
        out["shot_ratio"] = F.col("h_roll_shots_ot") / (F.col("a_roll_shots_ot") + 0.01)
    else:
        out["comb_shots_ot"] = nul
        out["shot_ratio"] = nul
    if not {"h_roll_corners", "a_roll_corners"} <= cols:
        out["h_roll_corners"] = nul
        out["a_roll_corners"] = nul
    out["comb_over25"] = (F.col("h_roll_over25") + F.col("a_roll_over25")) / 2
    if "h_roll_shots" not in cols:
        out["h_roll_shots"] = nul
        out["a_roll_shots"] = nul
    return df.withColumns(out)


def league_codes(df: DataFrame) -> DataFrame:
    """P-12 map: ``(competition, league_code)``, 0-based in alphabetical order, one row per competition."""
    names = df.select("competition").where(F.col("competition").isNotNull()).distinct()
    return names.withColumn("league_code", F.row_number().over(Window.orderBy("competition")) - 1)


def league_encode(df: DataFrame, leagues: DataFrame | None = None) -> DataFrame:
    """P-12 / J-06: 0-based alphabetical league code, -1 when unknown; 0 with no column.

    ``leagues`` is a :func:`league_codes` frame (persist the training one for
    serving); by default the map is recomputed from ``df`` (reference parity).
    An equi-join with one row per competition, its strategy left to the optimizer.
    """
    if "competition" not in df.columns:
        return df.withColumn("league_enc", F.lit(0))
    leagues = league_codes(df) if leagues is None else leagues
    coded = df.join(leagues.withColumnRenamed("competition", "__league"), F.col("competition") == F.col("__league"), "left")
    return coded.withColumn("league_enc", F.coalesce("league_code", F.lit(-1))).drop("__league", "league_code")


def implied_odds(df: DataFrame) -> DataFrame:
    """P-09 / P-10: market-implied probabilities (zero odds → NULL, 1X2 margin-normalised)."""
    cols = set(df.columns)
    out = {}
    if "avg_over25" in cols:
        out["ip_avg_over25"] = inverse_or_null(F.col("avg_over25"))
    if "b365_over25" in cols:
        out["ip_b365_over25"] = inverse_or_null(F.col("b365_over25"))
    for pfx in ("avg", "b365"):
        legs = [f"{pfx}_home", f"{pfx}_draw", f"{pfx}_away"]
        if all(c in cols for c in legs):
            ih, idr, ia = (inverse_or_null(F.col(c)) for c in legs)
            margin = ih + idr + ia
            out[f"ip_{pfx}_home"] = ih / margin
            out[f"ip_{pfx}_draw"] = idr / margin
    return df.withColumns(out) if out else df


def team_form_features(matches: DataFrame, window: int = C.ROLLING_WINDOW,
                       min_periods: int = C.MIN_PERIODS,
                       bucket_days: int | None = DEFAULT_BUCKET_DAYS,
                       leagues: DataFrame | None = None,
                       active_teams: DataFrame | None = None) -> DataFrame:
    """W-09: per-match rolling form of both teams + composites + league code + odds."""
    rolled = rolling_side_stats(matches, window, min_periods, bucket_days, active_teams)
    wide = matches.join(reassemble(rolled), "match_id", "left")
    if leagues is None and "competition" in matches.columns:
        leagues = league_codes(matches)
    return implied_odds(league_encode(composites(wide), leagues))


def feature_columns(df: DataFrame) -> list[str]:
    """P-14: the model feature names present in ``df``, in model order."""
    cols = set(df.columns)
    return [c for c in C.FEATURE_COLS + C.ODDS_FEATURE_COLS if c in cols]


def training_set(matches: DataFrame, **kw) -> DataFrame:
    """W-10: features → finished only → ids + features + targets → drop cold starts."""
    if "target_over25" not in matches.columns:
        matches = with_targets(matches)
    feats = team_form_features(matches, **kw).filter(F.col("status") == "FINISHED")
    fcols = feature_columns(feats)
    return feats.select(*C.TRAIN_ID_COLS, *fcols, *C.TARGET_COLS).dropna(subset=fcols[:4])


def teams_on(matches: DataFrame, run_date) -> DataFrame:
    """The distinct teams that play on ``run_date`` (one ``team`` column)."""
    today = matches.filter(F.col("match_date") == F.to_date(F.lit(run_date)))
    return today.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


def live_feature_rows(matches: DataFrame, run_date, prune: bool = True, **kw) -> DataFrame:
    """W-11 / F-04 / J-08: features of the matches on ``run_date`` (ids + features).

    With ``prune`` the team-games are left-semi-joined to the day's teams
    before the window; the league map always comes from the unpruned history.
    Games after the run date (and undated ones, which sort last) can stand in no
    frame of preceding games, so they are cut below the window and the cut reaches
    the scan; scheduled games up to the day stay, as they occupy window slots.
    """
    leagues = kw.pop("leagues", None)
    leagues = league_codes(matches) if leagues is None else leagues
    active = teams_on(matches, run_date) if prune else None
    known = matches.filter(F.col("match_date") <= F.to_date(F.lit(run_date)))
    feats = team_form_features(known, leagues=leagues, active_teams=active, **kw)
    today = feats.filter(F.col("match_date") == F.to_date(F.lit(run_date)))
    return today.select(*C.LIVE_ID_COLS, *feature_columns(today))


def fixture_list_features(matches: DataFrame, listed: DataFrame, run_date, **kw) -> DataFrame:
    """W-12: features of the listed fixtures of ``run_date`` over the history: the listed fixtures take the
    place of the store's scheduled games from that day on; earlier scheduled games stay in the windows."""
    replaced = (F.col("status") == "SCHEDULED") & (F.col("match_date") >= F.to_date(F.lit(run_date)))
    history = matches.filter(~F.coalesce(replaced, F.lit(False)))
    frame = history.unionByName(listed.withColumn("status", F.lit("SCHEDULED")), allowMissingColumns=True)
    day = team_form_features(frame, **kw).filter(F.col("match_date") == F.to_date(F.lit(run_date)))
    return day.select(*C.LIVE_ID_COLS, *feature_columns(day))
