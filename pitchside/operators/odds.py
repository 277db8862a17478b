"""Odds enrichment of fixtures: exact key → first containing key (feed order) → defaults.

The fuzzy rule is "the first feed entry (in feed order) whose key contains
the lower-cased home *or* away name".  A nested-loop join would test every
(fixture, entry) pair of a day — quadratic on a busy day.  Instead:

1. collect the distinct name lengths of the day's unmatched fixtures;
2. cut every feed key of that day into its substrings of exactly those
   lengths (an equi-join on the day with the small length set);
3. reduce to ``(day, substring) → min(pos)`` with partial aggregation;
4. look both names up with an equi-join and keep the smaller position.

Every step is an equi-join or an aggregate, linear in the feed size times
the number of distinct name lengths; the result is exactly the containment
rule (a name of length 0 is contained in every key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import name_key, norm_match_key


def _prepared(fixtures: DataFrame, date_col: str) -> DataFrame:
    return fixtures.withColumns({
        "__day": F.col(date_col),
        "__key": norm_match_key(F.col("home_team"), F.col("away_team")),
        "__h": name_key(F.col("home_team")),
        "__a": name_key(F.col("away_team")),
    })


def exact_odds(fixtures: DataFrame, odds: DataFrame, date_col: str = "match_date") -> DataFrame:
    """J-03: left equi-join on (day, normalised key); unmatched rows carry NULL odds."""
    fx = _prepared(fixtures, date_col)
    m = odds.select(F.col("feed_date").alias("__day"), F.col("norm_key").alias("__key"),
                    F.col("odds_home").alias("__xh"), F.col("odds_draw").alias("__xd"),
                    F.col("odds_away").alias("__xa"))
    return fx.join(m, ["__day", "__key"], "left")


def fuzzy_positions(fixtures: DataFrame, odds: DataFrame, match_col: str = "match_id",
                    date_col: str = "__day") -> DataFrame:
    """J-04 core: ``(match_id, pos)`` of the first feed key containing either name."""
    names = fixtures.select(F.col(match_col).alias("__mid"), F.col(date_col).alias("__day"),
                            F.explode(F.array("__h", "__a")).alias("__gram"))
    lens = names.select("__day", F.length("__gram").alias("__len")).distinct()
    keys = odds.select(F.col("feed_date").alias("__day"), "pos", "norm_key")
    grams = (keys.join(lens, "__day")
             .filter(F.col("__len") <= F.length("norm_key"))
             .select("__day", "pos",
                     F.explode(F.sequence(F.lit(1), F.length("norm_key") - F.col("__len") + 1)).alias("__s"),
                     "__len", "norm_key")
             .select("__day", "pos", F.substring(F.col("norm_key"), F.col("__s"), F.col("__len")).alias("__gram")))
    index = grams.groupBy("__day", "__gram").agg(F.min("pos").alias("pos"))
    return (names.join(index, ["__day", "__gram"])
            .groupBy("__mid", "__day").agg(F.min("pos").alias("pos"))
            .withColumnRenamed("__mid", match_col))


def enrich_odds(fixtures: DataFrame, odds: DataFrame, date_col: str = "match_date",
                match_col: str = "match_id") -> DataFrame:
    """J-05: fixtures + ``odds_home/draw/away`` + ``odds_source`` (exact, fuzzy or default).

    ``odds`` is the per-day map from :func:`pitchside.sources.payloads.odds_map`
    (``feed_date, pos, norm_key, odds_*``).  ``match_col`` must be unique per day.
    Both inputs are read by more than one branch: pass stored tables (or
    checkpoints), not long lineages.
    """
    ex = exact_odds(fixtures, odds, date_col)
    unmatched = ex.filter(F.col("__xh").isNull())
    pos = fuzzy_positions(unmatched, odds, match_col)
    fz = pos.join(odds.select(F.col("feed_date").alias("__day"), "pos",
                              F.col("odds_home").alias("__fh"), F.col("odds_draw").alias("__fd"),
                              F.col("odds_away").alias("__fa")), ["__day", "pos"]) \
        .select(F.col(match_col), "__day", "__fh", "__fd", "__fa")
    out = ex.join(fz, [match_col, "__day"], "left")     # an id may stand on two days (a rescheduled fixture)
    dh, dd, da = C.DEFAULT_ODDS
    src = (F.when(F.col("__xh").isNotNull(), "exact")
           .when(F.col("__fh").isNotNull(), "fuzzy").otherwise("default"))
    return out.withColumns({
        "odds_home": F.coalesce("__xh", "__fh", F.lit(dh)),
        "odds_draw": F.coalesce("__xd", "__fd", F.lit(dd)),
        "odds_away": F.coalesce("__xa", "__fa", F.lit(da)),
        "odds_source": src,
    }).drop("__day", "__key", "__h", "__a", "__xh", "__xd", "__xa", "__fh", "__fd", "__fa")
