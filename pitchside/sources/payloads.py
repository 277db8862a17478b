"""Landed API payloads → rows (S-03 fixtures, S-04 odds) with built-in JSON functions.

Payload documents are DataFrames of raw JSON text (one row per landed
response page), so parsing is a per-row ``from_json`` + ``explode`` — no
document ever passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.columns import norm_match_key

_NAME = T.StructType([T.StructField("name", T.StringType())])

FIXTURES_SCHEMA = T.StructType([
    # arrives as [] or as an object: kept as raw JSON text
    T.StructField("errors", T.StringType()),
    T.StructField("response", T.ArrayType(T.StructType([
        T.StructField("fixture", T.StructType([
            T.StructField("id", T.LongType()),
            T.StructField("date", T.StringType()),
            T.StructField("status", T.StructType([T.StructField("short", T.StringType())])),
        ])),
        T.StructField("league", _NAME),
        T.StructField("teams", T.StructType([T.StructField("home", _NAME), T.StructField("away", _NAME)])),
        T.StructField("goals", T.StructType([T.StructField("home", T.IntegerType()),
                                             T.StructField("away", T.IntegerType())])),
    ]))),
])

OUTCOME = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
MARKET = T.StructType([T.StructField("key", T.StringType()),
                       T.StructField("outcomes", T.ArrayType(OUTCOME))])
BOOKMAKER = T.StructType([T.StructField("key", T.StringType()),
                          T.StructField("markets", T.ArrayType(MARKET))])
ODDS_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("home_team", T.StringType()),
    T.StructField("away_team", T.StringType()),
    T.StructField("bookmakers", T.ArrayType(BOOKMAKER)),
]))

POS_PAGE_STRIDE = 1 << 32       # feed position = page * stride + index within the page (an int: pages never overlap)


def errors_empty(c: Column) -> Column:
    """The API's ``errors`` is falsy: absent, null, ``[]``, ``{}`` or empty text."""
    t = F.trim(c)
    return c.isNull() | t.isin("", "[]", "{}", "null")


def malformed_documents(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row: landed documents, and those that are no JSON object (they give no rows anywhere)."""
    parsed = F.from_json(F.col(body), FIXTURES_SCHEMA)
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(
        parsed.isNull() | (parsed["errors"].isNull() & parsed["response"].isNull()), 1)).alias("malformed"))


def fixture_items(docs: DataFrame, body: str = "body", request_date: str = "request_date",
                  keep=()) -> DataFrame:
    """One row per fixture item of every response without errors (an empty response gives none).

    The error test stands inside the generator: as a filter it would be pushed below the parser and parse (and, above
    computed bodies, write) every document a second time.
    """
    parsed = docs.select(F.col(request_date).alias("request_date"), *keep,
                         F.from_json(F.col(body), FIXTURES_SCHEMA).alias("p"))
    return parsed.select("request_date", *keep, F.posexplode(
        F.when(errors_empty(F.col("p.errors")), F.col("p.response"))).alias("item", "it"))


def status_of(short: Column) -> Column:
    """P-06: FT/AET/PEN → FINISHED, anything else (missing = NS) → SCHEDULED."""
    return F.when(short.isin(*C.FINISHED_SHORT_CODES), "FINISHED").otherwise("SCHEDULED")


def parse_fixtures(docs: DataFrame, body: str = "body", request_date: str = "request_date",
                   keep=(), item: str | None = None) -> DataFrame:
    """S-03 / P-06 / P-07: fixture payloads → store rows (without odds); ``item`` names a column
    with the position in the response.

    JSON null and an absent key are both treated as missing (documented deviation).
    """
    it = F.col("it")
    fdate = F.coalesce(it["fixture"]["date"], F.lit(""))
    short = F.coalesce(it["fixture"]["status"]["short"], F.lit("NS"))
    return fixture_items(docs, body, request_date, keep).select(
        it["fixture"]["id"].alias("match_id"),
        F.try_to_date(F.when(F.length(fdate) > 0, F.substring(fdate, 1, 10))
                      .otherwise(F.col("request_date"))).alias("match_date"),
        F.when(F.length(fdate) >= 16, F.substring(fdate, 12, 5))
        .otherwise(F.lit(C.DEFAULT_KICKOFF)).alias("match_time"),
        F.coalesce(it["league"]["name"], F.lit(C.UNKNOWN_LEAGUE)).alias("competition"),
        it["teams"]["home"]["name"].alias("home_team"),
        it["teams"]["away"]["name"].alias("away_team"),
        it["goals"]["home"].alias("home_score"),
        it["goals"]["away"].alias("away_score"),
        short.alias("status_short"),
        status_of(short).alias("status"),
        *keep, *([F.col("item").alias(item)] if item else []),
    )


def odds_entries(docs: DataFrame, body: str = "body", feed_date: str = "feed_date",
                 page: str = "page") -> DataFrame:
    """Every feed entry with its position in feed order (``page * stride + index``)."""
    return docs.select(
        F.col(feed_date).alias("feed_date"), F.col(page).alias("page"),
        F.posexplode(F.from_json(F.col(body), ODDS_SCHEMA)).alias("idx", "e"),
    ).select("feed_date", (F.col("page").cast("long") * POS_PAGE_STRIDE + F.col("idx")).alias("pos"), "e")


def _whitelisted(e: Column) -> Column:
    return F.filter(F.coalesce(e["bookmakers"], F.array()),
                    lambda b: b["key"].isin(*C.BOOKMAKER_WHITELIST))


def _last_price(outs: Column, pred) -> Column:
    return F.try_element_at(F.filter(outs, pred), F.lit(-1))["price"]


def odds_per_match(entries: DataFrame) -> DataFrame:
    """A-01: per entry, the first whitelisted bookmaker only; its h2h outcomes; last price per name.

    Name tests follow the reference's if/elif chain (home, then away, then
    "Draw"); legs never seen keep the default prices.  ``<=>`` mirrors
    Python's ``None == None``.
    """
    e = F.col("e")
    first = F.try_element_at(_whitelisted(e), F.lit(1))
    h2h = F.filter(F.coalesce(first["markets"], F.array()), lambda mk: mk["key"] == C.H2H_MARKET)
    outs = F.flatten(F.transform(h2h, lambda mk: F.coalesce(mk["outcomes"], F.array())))
    home, away = F.col("home_team"), F.col("away_team")
    dh, dd, da = C.DEFAULT_ODDS
    is_home = lambda o: o["name"].eqNullSafe(home)
    is_away = lambda o: ~o["name"].eqNullSafe(home) & o["name"].eqNullSafe(away)
    is_draw = lambda o: (~o["name"].eqNullSafe(home) & ~o["name"].eqNullSafe(away)
                         & o["name"].eqNullSafe(F.lit(C.DRAW_OUTCOME)))
    # the outcomes are cut out of the entry once, not once per price
    found = entries.select("feed_date", "pos", e["home_team"].alias("home_team"), e["away_team"].alias("away_team"), outs.alias("outs"))
    return found.select(
        "feed_date", "pos", "home_team", "away_team",
        F.coalesce(_last_price(F.col("outs"), is_home), F.lit(dh)).alias("odds_home"),
        F.coalesce(_last_price(F.col("outs"), is_draw), F.lit(dd)).alias("odds_draw"),
        F.coalesce(_last_price(F.col("outs"), is_away), F.lit(da)).alias("odds_away"),
    )


def odds_map(per_match: DataFrame, count: str | None = None) -> DataFrame:
    """A-02 / P-08: the feed as a per-day dict — a repeated key keeps its first position
    and takes its last value (partial aggregation, so a hot key is combined map-side).
    ``count`` names a column with the number of entries behind each key."""
    keyed = per_match.withColumn("norm_key", norm_match_key(F.col("home_team"), F.col("away_team")))
    return keyed.groupBy("feed_date", "norm_key").agg(
        F.min("pos").alias("pos"),
        *[F.max_by(c, F.col("pos")).alias(c) for c in ("odds_home", "odds_draw", "odds_away")],
        *([F.count(F.lit(1)).alias(count)] if count else []),
    ).select("feed_date", "pos", "norm_key", "odds_home", "odds_draw", "odds_away", *([count] if count else []))


def parse_odds(docs: DataFrame, **kw) -> DataFrame:
    """S-04: odds payloads → the deduplicated per-day odds map."""
    return odds_map(odds_per_match(odds_entries(docs, **kw)))


def whitelisted_bookmakers(entries: DataFrame) -> DataFrame:
    """F-07: one row per (entry, bookmaker) whose key is whitelisted, with its feed position."""
    return (entries.select("feed_date", "pos", F.posexplode(F.coalesce(F.col("e.bookmakers"), F.array()))
                           .alias("book_pos", "b"))
            .filter(F.col("b.key").isin(*C.BOOKMAKER_WHITELIST))
            .select("feed_date", "pos", "book_pos", F.col("b.key").alias("bookmaker"), "b"))


def h2h_markets(entries: DataFrame) -> DataFrame:
    """F-08: the h2h markets of whitelisted bookmakers."""
    return (whitelisted_bookmakers(entries)
            .select("feed_date", "pos", "book_pos", "bookmaker",
                    F.posexplode(F.coalesce(F.col("b.markets"), F.array())).alias("market_pos", "mk"))
            .filter(F.col("mk.key") == C.H2H_MARKET)
            .select("feed_date", "pos", "book_pos", "bookmaker", "market_pos",
                    F.size(F.coalesce(F.col("mk.outcomes"), F.array())).alias("n_outcomes")))
