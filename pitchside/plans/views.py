"""Test views derived from the driver's tables (see FIXTURES.md §2).

Everything here is a lazy DataFrame over ``orders``, ``lineitem`` and
``labels``, so the work of every query built on it grows with the tables.
Each view has an independent DuckDB twin in :mod:`pitchside.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import run_dir
from ..sources.tables import read_table

N_TEAMS = 40
PAGE_SPAN = 2000            # match ids per landed payload page (bounds a document's size)
SAME_SPELLING = ["1-URGENT", "2-HIGH"]   # competitions whose teams the odds provider spells as the fixtures do
OTHER_SPELLING = "5-LOW"                 # ... in a way that no longer holds the name; elsewhere with a suffix
ERROR_DAY = 13              # fixture payloads of this day-of-month carry an API error
EMPTY_DAY = 29              # ... and of this day an empty response
BOOKMAKER_KEYS = ["sportybet", "onexbet", "bet365", "betway", "other1", "other2"]

STORE_COLS = [
    "match_id", "match_date", "match_time", "competition", "home_team", "away_team",
    "home_score", "away_score", "status", "odds_home", "odds_draw", "odds_away",
]


def _team(n: Column) -> Column:
    return F.concat(F.lit("T"), n.cast("string"))


def match_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``M``: one match per order whose two derived teams differ."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")

    q = F.col("l_quantity").cast("bigint")
    flag = F.col("l_returnflag")
    per_order = lines.groupBy("l_orderkey").agg(
        F.count(F.when(flag == "R", 1)).alias("_hg"),
        F.count(F.when(flag == "A", 1)).alias("_ag"),
        F.sum(F.when(flag == "R", q % 7 + 1).otherwise(2)).alias("_hs"),
        F.sum(F.when(flag == "A", q % 7 + 1).otherwise(2)).alias("_as"),
        F.sum(F.when(flag == "R", q % 5).otherwise(1)).alias("_hst"),
        F.sum(F.when(flag == "A", q % 5).otherwise(1)).alias("_ast"),
        F.sum(F.when(F.col("l_linestatus") == "F", 2).otherwise(1)).alias("_hc"),
        F.sum(F.when(F.col("l_linestatus") == "O", 2).otherwise(1)).alias("_ac"),
    )

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    home_n, away_n = cust % N_TEAMS, (cust * 7 + key) % N_TEAMS
    scheduled = F.col("o_orderstatus") == "O"

    def played(c: str) -> Column:
        return F.when(scheduled, F.lit(None)).otherwise(F.col(c).cast("double"))

    joined = orders.filter(home_n != away_n).join(
        per_order, orders.o_orderkey == per_order.l_orderkey, "left")
    return joined.select(
        key.alias("match_id"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":00")).alias("match_time"),
        F.col("o_orderpriority").alias("competition"),
        _team(home_n).alias("home_team"),
        _team(away_n).alias("away_team"),
        F.when(scheduled, "SCHEDULED").otherwise("FINISHED").alias("status"),
        played("_hg").alias("home_score"), played("_ag").alias("away_score"),
        played("_hs").alias("h_shots"), played("_as").alias("a_shots"),
        played("_hst").alias("h_shots_ot"), played("_ast").alias("a_shots_ot"),
        played("_hc").alias("h_corners"), played("_ac").alias("a_corners"),
        F.when(key % 50 == 0, F.lit(0.0)).otherwise((12 + cust % 30) / 10).alias("odds_home"),
        ((25 + key % 20) / 10).alias("odds_draw"),
        ((15 + (cust + key) % 40) / 10).alias("odds_away"),
        F.when(key % 70 == 0, F.lit(None)).otherwise((28 + key % 20) / 20).alias("odds_avg_over25"),
        F.when(key % 90 == 0, F.lit(None)).otherwise((27 + key % 23) / 20).alias("odds_b365_over25"),
        ((11 + cust % 33) / 10).alias("b365_home"),
        ((24 + key % 21) / 10).alias("b365_draw"),
        F.when(key % 60 == 0, F.lit(0.0)).otherwise((14 + (cust + 2 * key) % 37) / 10).alias("b365_away"),
        (((key * 37) % 101) / 100).alias("p_over25"),
    )


def run_date(m: DataFrame) -> str:
    """The "today" of the live paths: the busiest day (the earliest of several), so it has matches at every scale."""
    day = m.groupBy("match_date").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "match_date").first()
    return str(day.match_date)


def store_view(m: DataFrame) -> DataFrame:
    """The keyed match store (reference table layout) as rows of ``M``."""
    return m.select(
        *[F.col(c).cast("int").alias(c) if c in ("home_score", "away_score") else F.col(c)
          for c in STORE_COLS])


def slate_view(m: DataFrame) -> DataFrame:
    """``SLATE``: prediction-shaped rows for every scheduled match (proxy probabilities)."""
    mid = F.col("match_id")
    w = [((mid * k) % 50 + 1).cast("double") for k in (11, 13, 17)]
    total = w[0] + w[1] + w[2]
    return m.filter(F.col("status") == "SCHEDULED").select(
        "match_id", "match_date", "competition", "home_team", "away_team", "match_time",
        "odds_home", "odds_draw", "odds_away",
        F.col("p_over25").alias("over_2_5_probability"),
        (((mid * 53) % 101) / 100).alias("btts_probability"),
        (w[0] / total).alias("prob_home_win"),
        (w[1] / total).alias("prob_draw"),
        (w[2] / total).alias("prob_away_win"),
    )


def preds_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``PREDS``: labelled documents with two proxy model probabilities."""
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("y"),
        (((d * 37) % 101) / 100).alias("p"),
        (((d * 53) % 101) / 100).alias("p2"),
    )


def _page(mid: Column) -> Column:
    return F.floor(mid / PAGE_SPAN).cast("int")


def fixture_payloads(m: DataFrame) -> DataFrame:
    """``PAYLOAD``: one fixtures-API response per (request date, page) as raw JSON text."""
    mid = F.col("match_id")
    dom = F.dayofmonth("match_date")
    short = (F.when(F.col("status") == "SCHEDULED", F.lit("NS"))
             .otherwise(F.element_at(F.array(F.lit("FT"), F.lit("AET"), F.lit("PEN")),
                                     (mid % 3 + 1).cast("int"))))
    status = F.when((F.col("status") == "SCHEDULED") & (mid % 11 == 0), F.lit(None)) \
        .otherwise(F.struct(short.alias("short")))
    fixture_date = F.when(mid % 13 == 0, F.lit(None)).otherwise(
        F.concat(F.date_format("match_date", "yyyy-MM-dd"), F.lit("T"),
                 F.col("match_time"), F.lit(":00+00:00")))
    item = F.struct(
        F.struct(mid.alias("id"), fixture_date.alias("date"), status.alias("status")).alias("fixture"),
        F.struct(F.when(mid % 17 == 0, F.lit(None)).otherwise(F.col("competition"))
                 .alias("name")).alias("league"),
        F.struct(F.struct(F.col("home_team").alias("name")).alias("home"),
                 F.struct(F.col("away_team").alias("name")).alias("away")).alias("teams"),
        F.struct(F.col("home_score").cast("int").alias("home"),
                 F.col("away_score").cast("int").alias("away")).alias("goals"),
    )
    pages = (m.select("match_date", _page(mid).alias("page"), mid, item.alias("item"))
             .groupBy("match_date", "page")
             .agg(F.sort_array(F.collect_list(F.struct("match_id", "item"))).alias("items")))
    errors = F.when(F.dayofmonth("match_date") == ERROR_DAY,
                    F.lit('{"requests":"You have reached the request limit for the day"}')) \
        .otherwise(F.lit("[]"))
    response = F.when(F.dayofmonth("match_date") == EMPTY_DAY, F.lit("[]")) \
        .otherwise(F.to_json(F.transform("items", lambda x: x["item"])))
    return pages.select(
        F.date_format("match_date", "yyyy-MM-dd").alias("request_date"), "page",
        F.concat(F.lit('{"get":"fixtures","errors":'), errors,
                 F.lit(',"response":'), response, F.lit("}")).alias("body"))


def odds_payloads(spark: SparkSession, sf_dir: str, m: DataFrame) -> DataFrame:
    """``FEED``: one odds-API response per (date, page) for all matches, spelled by competition."""
    def spelled(team: str) -> Column:
        t = F.col(team)
        return (F.when(F.col("competition").isin(*SAME_SPELLING), t)
                .when(F.col("competition") == OTHER_SPELLING, F.concat(F.lit("Club "), F.substring(t, 2, 9)))
                .otherwise(F.concat(t, F.lit(" FC"))))

    feed = m.select("match_id", "match_date", spelled("home_team").alias("home_team"), spelled("away_team").alias("away_team"))
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate")
    pk = F.col("l_partkey")

    def outcome(name: Column, i: int) -> Column:
        return F.struct(name.alias("name"), ((11 + pk % 40 + i) / 10).alias("price"))

    teams = feed.select("match_id", "home_team", "away_team")
    lines = li.join(teams, li.l_orderkey == teams.match_id)
    outcomes = F.array_compact(F.array(
        F.when(pk % 5 != 0, outcome(F.col("home_team"), 0)),
        F.when(pk % 7 != 0, outcome(F.col("away_team"), 1)),
        F.when(pk % 3 != 0, outcome(F.lit("Draw"), 2)),
        F.when(pk % 11 == 0, outcome(F.col("home_team"), 3)),
    ))
    bookmaker = F.struct(
        F.element_at(F.array(*[F.lit(k) for k in BOOKMAKER_KEYS]),
                     (F.col("l_suppkey") % 6 + 1).cast("int")).alias("key"),
        F.array(F.struct(F.when(pk % 4 == 0, "spreads").otherwise("h2h").alias("key"),
                         outcomes.alias("outcomes"))).alias("markets"),
    )
    rank_key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                        "l_extendedprice", "l_shipdate")
    books = (lines.select("match_id", rank_key.alias("rk"), bookmaker.alias("bm"))
             .groupBy("match_id")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "bm"))),
                              lambda x: x["bm"]).alias("bookmakers")))
    entries = feed.join(books, "match_id", "left").select(
        "match_id", "match_date", "home_team", "away_team",
        F.when(F.col("match_id") % 35 == 0, F.lit(None))
        .otherwise(F.coalesce("bookmakers", F.array().cast(books.schema["bookmakers"].dataType)))
        .alias("bookmakers"))
    # every 15th match appears a second time at the end of its page, with moved prices
    moved = F.transform("bookmakers", lambda b: b.withField(
        "markets", F.transform(b["markets"], lambda mk: mk.withField(
            "outcomes", F.transform(mk["outcomes"], lambda o: o.withField("price", o["price"] + 0.5))))))
    copies = F.explode(F.when(F.col("match_id") % 15 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    both = entries.withColumn("copy", copies).withColumn("bookmakers", F.when(F.col("copy") == 1, moved).otherwise(F.col("bookmakers")))
    entry = F.struct("home_team", "away_team", "bookmakers")
    pages = (both.select("match_date", _page(F.col("match_id")).alias("page"),
                         F.struct("copy", "match_id", entry.alias("e")).alias("x"))
             .groupBy("match_date", "page")
             .agg(F.sort_array(F.collect_list("x")).alias("xs")))
    return pages.select(
        F.col("match_date").alias("feed_date"), "page",
        F.to_json(F.transform("xs", lambda x: x["e"])).alias("body"))


def training_frame(m: DataFrame) -> DataFrame:
    """``M`` under the feature input contract: its pre-match odds as Avg/B365 columns."""
    return m.withColumns({
        "avg_over25": F.col("odds_avg_over25"),
        "b365_over25": F.col("odds_b365_over25"),
        "avg_home": F.col("odds_home"),
        "avg_draw": F.col("odds_draw"),
        "avg_away": F.col("odds_away"),
    })


# --- season CSV files written from M (two header layouts, mixed date formats) ------------

FULL_LAYOUT_LEAGUES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
# real files carry dozens of further bookmaker columns; the known odds stand last, behind them
FILLER = [f"X{i:02d}" for i in range(45)]
FULL_LAYOUT = ["Referee", "Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "HS", "AS", "HST", "AST", "HC", "AC",
               *FILLER, "B365H", "B365D", "B365A", "AvgH", "AvgD", "AvgA", "B365>2.5", "Avg>2.5"]
SHORT_LAYOUT = ["Date", "Div", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "Avg>2.5", "AvgH", "AvgD", "AvgA"]
FILES = 12            # season files are cut by ranges of (season, league, date, id) into this many parts


def _odds_text(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c)))


def _int_text(c: str) -> Column:
    return F.col(c).cast("int").cast("string")


def season_cells(m: DataFrame) -> DataFrame:
    """``M`` as the text cells of a season file (``season``/``league`` for the folders)."""
    mid = F.col("match_id")
    date_text = (F.when(mid % 97 == 0, F.lit("not a date"))
                 .when(mid % 7 == 0, F.date_format("match_date", "dd/MM/yy"))
                 .otherwise(F.date_format("match_date", "dd/MM/yyyy")))
    return m.select(
        "match_date", "match_id",
        F.year("match_date").cast("string").alias("season"), F.col("competition").alias("league"),
        F.lit("M Dean, \"ref\"").alias("Referee"), *[F.lit("1.50").alias(c) for c in FILLER],
        F.col("competition").alias("Div"), date_text.alias("Date"),
        F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"),
        _int_text("home_score").alias("FTHG"), _int_text("away_score").alias("FTAG"),
        _int_text("h_shots").alias("HS"), _int_text("a_shots").alias("AS"),
        _int_text("h_shots_ot").alias("HST"), _int_text("a_shots_ot").alias("AST"),
        _int_text("h_corners").alias("HC"), _int_text("a_corners").alias("AC"),
        _odds_text("b365_home").alias("B365H"), _odds_text("b365_draw").alias("B365D"),
        _odds_text("b365_away").alias("B365A"),
        _odds_text("odds_home").alias("AvgH"), _odds_text("odds_draw").alias("AvgD"),
        _odds_text("odds_away").alias("AvgA"),
        _odds_text("odds_b365_over25").alias("B365>2.5"), _odds_text("odds_avg_over25").alias("Avg>2.5"),
    )


def _ordered_files(part: DataFrame, layout: list[str]) -> DataFrame:
    """Rows in (season, league, date, id) order, cut by ranges: a folder may get several files, named in order."""
    order = ["season", "league", "match_date", "match_id"]
    return (part.repartitionByRange(FILES, *order).sortWithinPartitions(*order)
            .select("season", "league", *[F.col(f"`{c}`") for c in layout]))


def write_season_csvs(m: DataFrame, root: str) -> None:
    """Files in season/league folders, lines in (date, match id) order; leagues in
    FULL_LAYOUT_LEAGUES get the long header."""
    cells = season_cells(m)
    full = cells.filter(F.col("league").isin(*FULL_LAYOUT_LEAGUES))
    short = cells.filter(~F.col("league").isin(*FULL_LAYOUT_LEAGUES))
    for i, (part, layout) in enumerate(((full, FULL_LAYOUT), (short, SHORT_LAYOUT))):
        (_ordered_files(part, layout).write.mode("overwrite" if i == 0 else "append").option("header", True)
         .option("escape", '"').partitionBy("season", "league").csv(root))


def write_plain_season_csvs(m: DataFrame, root: str) -> None:
    """The plain layout ``<season>/<file>.csv``: one folder per calendar year, long header."""
    spark = m.sparkSession
    path = run_dir(spark, "season_matches")       # the matches are joined once, each season reads its own folder
    year = StructField("__year", IntegerType())
    m.withColumn("__year", F.year("match_date")).write.partitionBy("__year").parquet(path)
    rows = spark.read.schema(StructType([*m.schema.fields, year])).parquet(path)
    for r in rows.select("__year", F.col("__year").cast("string").alias("season")).distinct().orderBy("season").collect():   # one row per season
        (_ordered_files(season_cells(rows.filter(F.col("__year") == r["__year"])), FULL_LAYOUT).drop("season", "league")
         .write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{root}/{r.season}"))
