"""Match-store and fixture-list scans (S-02, S-05..S-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_SCHEMA = T.StructType([
    T.StructField("match_id", T.LongType(), False),
    T.StructField("match_date", T.DateType()),
    T.StructField("match_time", T.StringType()),
    T.StructField("competition", T.StringType()),
    T.StructField("home_team", T.StringType()),
    T.StructField("away_team", T.StringType()),
    T.StructField("home_score", T.IntegerType()),
    T.StructField("away_score", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("odds_home", T.DoubleType()),
    T.StructField("odds_draw", T.DoubleType()),
    T.StructField("odds_away", T.DoubleType()),
])

FIXTURE_LIST_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("competition", T.StringType()),
    T.StructField("home_team", T.StringType()),
    T.StructField("away_team", T.StringType()),
    T.StructField("match_id", T.LongType()),
])


def _source(spark: SparkSession, store) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(store) if isinstance(store, str) else store


def read_match_store(spark: SparkSession, store) -> DataFrame:
    """S-02: the 8 feature columns of the store, scores as floating point.

    ``store`` is a parquet path or a DataFrame with the store layout.
    No ORDER BY: the only consumer orders inside its window.
    """
    df = _source(spark, store)
    date = F.col("match_date")
    if isinstance(df.schema["match_date"].dataType, T.StringType):
        date = F.try_to_date(date)
    return df.select(
        "match_id", date.alias("match_date"), "competition", "home_team", "away_team",
        F.col("home_score").cast("double").alias("home_score"),
        F.col("away_score").cast("double").alias("away_score"),
        "status")


def match_meta(spark: SparkSession, store) -> DataFrame:
    """S-06: kickoff time and odds per match (column-pruned scan)."""
    return _source(spark, store).select("match_id", "match_time", "odds_home", "odds_draw", "odds_away")


def finished_scores(spark: SparkSession, store) -> DataFrame:
    """S-07: scores of finished matches (the filter reaches the parquet scan)."""
    return _source(spark, store).filter(F.col("status") == "FINISHED").select("home_score", "away_score")


def store_profile(spark: SparkSession, store, sample: int = 5, max_leagues: int = 10) -> DataFrame:
    """S-08: one row — row count, up to 10 competitions, the first ids by match_id, the column list.

    The reference's LIMIT is unordered; here the sample is the smallest ids.
    The competition list is the 10 smallest names (sort + limit, a top-k).
    :func:`store_head` gives the rows themselves.
    """
    df = _source(spark, store)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    leagues = (df.select("competition").where(F.col("competition").isNotNull()).distinct()
               .orderBy("competition").limit(max_leagues)
               .agg(F.array_join(F.array_sort(F.collect_list("competition")), ",").alias("competitions")))
    first = (df.select("match_id").orderBy("match_id").limit(sample)
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("match_id")), lambda i: i.cast("string")), ",")
                  .alias("first_ids")))
    return (total.crossJoin(leagues).crossJoin(first)          # one row each
            .withColumn("columns", F.lit(",".join(df.columns))))


def store_head(spark: SparkSession, store, sample: int = 5, n_columns: int | None = None) -> DataFrame:
    """S-08: the first rows by match_id with all columns, or with the first ``n_columns`` of them."""
    df = _source(spark, store)
    return df.orderBy("match_id").limit(sample).select(*df.columns[:n_columns])


def write_fixture_list(df: DataFrame, path: str) -> None:
    """The fixture list CSV: ``date,competition,home_team,away_team[,match_id]`` with a header."""
    cols = [F.date_format("match_date", "yyyy-MM-dd").alias("date"), "competition", "home_team", "away_team"]
    if "match_id" in df.columns:
        cols.append("match_id")
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_fixture_list(spark: SparkSession, path: str) -> DataFrame:
    """S-05: fixture list with an explicit schema; unparseable dates become NULL."""
    raw = spark.read.option("header", True).schema(FIXTURE_LIST_SCHEMA).csv(path)
    return raw.select(
        F.try_to_date(F.col("date")).alias("match_date"),
        "competition", "home_team", "away_team", "match_id")
