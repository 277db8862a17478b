"""The plain season layout: matches are computed once, whatever the number of seasons."""

import os

from pyspark.sql import functions as F

from pitchside.plans import views as V


def matches(spark):
    text = ["match_time", "competition", "home_team", "away_team", "status"]
    numbers = ["home_score", "away_score", "h_shots", "a_shots", "h_shots_ot", "a_shots_ot", "h_corners", "a_corners", "odds_home",
               "odds_draw", "odds_away", "odds_avg_over25", "odds_b365_over25", "b365_home", "b365_draw", "b365_away", "p_over25"]
    rows = [(i, d) for i, d in enumerate(["2023-02-01", "2024-02-01", "2025-02-01", "2025-03-01", None])]
    return spark.createDataFrame(rows, "match_id long, day string").select(
        "match_id", F.col("day").cast("date").alias("match_date"), *[F.lit("x").alias(c) for c in text], *[F.lit(1.0).alias(c) for c in numbers])


def test_matches_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    m = matches(spark)
    V.write_plain_season_csvs(m.mapInArrow(tick, m.schema), str(tmp_path))
    assert seen.value == 5
    assert {"2023", "2024", "2025"} <= set(os.listdir(tmp_path))
    assert [spark.read.option("header", True).csv(f"{tmp_path}/{y}").count() for y in (2023, 2024, 2025)] == [1, 1, 2]
