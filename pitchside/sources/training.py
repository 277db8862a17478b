"""Where training matches come from: season CSV files first, then the match store, else nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .season_csv import read_season_csv
from .store import read_match_store

EMPTY_SCHEMA = ("match_id long, match_date date, competition string, home_team string, away_team string, "
                "home_score double, away_score double, status string")


def has_files(spark: SparkSession, root: str | None, suffix: str = ".csv") -> bool:
    """Whether a file with the suffix lies somewhere under ``root`` (stops at the first one found)."""
    if not root:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return False
    files = fs.listFiles(path, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(suffix):
            return True
    return False


def training_matches(spark: SparkSession, csv_root: str | None = None, store: DataFrame | str | None = None) -> DataFrame:
    """W-10 source rule: the season files under ``csv_root`` if there are any, else the store, else no rows."""
    if has_files(spark, csv_root):
        return read_season_csv(spark, csv_root)
    if isinstance(store, DataFrame) or has_files(spark, store, ".parquet"):
        return read_match_store(spark, store)
    return spark.createDataFrame([], EMPTY_SCHEMA)
