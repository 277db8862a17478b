"""Every value-checked key: Spark result == independent DuckDB SQL on the driver tables."""

import duckdb
import pytest

import __spark_entry__ as E
from pitchside.plans.compare import compare
from pitchside.sources.tables import DRIVER_TABLES

SF_DIR = "/root/testdata/sf0.001"
KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    yield con
    con.close()


def test_every_oracle_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_sql(spark, duck, key):
    df = E.queries()[key](spark, SF_DIR)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    ok, exact, msg = compare(df.columns, srows, ocols, cur.fetchall())
    assert ok, f"{key}: {msg}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1467
    assert "h_roll_scored" in df.columns
