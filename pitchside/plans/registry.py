"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

the views in :mod:`pitchside.plans.views`) so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(key: str):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    from . import queries  # noqa: F401  (registers every key)
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from . import queries  # noqa: F401
    from .oracle import ORACLE
    return dict(ORACLE)
