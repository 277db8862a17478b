"""Leakage-free rolling means over the previous N rows of a key.

``prior_rolling_means`` computes, for every row, the mean of each value
column over the ``window`` rows that precede it within its key (the row
itself excluded), and NULL unless at least ``min_periods`` of them are
non-null.  NULL values still occupy a slot of the frame.

Scale: a plain ``Window.partitionBy(key)`` puts each key's whole series in
one task, so a hot key (one team holding a third of all rows) serialises
the job.  With ``bucket`` set, the series is cut into (key, bucket) groups,
where ``bucket`` must be monotone in the row order (e.g. a date bucket):

1. one window over (key, bucket) gives every row its in-bucket frame; rows
   past the first ``window`` of their bucket already see all their
   predecessors and are final;
2. the first and last ``window`` rows of every bucket (at most
   ``2*window`` per bucket, so per key bounded by the number of buckets,
   not by data volume) are re-windowed per key; in that subsequence a head
   row's previous ``window`` rows are exactly its predecessors in the full
   series, so its value is exact too;
3. the two parts are unioned.

The only full-data shuffle is the (key, bucket) one; results equal the
plain window bit for bit when values are integers, and to float rounding
otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _means(frame, values: Sequence[str], prefix: str, min_periods: int, key: str) -> list[Column]:
    out = []
    for v in values:
        n = F.count(v).over(frame)
        mean = F.when(n >= min_periods, F.sum(v).over(frame) / n)
        out.append(F.when(F.col(key).isNotNull(), mean).alias(f"{prefix}{v}"))
    return out


def prior_rolling_means(
    df: DataFrame,
    *,
    key: str,
    order: Sequence[Column],
    values: Sequence[str],
    window: int = 10,
    min_periods: int = 3,
    bucket: Column | None = None,
    prefix: str = "roll_",
) -> DataFrame:
    """Add ``{prefix}{v}`` for each value column (see module doc)."""
    if window < 1:
        raise ValueError("window must be >= 1")
    values = list(values)
    if bucket is None:
        frame = Window.partitionBy(key).orderBy(*order).rowsBetween(-window, -1)
        return df.select("*", *_means(frame, values, prefix, min_periods, key))

    b = "__bucket"
    staged = df.withColumn(b, bucket)
    by_bucket = Window.partitionBy(key, b).orderBy(*order)
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = by_bucket.rowsBetween(-window, -1)
    s1 = staged.select(
        "*",
        F.row_number().over(by_bucket).alias("__rn"),
        F.count(F.lit(1)).over(whole).alias("__cnt"),
        *[F.sum(v).over(frame).alias(f"__s_{v}") for v in values],
        *[F.count(v).over(frame).alias(f"__c_{v}") for v in values],
    )
    base_cols = df.columns
    body = s1.filter(F.col("__rn") > window).select(
        *base_cols,
        *[F.when(F.col(key).isNotNull() & (F.col(f"__c_{v}") >= min_periods),
                 F.col(f"__s_{v}") / F.col(f"__c_{v}")).alias(f"{prefix}{v}") for v in values])
    edges = s1.filter((F.col("__rn") <= window) | (F.col("__rn") > F.col("__cnt") - window))
    per_key = Window.partitionBy(key).orderBy(*order).rowsBetween(-window, -1)
    heads = (edges.select(*base_cols, "__rn", *_means(per_key, values, prefix, min_periods, key))
             .filter(F.col("__rn") <= window).drop("__rn"))
    return body.unionByName(heads)


def lag_one(df: DataFrame, *, key: str, order: Sequence[Column], values: Sequence[str],
            bucket: Column | None = None, prefix: str = "prev_") -> DataFrame:
    """``shift(1)`` per key: the previous row's value (the leakage guard).

    A one-row frame with ``min_periods=1`` is exactly ``lag(v, 1)``, so the
    bucketed (skew-safe) path above is reused.
    """
    return prior_rolling_means(df, key=key, order=order, values=values, window=1,
                               min_periods=1, bucket=bucket, prefix=prefix)
