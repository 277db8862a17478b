"""Row numbers and running counts without a single-partition window.

``row_number() OVER (ORDER BY k)`` with no partition, or partitioned by a
hot key, sends every row of that partition to one task.  Here the order is
cut into buckets that are *monotone* in the order (e.g. a date, a
probability band): rows are numbered inside (partition, bucket) groups,
bucket sizes are counted (a small table: one row per bucket), turned into
offsets by a window over that small table, and added back.  The result is
exactly ``row_number()`` over the full order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_number(df: DataFrame, *, order: Sequence[Column], buckets: Sequence[Column],
                    partition: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order`` within ``partition``.

    ``buckets`` are columns whose (ascending) values never decrease along
    ``order``; rows of one bucket are contiguous in the order.
    """
    part = list(partition)
    bcols = [f"__b{i}" for i in range(len(buckets))]
    staged = df.select("*", *[b.alias(n) for b, n in zip(buckets, bcols)])
    local = staged.withColumn(
        "__local", F.row_number().over(Window.partitionBy(*part, *bcols).orderBy(*order)))
    # offsets level by level: totals of the first bucket column inside the partition, of the second
    # inside the first, ... so no window holds more rows than one level has under one parent
    counts = staged.groupBy(*part, *bcols).agg(F.count(F.lit(1)).alias("__n"))
    offsets = None
    for depth in range(len(bcols), 0, -1):
        keys = [*part, *bcols[:depth]]
        level = counts.groupBy(*keys).agg(F.sum("__n").alias("__n"))
        before = Window.partitionBy(*keys[:-1]).orderBy(F.col(bcols[depth - 1]).asc_nulls_first()) \
            .rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__o{depth}"))
        offsets = level if offsets is None else _join_null_safe(offsets, level, keys)
    total = sum((F.col(f"__o{d}") for d in range(1, len(bcols) + 1)), F.lit(0))
    offsets = offsets.select(*part, *bcols, total.alias("__off"))
    return _join_null_safe(local, offsets, [*part, *bcols]).withColumn(name, (F.col("__off") + F.col("__local")).cast("long")) \
        .drop("__local", "__off", *bcols)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null; the right side's other columns are added."""
    renamed = right.withColumnsRenamed({k: f"__r_{i}" for i, k in enumerate(keys)})
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(renamed[f"__r_{i}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond).drop(*[f"__r_{i}" for i in range(len(keys))])


def count_before(df: DataFrame, *, key: str, weight: str, bucket: Column, name: str) -> DataFrame:
    """For distinct, ordered ``key`` values: sum of ``weight`` over all strictly smaller keys.

    ``bucket`` must be monotone in ``key``; the in-bucket prefix is a window
    per bucket and the bucket offsets come from a window over the bucket totals.
    """
    staged = df.withColumn("__b", bucket)
    inner = staged.withColumn(
        "__in", F.coalesce(F.sum(weight).over(
            Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = staged.groupBy("__b").agg(F.sum(weight).alias("__t"))
    offs = totals.select("__b", F.coalesce(F.sum("__t").over(
        Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return inner.join(offs, "__b").withColumn(name, F.col("__off") + F.col("__in")).drop("__b", "__in", "__off")
