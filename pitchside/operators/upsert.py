"""Keyed match store: create-if-absent, whole-row upsert by ``match_id``, versioned writes.

Spark has no primary key; the upsert job enforces it.  The latest row per
key is chosen with ``max(struct(seq, ord, ...))`` — an aggregate with a
map-side partial step, so a key repeated millions of times in a batch is
combined before the shuffle (no per-key window holds a hot group).
Each upsert writes a *new* version folder and never overwrites the one it
reads, so a failed or replayed job leaves the last good version intact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import STORE_SCHEMA

SEQ, ORD = "batch_seq", "batch_ord"


def latest_per_key(rows: DataFrame, key: str = "match_id", seq: str = SEQ, ord_: str = ORD) -> DataFrame:
    """One row per ``key``: the highest ``(seq, ord)`` wins; returns the row's other columns."""
    others = [c for c in rows.columns if c not in (key, seq, ord_)]
    best = rows.groupBy(key).agg(F.max(F.struct(seq, ord_, *others)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in others])


def stamp(batch: DataFrame, seq: int, ord_col: str | None = None) -> DataFrame:
    """Mark a batch with its sequence number and in-batch ordinal: a number or a struct, later rows win."""
    ordinal = F.lit(0).cast("long") if ord_col is None else F.col(ord_col)
    if ord_col and not isinstance(batch.schema[ord_col].dataType, T.StructType):
        ordinal = ordinal.cast("long")
    return batch.withColumn(SEQ, F.lit(seq).cast("long")).withColumn(ORD, ordinal)


def union_history(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """U-03: old ∪ new by name; the existing rows are older than any batch (seq -1)."""
    kind = batch.schema[ORD].dataType if ORD in batch.columns else T.LongType()
    first = F.lit(None if isinstance(kind, T.StructType) else 0).cast(kind)
    old = existing.withColumn(SEQ, F.lit(-1).cast("long")).withColumn(ORD, first)
    return old.unionByName(batch, allowMissingColumns=True)


def upsert_matches(existing: DataFrame, batch: DataFrame, key: str = "match_id") -> DataFrame:
    """K-01: whole-row replace by key (INSERT OR REPLACE); an empty batch is a no-op.

    ``batch`` must carry ``batch_seq`` / ``batch_ord`` (see :func:`stamp`).
    """
    return latest_per_key(union_history(existing, batch), key)


def conform(df: DataFrame) -> DataFrame:
    """Cast to the store layout (fixed column order and types)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STORE_SCHEMA.fields])


def init_store(spark: SparkSession, path: str) -> None:
    """K-02: create the empty store if absent (``mode("ignore")`` leaves an existing one)."""
    spark.createDataFrame([], STORE_SCHEMA).write.mode("ignore").parquet(path)


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write ``df`` as ``{base}/v={version}``; re-running a version overwrites only itself."""
    path = f"{base.rstrip('/')}/v={version:06d}"
    conform(df).write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(f"{base.rstrip('/')}/v={version:06d}")
