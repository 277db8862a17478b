"""G-01: landed fixture payload files → parse → odds enrichment → delta log of the match store, incrementally.

``readStream`` picks up new landed files; every micro-batch is parsed with
the batch operators, enriched against the latest odds snapshot and appended to the store's delta
log inside ``foreachBatch``: its cost follows the micro-batch, not the store.  Every
``compact_every`` micro-batches the deltas are merged into the seasons they touch.  A replayed
micro-batch (after a failure, the checkpoint makes Spark re-run it with the same id) is skipped by
its id, and a compaction that was cut off leaves the last version as it was.  Within a batch the
later row wins: file time, then file name, page and position in the response; a later batch wins
over an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import odds as O
from ..operators import upsert as U
from ..operators.season_store import SeasonStore
from ..sources import payloads as P
from ..sources.store import STORE_SCHEMA

LANDED_SCHEMA = T.StructType([
    T.StructField("request_date", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("body", T.StringType()),
])


def land_payloads(docs: DataFrame, folder: str, name: str) -> None:
    """Write payload documents as JSON-lines files (the landing zone of the API poller)."""
    target = f"{folder}/{name}" if name else folder
    docs.select("request_date", "page", "body").write.mode("append").json(target)


def _enriched(parsed: DataFrame, odds: DataFrame | None) -> DataFrame:
    if odds is not None:
        return O.enrich_odds(parsed, odds)
    return parsed.withColumns({"odds_home": F.lit(2.10), "odds_draw": F.lit(3.20), "odds_away": F.lit(3.40)})


COMPACT_EVERY = 16       # micro-batches between two compactions


def upsert_batch(spark: SparkSession, batch: DataFrame, batch_id: int, store: str,
                 odds: DataFrame | None, compact_every: int = COMPACT_EVERY) -> int:
    """One micro-batch: parse → enrich → stamp (seq = batch id; the later landed file wins
    inside the batch) → append; returns the store version."""
    place = ["__mtime", "__file", "__page"]
    landed = batch.select("*", F.unix_millis(F.col("file_mtime")).alias("__mtime"), F.col("file_name").alias("__file"),
                          F.col("page").alias("__page"))
    rows = _enriched(P.parse_fixtures(landed, keep=place, item="__item"), odds)
    rows = rows.withColumn("__ord", F.struct(*place, "__item")).select(
        *[F.col(f.name).cast(f.dataType) for f in STORE_SCHEMA.fields], "__ord")
    target = SeasonStore(spark, store)
    version = target.append(U.stamp(rows, batch_id, "__ord").drop("__ord"), batch_id)
    return target.compact() if (batch_id + 1) % compact_every == 0 else version


def run_upsert_stream(spark: SparkSession, landing: str, store: str, checkpoint: str,
                      odds: DataFrame | None = None, files_per_batch: int = 1, compact_every: int = COMPACT_EVERY) -> int:
    """Process every landed file (``availableNow``) and return the last store version."""
    SeasonStore(spark, store).init()
    stream = (spark.readStream.schema(LANDED_SCHEMA)
              .option("maxFilesPerTrigger", files_per_batch)
              .json(f"{landing}/*")
              .select("*", F.col("_metadata.file_modification_time").alias("file_mtime"),
                      F.col("_metadata.file_path").alias("file_name")))

    def on_batch(df: DataFrame, batch_id: int) -> None:
        upsert_batch(spark, df, batch_id, store, odds, compact_every)

    q = (stream.writeStream.foreachBatch(on_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return SeasonStore(spark, store).versions()[-1]
