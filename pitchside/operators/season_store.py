"""Match store by seasons: a manifest per version, upserts that rewrite only touched seasons, a delta log.

A store folder holds ``manifests/<version>.json`` and data folders that are never changed once
written.  A manifest names the data folder of every season (with its rows and its smallest and
largest key) and the deltas not yet merged, oldest first.  It is written beside its place and moved
into it, which commits the version: a job that dies before leaves folders no manifest names, and
readers of an older version keep theirs.

* :meth:`SeasonStore.upsert` (K-01) reads and rewrites the seasons of the batch, and those that hold
  a batch key under another date (a moved match).  Only seasons whose key range meets the batch's
  are searched for such keys, by their key column alone.  All other seasons are carried over by name.
* :meth:`SeasonStore.append` (G-01) writes a micro-batch as a delta and nothing else, so its cost does
  not follow the store; :meth:`SeasonStore.read` merges deltas on reading, :meth:`SeasonStore.compact`
  merges them into the seasons they touch.

Every write carries the id of its batch.  Ids grow; a batch whose id is not above the last applied
one was applied before and is skipped, so replays leave one version.  There is one writer at a time
(a streaming query, or a scheduled job).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import STORE_SCHEMA
from .upsert import ORD, SEQ, conform, latest_per_key

KEY = "match_id"
UNDATED = "undated"
KEY_ROWS = 1_000_000         # keys of a batch that are broadcast after counting them; more are joined by shuffle
EMPTY = {"version": 0, "last_batch": -1, "seasons": {}, "deltas": []}


def season(date: Column) -> Column:
    """The season folder of a match: its calendar year."""
    return F.coalesce(F.year(date).cast("string"), F.lit(UNDATED))


class SeasonStore:
    """The store under ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # --- manifests -------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.base}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A committed version, the last one by default; the empty store before the first."""
        versions = self.versions()
        if not versions:
            return dict(EMPTY)
        fs, p = self._fs(f"{self.base}/manifests/{versions[-1] if version is None else version:09d}.json")
        source = self.spark._jvm.java.util.Scanner(fs.open(p), "UTF-8").useDelimiter("\\A")
        try:
            return json.loads(source.next())
        finally:
            source.close()

    def _commit(self, manifest: dict) -> int:
        """Move the manifest into its place; an error if that version is there already (another writer)."""
        target = f"{self.base}/manifests/{manifest['version']:09d}.json"
        fs, place = self._fs(target)
        _, beside = self._fs(f"{self.base}/manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise RuntimeError(f"version {manifest['version']} of {self.base} was written by another job")
        return manifest["version"]

    # --- reading ---------------------------------------------------------------------------------

    def _seasons(self, manifest: dict, names: Iterable[str] | None = None) -> DataFrame:
        paths = [f"{self.base}/{s['path']}" for n, s in sorted(manifest["seasons"].items()) if names is None or n in names]
        if not paths:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.spark.read.schema(STORE_SCHEMA).parquet(*paths)

    def _deltas(self, manifest: dict) -> DataFrame | None:
        """The last row per key of the unmerged deltas."""
        if not manifest["deltas"]:
            return None
        rows = self.spark.read.parquet(*[f"{self.base}/{d['path']}" for d in manifest["deltas"]])
        return conform(latest_per_key(rows, KEY))

    def _keys(self, rows: DataFrame, n_rows: int) -> DataFrame:
        keys = rows.select(KEY)
        return F.broadcast(keys) if n_rows <= KEY_ROWS else keys

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: those of the seasons without a newer row in a delta, and the deltas' rows."""
        manifest = self.manifest(version)
        stored, newer = self._seasons(manifest), self._deltas(manifest)
        if newer is None:
            return stored
        pending = sum(d["rows"] for d in manifest["deltas"])
        return stored.join(self._keys(newer, pending), KEY, "left_anti").unionByName(newer)

    # --- writing ---------------------------------------------------------------------------------

    def _write_seasons(self, rows: DataFrame, touched: set[str], manifest: dict) -> dict:
        """``manifest`` with the touched seasons in a new folder; seasons left without rows go."""
        folder = f"data/{uuid.uuid4().hex}"
        out = conform(rows).withColumn("__season", season(F.col("match_date")))
        out.hint("rebalance", "__season").write.partitionBy("__season").parquet(f"{self.base}/{folder}")
        fs, p = self._fs(f"{self.base}/{folder}")
        written = sorted(n.removeprefix("__season=") for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("__season="))
        seasons = {n: s for n, s in manifest["seasons"].items() if n not in touched}
        if written:                                             # nothing but keys is read back
            new = self.spark.read.parquet(*[f"{self.base}/{folder}/__season={n}" for n in written]) \
                .select(F.regexp_extract(F.col("_metadata.file_path"), r"__season=([^/]+)/", 1).alias("season"), KEY)
            for r in new.groupBy("season").agg(F.count("*").alias("rows"), F.min(KEY).alias("low"), F.max(KEY).alias("high")).collect():
                seasons[r.season] = {"path": f"{folder}/__season={r.season}", "rows": r.rows, "low": r.low, "high": r.high}
        return {**manifest, "version": manifest["version"] + 1, "seasons": seasons}

    def _merged(self, newer: DataFrame, manifest: dict) -> dict:
        """``manifest`` with ``newer`` (one stored row per key) merged into the seasons it touches."""
        facts = newer.agg(F.count("*").alias("n"), F.min(KEY).alias("low"), F.max(KEY).alias("high"),
                          F.collect_set(season(F.col("match_date"))).alias("seasons")).first()      # a set of calendar years
        if not facts.n:
            return {**manifest, "version": manifest["version"] + 1}
        touched = set(facts.seasons)
        searched = {n for n, s in manifest["seasons"].items() if n not in touched and s["low"] <= facts.high and facts.low <= s["high"]}
        keys = self._keys(newer, facts.n)
        if searched:                                            # moved matches: the key column of these seasons
            moved = self._seasons(manifest, searched).select(
                KEY, F.regexp_extract(F.col("_metadata.file_path"), r"__season=([^/]+)/", 1).alias("season")).join(keys, KEY, "left_semi")
            touched |= {r.season for r in moved.select("season").distinct().collect()}              # calendar years
        kept = self._seasons(manifest, touched).join(keys, KEY, "left_anti")
        return self._write_seasons(kept.unionByName(newer), touched, manifest)

    def _stored_once(self, rows: DataFrame, folder: str) -> DataFrame:
        rows.write.parquet(f"{self.base}/{folder}")
        return self.spark.read.parquet(f"{self.base}/{folder}")

    def init(self) -> int:
        """K-02: version 0 without rows, if there is no version yet."""
        return self.versions()[-1] if self.versions() else self._commit(dict(EMPTY))

    def upsert(self, batch: DataFrame, batch_id: int) -> int:
        """K-01: whole-row replace by key; the highest ``(batch_seq, batch_ord)`` of a key wins.  Returns the version."""
        manifest = self.manifest()
        if batch_id <= manifest["last_batch"]:
            return manifest["version"]
        if manifest["deltas"]:
            raise RuntimeError("the store has unmerged deltas: compact it before an upsert")
        # read several times below: the batch's rows are stored once
        newer = self._stored_once(conform(latest_per_key(batch, KEY)), f"batches/{uuid.uuid4().hex}")
        return self._commit({**self._merged(newer, manifest), "last_batch": batch_id})

    def append(self, batch: DataFrame, batch_id: int) -> int:
        """G-01: add a micro-batch (with ``batch_seq`` and ``batch_ord``) as a delta.  Returns the version."""
        manifest = self.manifest()
        if batch_id <= manifest["last_batch"]:
            return manifest["version"]
        path = f"deltas/{batch_id:09d}-{uuid.uuid4().hex}"
        columns = [*[f.name for f in STORE_SCHEMA.fields], SEQ, ORD]
        n = self._stored_once(batch.select(*columns), path).count()
        added = [{"path": path, "rows": n}] if n else []
        return self._commit({**manifest, "version": manifest["version"] + 1, "last_batch": batch_id, "deltas": manifest["deltas"] + added})

    def compact(self) -> int:
        """Merge the deltas into the seasons they touch.  Returns the version."""
        manifest = self.manifest()
        newer = self._deltas(manifest)
        if newer is None:
            return manifest["version"]
        newer = self._stored_once(newer, f"batches/{uuid.uuid4().hex}")
        return self._commit({**self._merged(newer, manifest), "deltas": []})
