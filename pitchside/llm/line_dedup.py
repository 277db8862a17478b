r"""Line dedup: lines that repeat across documents stay in the smallest document only.

Texts are split at ``\n``.  A line's key is the line without ``[\x20\x09-\x0D]`` at both
ends, A-Z lower-cased; keys under ``MIN_CHARS`` code points never count.  A key found in at
least two documents loses all its lines except those of the smallest document.

No lines are joined.  The distinct keys, as 128-bit digests, are dealt to shards, and every
shard becomes a compact index (:func:`build_index`): a minimal perfect hash whose slots lead
to an array of fingerprints, an array of document counts (saturated at 255) and, for
repeated keys only, the smallest document.  :func:`probe` sends the lines of all documents
as digests to the shards, where they read the arrays; only lines to be dropped come back,
as (document, line number), and :func:`removals` cuts them.

Every probed key is in the index, as both come from the same table; a probe whose
fingerprint differs raises an error instead of being answered by another key's entry.

Sizes.  The number of shards follows the counted bytes of the texts (``SHARD_BYTES``).  A key
that is in every text is counted once per batch before it is sent.  Probes of a shard with
more than ``PROBES_PER_TASK`` lines (a hot key) are dealt to that many copies of its index.

Defined cases: null and empty texts are one empty line; rows that share an id are one
document, each with its own lines; documents with a null id come after all others, ordered by
a 64-bit hash of their texts, and equal texts among them are one document; repeated rows give
repeated results; an empty table gives an empty result; further columns stay (:func:`dedup`)
or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pitchside.llm.perfect_hash import PerfectHash, fingerprint
from pitchside.llm.textops import materialise, mix64, run_starts, small_batches, text_slices

MIN_CHARS = 10
SHARD_BYTES = 2 << 20            # text bytes whose lines make one shard
PROBES_PER_TASK = 500_000        # lines that one copy of a shard's index answers
MOST_HOT_SHARDS = 100_000        # shards with copies: the bound of the table sent to all tasks
BATCH_BYTES = 8 << 20
SPACE = " \t\n\x0b\x0c\r"        # fixed values: the characters stripped from a line

KEYS = ["__null", "__id", "__text"]     # a document: without an id or not, its id or else text hash, its text hash
INDEX = ("shard int, entries long, sizes array<long>, bits binary, fingerprints binary, counts binary, "
         "first_null binary, first_id binary")


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, None if it is too short to count."""
    key = line.strip(SPACE)
    return key.encode().lower() if len(key) >= min_chars else None


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    return (docs.withColumn("__null", F.col("doc_id").isNull().cast("int")).withColumn("__text", text)
            .withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.col("__text"))))


def _lines(part: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests (a, b) of the lines that count, the row of each in the batch and its line number."""
    digests, row, number = [], [], []
    for k, text in enumerate(part.column("text").to_pylist()):
        for j, line in enumerate((text or "").split("\n")):
            key = line_key(line, min_chars)
            if key is not None:
                digests.append(blake2b(key, digest_size=16).digest())
                row.append(k)
                number.append(j)
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1], np.array(row, dtype=np.int64), np.array(number, dtype=np.int32)


def _distinct_rows(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that repeat a document of the batch get the same marks: one is enough."""
    key = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEYS], axis=1)
    first = np.unique(key, axis=0, return_index=True)[1]
    return part if len(first) == len(key) else part.take(pa.array(np.sort(first)))


def _shard(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def count_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, min(-(-size // shard_bytes), 1 << 30))


def _key_counts(rows: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """Per batch and key: its smallest and largest document, documents and lines."""
    names = ["shard", "a", "b", "null0", "id0", "null1", "id1", "docs", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_BYTES):
                a, b, row, _ = _lines(part, min_chars)
                null, doc = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("__null", "__id"))
                order = np.lexsort((doc, null, b, a))
                a, b, null, doc = a[order], b[order], null[order], doc[order]
                new_key = np.ones(len(a), dtype=bool)
                new_key[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                new_doc = new_key.copy()
                new_doc[1:] |= (null[1:] != null[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new_key)
                last = np.append(first[1:], len(a)) - 1 if len(first) else first
                docs = np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_shard(a[first], shards)), pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)),
                     pa.array(null[first], pa.int32()), pa.array(doc[first], pa.int64()), pa.array(null[last], pa.int32()),
                     pa.array(doc[last], pa.int64()), pa.array(docs), pa.array(last - first + 1)], names)

    return rows.select(*KEYS, "text").mapInArrow(
        run, "shard int, a long, b long, null0 int, id0 long, null1 int, id1 long, docs long, lines long")


def _index_row(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The index of one shard from its entries, sorted by key."""
    c = {n: np.concatenate([x.column(n).to_numpy(zero_copy_only=False) for x in held]) for n in held[0].schema.names}
    a, b = c["a"].view(np.uint64), c["b"].view(np.uint64)
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    end, key = np.append(start[1:], len(a)), np.cumsum(new) - 1
    low = np.lexsort((c["id0"], c["null0"], key))[start]        # the first of every key in that order
    high = np.lexsort((c["id1"], c["null1"], key))[end - 1]
    repeated = (c["null0"][low] != c["null1"][high]) | (c["id0"][low] != c["id1"][high])
    a, b = a[start], b[start]
    function = PerfectHash.of(a, b)
    slot = function.slots(a, b)
    prints, counts = np.zeros(len(a), dtype="<u4"), np.zeros(len(a), dtype=np.uint8)
    prints[slot] = fingerprint(a, b)
    counts[slot] = np.where(repeated, np.clip(np.add.reduceat(c["docs"], start), 2, 255), 1)
    at = slot[repeated]
    order = np.argsort(at)                                      # repeated keys in the order of their slots
    null, doc = c["null0"][low][repeated][order].astype(np.uint8), c["id0"][low][repeated][order].astype("<i8")
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([int(c["lines"].sum())], pa.int64()), pa.array([function.sizes.tolist()], pa.list_(pa.int64())),
         *[pa.array([x.tobytes()], pa.binary()) for x in (function.words.astype("<u8"), prints, counts, null, doc)]],
        ["shard", "entries", "sizes", "bits", "fingerprints", "counts", "first_null", "first_id"])


def build_index(docs: DataFrame, shards: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per shard with keys: the perfect hash and its arrays (see ``INDEX``)."""
    shards = shards or count_shards(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:                               # sorted by shard: one shard is held at a time
            of = batch.column("shard").to_numpy()
            cuts = [*run_starts(of), len(of)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and held[0].column("shard")[0].as_py() != of[lo]:
                    yield _index_row(held[0].column("shard")[0].as_py(), held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield _index_row(held[0].column("shard")[0].as_py(), held)

    counted = _key_counts(_keyed(docs), shards, min_chars)
    return counted.repartition("shard").sortWithinPartitions("shard", "a", "b").mapInArrow(run, INDEX)


class ShardIndex:
    """The arrays of one shard, read from its index row."""

    def __init__(self, row: dict):
        self.function = PerfectHash(np.array(row["sizes"], dtype=np.int64), np.frombuffer(row["bits"], dtype="<u8"))
        self.fingerprints = np.frombuffer(row["fingerprints"], dtype="<u4")
        self.counts = np.frombuffer(row["counts"], dtype=np.uint8)
        self.first_null = np.frombuffer(row["first_null"], dtype=np.uint8)
        self.first_id = np.frombuffer(row["first_id"], dtype="<i8")
        self.rank = np.cumsum(self.counts > 1) - 1

    def elsewhere(self, a: np.ndarray, b: np.ndarray, null: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which keys also stand in a smaller document than the given one."""
        slot = self.function.slots(a, b)
        if (slot < 0).any() or (self.fingerprints[slot] != fingerprint(a, b)).any():
            raise ValueError("a line is not in the index: the documents changed since it was built")
        out = self.counts[slot] > 1
        first = self.rank[slot[out]]
        out[out] = (self.first_null[first] != null[out]) | (self.first_id[first] != doc[out])
        return out


def probe(docs: DataFrame, index: DataFrame, shards: int, min_chars: int = MIN_CHARS, per_task: int = PROBES_PER_TASK) -> DataFrame:
    """(__null, __id, __text, line) of the lines that a smaller document has too."""
    total = index.agg(F.sum("entries")).first()[0] or 0
    bound = max(per_task, -(-total // MOST_HOT_SHARDS))         # so at most MOST_HOT_SHARDS shards are over it
    copies = F.ceil(F.col("entries") / bound).cast("int")
    hot = {r.shard: r.copies for r in index.where(F.col("entries") > bound).select("shard", copies.alias("copies")).collect()}
    hot_shard = np.array(sorted(hot), dtype=np.int32)
    hot_copies = np.array([hot[s] for s in sorted(hot)], dtype=np.int64)
    table = docs.sparkSession.sparkContext.broadcast((hot_shard, hot_copies))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_shard, hot_copies = table.value
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_BYTES):
                part = _distinct_rows(part)
                a, b, row, number = _lines(part, min_chars)
                shard, copy = _shard(a, shards), np.zeros(len(a), dtype=np.int64)
                columns = [part.column(c).take(pa.array(row)) for c in KEYS]
                if len(hot_shard):
                    at = np.minimum(np.searchsorted(hot_shard, shard), len(hot_shard) - 1)
                    own = hot_shard[at] == shard
                    spread = mix64(columns[1].to_numpy().view(np.uint64)[own] + number[own].astype(np.uint64))
                    copy[own] = (spread % hot_copies[at[own]].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(copy.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *columns,
                     pa.array(number)], ["shard", "copy", "a", "b", *KEYS, "line"])

    def answer(sent: pa.Table, arrays: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return sent.select([*KEYS, "line"])
        a, b = (sent.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        found = ShardIndex(arrays.to_pylist()[0]).elsewhere(a, b, sent.column("__null").to_numpy(), sent.column("__id").to_numpy())
        return sent.select([*KEYS, "line"]).filter(pa.array(found))

    sent = _keyed(docs).select(*KEYS, "text").mapInArrow(
        digests, "shard int, copy int, a long, b long, __null int, __id long, __text long, line int")
    arrays = index.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return sent.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInArrow(
        answer, "__null int, __id long, __text long, line int")


def _cut(docs: DataFrame, min_chars: int, shards: int | None, per_task: int) -> DataFrame:
    """``docs`` with the kept text as ``__kept`` and its lines before and dropped as ``__lines`` and ``__dropped``."""
    small_batches(docs.sparkSession, BATCH_BYTES)
    shards = shards or count_shards(docs)
    index = materialise(build_index(docs.select("doc_id", "text"), shards, min_chars), "line_index")
    marks = (probe(docs.select("doc_id", "text"), index, shards, min_chars, per_task)
             .groupBy(*KEYS).agg(F.collect_set("line").alias("__gone")))
    marked = _keyed(docs).join(marks, KEYS, "left").drop(*KEYS)
    names = [n for n in marked.columns if n != "__gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, before, dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("__gone").to_pylist()):
                lines = (text or "").split("\n")
                before.append(len(lines))
                dropped.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    lines = [x for k, x in enumerate(lines) if k not in gone]
                kept.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(kept, pa.string()), pa.array(before, pa.int64()),
                                              pa.array(dropped, pa.int64())], [*names, "__kept", "__lines", "__dropped"])

    fields = [f for f in marked.schema.fields if f.name != "__gone"]
    return marked.mapInArrow(run, StructType([*fields, *marked.select(F.col("text").alias("__kept")).schema.fields,
                                              StructField("__lines", LongType()), StructField("__dropped", LongType())]))


def removals(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int | None = None, per_task: int = PROBES_PER_TASK) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped of every row."""
    return _cut(docs.select("doc_id", "text"), min_chars, shards, per_task).select(
        "doc_id", F.col("__kept").alias("kept_text"), F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int | None = None, per_task: int = PROBES_PER_TASK) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text`` (null stays null); all columns as they were."""
    text: Column = F.when(F.col("text").isNotNull(), F.col("__kept"))
    return _cut(docs, min_chars, shards, per_task).withColumn("text", text).select(*docs.columns)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS row_text, unnest(range(len(lines))) AS pos FROM t),
k AS (SELECT doc_id, pos, row_text, translate(regexp_replace(row_text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.row_text, r.key IS NOT NULL AND r.first <> k.doc_id AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(row_text, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
