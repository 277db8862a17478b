"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Words are runs of letters and digits, lower-cased; a shingle is five
consecutive words (an item with fewer words is one shingle of all its
words).  An item is found in a document when at least ``threshold`` of the
item's distinct shingles occur in the document.

Search.  A short item inside a long document has a tiny Jaccard similarity
to it, so a sketch of the whole document would lose it.  Only the item is
sketched: its MinHash sketch is its ``k`` smallest shingle hashes, and every
shingle hash of a document probes the sketches.  Items are partitioned by
size (powers of two of the shingle count ``n``); the partition's upper bound
``u`` fixes ``k = u - ceil(threshold * u) + 1``, and since a document that
holds ``threshold`` of an item misses at most ``n - ceil(threshold * n)``
of its shingles, one of the ``k`` sketch values always hits: the search loses
nothing, whatever the document's length.

Verification counts the item's shingle texts that occur in each candidate
document.

Everything is built from DataFrame functions.

Defined cases: null or wordless documents match nothing; null or wordless
items are found nowhere; rows sharing a ``doc_id`` (null ids too) count as one
document, the union of their shingles; rows sharing an ``item_id`` with
different texts are matched each for itself and the best one is returned; empty
tables give an empty result; further columns of either table are ignored by
the search and kept by :func:`decontaminate`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.llm.textops import materialise

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 100_000   # sketches and candidate lists are broadcast up to this counted size, joined by shuffle beyond
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _shingles(w: Column, k: int, make) -> Column:
    """``make(words)`` of all ``k``-word shingles of a word array (none if it is shorter).

    Elements are read one by one: ``slice`` inside a lambda copies the whole array every time.
    """
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - F.lit(k)))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")),
                       lambda i: make([F.get(w, i + j) for j in range(k)]))


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _sketch_size(n: Column, threshold: float) -> Column:
    """k of the size partition of ``n``: the bound's misses plus one."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))
    return (upper - F.ceil(upper * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


def item_shingles(items: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per distinct item text: item_id, item_key, words per shingle, n, shingles."""
    w = (items.select("item_id", F.col("text").alias("__text")).distinct()
         .withColumn("__words", words(F.col("__text")))
         .where(F.size("__words") > 0)
         .withColumn("width", F.least(F.size("__words"), F.lit(k))))
    whole = F.array(F.array_join(F.col("__words"), " "))
    return (w.withColumn("shingles", F.array_distinct(F.when(F.col("width") < k, whole)
                                                      .otherwise(_shingles(F.col("__words"), k, _text))))
            .select("item_id", F.struct("item_id", F.xxhash64("__text").alias("h")).alias("item_key"), "width",
                    F.size("shingles").alias("n"), "shingles"))


def sketches(shingled: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The MinHash sketch of every item: its k smallest shingle hashes, k by size partition."""
    def hashed(s: Column) -> Column:   # a shingle hashes as the list of its words
        parts = F.split(s, " ")
        return F.coalesce(*[F.when(F.size(parts) == n, _hash([F.get(parts, F.lit(j)) for j in range(n)]))
                            for n in range(1, k + 1)])

    hashes = F.sort_array(F.array_distinct(F.transform("shingles", hashed)))
    return shingled.select("item_key", "width",
                           F.explode(F.slice(hashes, F.lit(1), _sketch_size(F.col("n"), threshold))).alias("h"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint only for a frame whose counted rows stay under the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_items(docs: DataFrame, items: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id) with n_item_shingles, n_shared and containment >= ``threshold``."""
    shingled = materialise(item_shingles(items, k), "bench_items")
    sketch = materialise(sketches(shingled, k, threshold), "bench_sketches")
    widths = sorted(r.width for r in shingled.select("width").distinct().collect()) or [k]   # at most k values
    text = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)

    def shingle_rows(rows: DataFrame, each) -> DataFrame:
        return rows.select("doc_id", F.explode(F.concat(*[_shingles(F.col("w"), n, each) for n in widths])).alias("s"))

    probe = shingle_rows(text, _hash).withColumnRenamed("s", "h")
    candidates = materialise(probe.join(_small(sketch), "h").select("doc_id", "item_key").distinct(), "bench_candidates")

    full = shingled.select("item_key", "n", F.explode("shingles").alias("s"))
    wanted = _small(candidates.select("doc_id").distinct())
    present = (shingle_rows(text.alias("t").join(wanted.alias("c"), F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")),
                                                 "left_semi"), _text)
               .join(_small(full), "s").select("doc_id", "item_key", "n", "s").distinct()
               .groupBy("doc_id", "item_key", "n").agg(F.count("*").alias("n_shared")))
    found = (present.alias("p").join(candidates.alias("c"),
                                     F.col("p.doc_id").eqNullSafe(F.col("c.doc_id"))
                                     & F.col("p.item_key").eqNullSafe(F.col("c.item_key")), "left_semi")
             .where(F.col("n_shared") >= F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9))))
    best = F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), F.col("n"), F.col("n_shared")))
    return (found.groupBy("doc_id", F.col("item_key.item_id").alias("item_id")).agg(best.alias("b"))
            .select("doc_id", "item_id", F.col("b.n").cast("long").alias("n_item_shingles"),
                    F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.containment").alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no item was found, all their columns kept."""
    hit = materialise(find_items(docs, items, k, threshold).select("doc_id").distinct(), "bench_hits")
    return (docs.alias("d").join(_small(hit).alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")), "left_anti"))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
            FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
       FROM benchmark WHERE text IS NOT NULL),
ish AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
ni AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, widths WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, count(*) AS c FROM dsh JOIN ish USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c::DOUBLE / n AS containment
FROM hits JOIN ni USING (item_id) WHERE c >= ceil(n * 0.8 - 1e-9)
"""
