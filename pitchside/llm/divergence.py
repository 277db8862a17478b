r"""Source divergence audit: how the words of a language's sources differ.

Terms are the runs ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` of a text, only A-Z lower-cased.
One table for ``bytes.translate`` lowers the letters and turns every separator into a
blank in one pass; ``bytes.split`` cuts the terms and a ``Counter`` per document gives its
frequencies.  From there on everything is sparse:

1. :func:`term_counts` sums occurrences and documents per (lang, source, term), first
   inside the tasks, then after the one shuffle of the job, by (lang, term);
2. :func:`kept_cells` keeps the terms found in at least ``MIN_DOCS`` documents of their
   language;
3. :func:`probabilities` gives every occurring cell its smoothed integer share; a term that
   a source lacks has the one value ``zero`` of that source, so absent cells are never made;
4. :func:`pair_distances` sums the differences of all pairs of sources of a language, unit
   by unit: a unit holds some terms and two blocks of sources.  Terms that neither source
   of a pair has count with the difference of the two ``zero`` values;
5. :func:`top_terms` ranks the terms that a source has more often than its language.

All numbers are exact: sums are 64-bit, the share is an integral division of 38-digit
decimals.

Defined cases: null text, lang and source are empty strings; every row is a document of
its own, repeated rows and rows with null or shared ids included; a source without terms
still has its pairs; a language without kept terms has distance 0 between its sources;
a language with one source has no pairs; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.textops import materialise, small_batches, text_slices

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000        # shares are counted in billionths
SMOOTHING = 5
BATCH_BYTES = 8 << 20
HELD_TERMS = 400_000         # different (group, term) entries held by a task before it hands them on
BLOCK_SOURCES = 256          # sources of one block
CHUNK_TERMS = 1024           # terms of one unit, times the blocks of the language
MOST_CHUNK_TERMS = 16_384
DENSE_TERMS = 256            # terms compared at once inside a unit

# fixed values: A-Z are lowered, a-z and all bytes of non-ASCII characters stay, every other byte separates
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def document_terms(text: str | None) -> Counter:
    """Terms of one text with their frequencies."""
    return Counter((text or "").encode().translate(TABLE).split())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed per task and dealt by (lang, term); a row with a null
    term names each group that occurs."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, dict[bytes, int]]] = {}      # per group: documents of a term, repeats in them

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (of, again) in held.items():
                rows = len(of) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * rows), pa.array([source] * rows), pa.array([None, *map(bytes.decode, of)], pa.string()),
                     pa.array([0, *[d + again.get(t, 0) for t, d in of.items()]], pa.int64()), pa.array([0, *of.values()], pa.int64())], names)
            held.clear()

        for batch in batches:
            for part in text_slices(batch, "text", BATCH_BYTES):
                rows = sorted(zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))), key=lambda r: r[:2])
                for lang, source, text in rows:                        # group by group: its counts stay at hand
                    of, again = held.setdefault((lang, source), (Counter(), {}))
                    terms = document_terms(text)
                    of.update(terms.keys())
                    for t, n in [x for x in terms.items() if x[1] > 1]:
                        again[t] = again.get(t, 0) + n - 1
                if sum(len(of) for of, _ in held.values()) + len(held) > HELD_TERMS:
                    yield from handed_on()
        yield from handed_on()

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def kept_cells(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n): the occurring cells of the kept terms, and the groups' rows without a term.

    The counts lie by (lang, term) already, so neither the sums nor the window over a term's sources move them again.
    """
    of_term = Window.partitionBy("lang", "term")
    return (counts.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
            .where((F.col("lang_docs") >= min_docs) | F.col("term").isNull()).drop("docs", "lang_docs"))


def groups(kept: DataFrame) -> DataFrame:
    """(lang, source, v, total, lang_total): every group with the kept terms of its language and its occurrences of them."""
    cells = kept.where("term IS NOT NULL")
    per_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_term = cells.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    per_lang = per_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    return (kept.where("term IS NULL").select("lang", "source").distinct()
            .join(per_lang, "lang", "left").join(per_source, ["lang", "source"], "left").fillna(0, ["v", "total", "lang_total"]))


def share(n: Column, total: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * v))``, exactly; null without kept terms."""
    over = (n.cast("decimal(20,0)") + F.lit(SMOOTHING)) * F.lit(SCALE).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + F.lit(SMOOTHING) * v.cast("decimal(18,0)")
    return F.when(v > 0, 1 + F.call_function("div", over, F.nullif(under, F.lit(0))))


def probabilities(cells: DataFrame, group: DataFrame) -> DataFrame:
    """Cells with their share ``p`` in the source and ``q`` in the language."""
    cells = cells.where("term IS NOT NULL")
    return cells.join(group, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))


def unit_distances(i: int, j: int, block: np.ndarray, source: np.ndarray, term: np.ndarray, p: np.ndarray,
                   names: list[str], of_block: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Summed differences of all pairs (source of block i, source of block j) over the terms of a unit, and the number of these.

    ``source`` are places in ``names``; ``of_block`` and ``zero`` go with ``names``.
    """
    terms, row = np.unique(term, return_inverse=True)
    left, right = np.flatnonzero(of_block == i), np.flatnonzero(of_block == j)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    order = np.argsort(row, kind="stable")
    row, source, p = row[order], source[order], p[order]
    for lo in range(0, len(terms), DENSE_TERMS):
        a, b = np.searchsorted(row, [lo, lo + DENSE_TERMS])
        dense = np.repeat(zero[:, None], min(DENSE_TERMS, len(terms) - lo), axis=1)
        dense[source[a:b], row[a:b] - lo] = p[a:b]
        other = dense[right]
        for k, at in enumerate(left):
            out[k] += np.abs(other - dense[at]).sum(axis=1)
    return left, right, out, len(terms)


def pair_distances(cells: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, source, other, value) of every ordered pair of different sources of a language."""
    sizes = group.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v"))
    blocks = F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int")
    chunk = F.least(blocks * CHUNK_TERMS, F.lit(MOST_CHUNK_TERMS))
    sizes = sizes.select("lang", "v", blocks.alias("blocks"), F.greatest(F.ceil(F.col("v") / chunk), F.lit(1)).cast("int").alias("chunks"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    zero = share(F.lit(0), F.col("total"), F.col("v"))
    # every unit gets the zero values of all its sources, and the cells of its terms
    sources = group.drop("v").join(sizes, "lang").select(
        "lang", "source", "blocks", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(None).cast("string").alias("term"), F.coalesce(zero, F.lit(0)).alias("p"))
    found = cells.join(sizes, "lang").select(
        "lang", "source", "blocks", block.alias("block"), F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), "term", "p")
    units = (sources.unionByName(found).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("lang", "chunk", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block",
                     "source", "term", "p"))

    def run(key: tuple, unit: pa.Table) -> pa.Table:
        lang, _, i, j = (k.as_py() for k in key)
        is_zero = unit.column("term").is_null().to_numpy()
        zeros, some = unit.filter(pa.array(is_zero)), unit.filter(pa.array(~is_zero))
        names = zeros.column("source").to_pylist()
        place = {name: k for k, name in enumerate(names)}
        source = np.array([place[s] for s in some.column("source").to_pylist()], dtype=np.int64)
        encoded = some.column("term").combine_chunks().dictionary_encode()
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        term = encoded.indices.to_numpy() if len(encoded) else np.zeros(0, dtype=np.int64)
        zero = zeros.column("p").to_numpy()
        left, right, sums, n = unit_distances(i, j, some.column("block").to_numpy(), source, term, some.column("p").to_numpy(), names,
                                              zeros.column("block").to_numpy(), zero)
        u, v = np.repeat(left, len(right)), np.tile(right, len(left))
        pair = u != v                                   # within a block both orders are there already
        u, v, sums = u[pair], v[pair], sums.reshape(-1)[pair]
        if i != j:
            u, v, sums = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([sums, sums])
        name = np.array(names, dtype=object)
        return pa.table([pa.array([lang] * len(u), pa.string()), pa.array(name[u], pa.string()), pa.array(name[v], pa.string()),
                         pa.array(sums, pa.int64()), pa.array(np.full(len(u), n), pa.int64()), pa.array(np.abs(zero[u] - zero[v]), pa.int64())],
                        names=["lang", "source", "other", "sum", "terms", "apart"])

    parts = units.groupBy("lang", "chunk", "i", "j").applyInArrow(
        run, "lang string, source string, other string, sum long, terms long, apart long")
    summed = parts.groupBy("lang", "source", "other").agg(F.sum("sum").alias("sum"), F.sum("terms").alias("terms"), F.max("apart").alias("apart"))
    return summed.join(sizes.select("lang", "v"), "lang").select(
        "lang", "source", "other", (F.col("sum") + (F.col("v") - F.col("terms")) * F.col("apart")).alias("value"))


def top_terms(cells: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """(lang, source, term, value, rank): the terms a source has most above its language."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (cells.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, most: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    small_batches(docs.sparkSession, BATCH_BYTES)
    kept = materialise(kept_cells(term_counts(docs), min_docs), "kept_cells")
    group = materialise(groups(kept), "groups")
    cells = materialise(probabilities(kept, group), "shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = pair_distances(cells, group).withColumn("rank", F.row_number().over(order))
    return (pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
            .unionByName(top_terms(cells, most).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.n,
             1 + ({SCALE}::HUGEINT * (x.n + {SMOOTHING})) // (s.total + {SMOOTHING} * l.v) AS p,
             1 + ({SCALE}::HUGEINT * (x.lang_n + {SMOOTHING})) // (l.total + {SMOOTHING} * l.v) AS q
      FROM x JOIN s ON s.lang = x.lang AND s.source = x.source JOIN l ON l.lang = x.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
