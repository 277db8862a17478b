"""Hard-negative mining by a vertical scan (BOND) over blocks of columnar vectors.

Vectors become integers, ``floor(SCALE * x)`` per component; the score of two is their inner
product.  Anchors (ids divisible by ``ANCHOR_EVERY``) are the stated query set.  A positive of
an anchor is one of its ``n_positives`` best other rows of its label; its hard negatives are the
``n_negatives`` best rows of other labels whose score lies between ``low_percent`` of the
positive's score and that score.  Higher scores come first, ties by smaller id.

Rows are dealt by the hash of their id to blocks of about ``BLOCK_ROWS`` and written column by
column (:func:`column_blocks`), anchors to slices of about ``SLICE_ANCHORS``.  Every (block,
slice) is one unit of bounded size.  Inside a unit each anchor reads the columns in the order
of its own descending magnitudes, ``STRIDE`` at a time.  What the unread columns can still add
is bounded below and above by the block's column minima and maxima, so after every step rows
leave the bitmap of candidates that cannot reach the wanted ones: the best of a label
(:func:`best_of_label`), or the best inside the windows of the positives
(:func:`best_in_windows`).  Rows that stay to the last column have exact scores.  The best of
all units are merged by rank windows over (anchor) and (anchor, positive).

Scores are computed in doubles while every partial sum stays under 2**53, where they are exact,
and in Python's integers beyond; a score outside 64 bits raises an error.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take
no part; of rows that share an id the one with the smallest (label, vector) counts, so repeated
rows count once; shorter vectors end in zeros; an anchor without another row of its label has no
rows in the result, and so has a positive with a negative score or an empty window; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.textops import materialise

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
BLOCK_ROWS = 8192            # rows of a block
SLICE_ANCHORS = 1024         # anchors of a slice
STRIDE = 8                   # columns read between two looks at the bounds
EXACT = 2 ** 53              # sums of doubles are exact below


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): one row per id that takes part, with its integer components; labels as the contract changes them."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return (embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
            .select(F.col("vec_id").cast("long"), label.alias("label"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("q"))
            .groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q"))


def _matrix(vectors: pa.ChunkedArray, n: int) -> np.ndarray:
    """Column-major components [column, row]; shorter vectors end in zeros."""
    flat = vectors.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((int(size.max(initial=0)), n), dtype=np.int64)
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[place, row] = flat.flatten().to_numpy()
    return out


def column_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block: ids and labels, sorted by (label, id), and the columns with their smallest and largest component."""
    def run(key: tuple, part: pa.Table) -> pa.Table:
        ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        order = np.lexsort((ids, labels))
        columns = _matrix(part.column("q"), len(ids))[:, order]
        arrays = (ids[order], labels[order], columns, columns.min(axis=1), columns.max(axis=1))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in arrays]],
                        names=["block", "ids", "labels", "columns", "low", "high"])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", block).groupBy("block").applyInArrow(
        run, "block int, ids binary, labels binary, columns binary, low binary, high binary")


class Block:
    """The columns of a block in the number type that is exact for them and the anchors of a unit."""

    def __init__(self, row: dict, largest: int):
        self.ids, self.labels = (np.frombuffer(row[n], dtype="<i8") for n in ("ids", "labels"))
        columns = np.frombuffer(row["columns"], dtype="<i8").reshape(-1, len(self.ids))
        self.low, self.high = (np.frombuffer(row[n], dtype="<i8") for n in ("low", "high"))
        bound = sum(max(abs(int(a)), abs(int(b))) for a, b in zip(self.low, self.high)) * largest
        self.number = np.float64 if bound < EXACT else object
        self.columns, self.low, self.high = (x.astype(self.number) for x in (columns, self.low, self.high))

    def reading(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The anchor's order of columns, its components in it, and after ``k`` columns the least and most that the rest adds."""
        vector = vector[:len(self.columns)]
        order = np.argsort(-np.abs(vector), kind="stable")
        q = vector[order].astype(self.number)
        a, b = q * self.low[order], q * self.high[order]
        none = np.zeros(1, dtype=self.number)
        least = np.concatenate([np.cumsum(np.minimum(a, b)[::-1])[::-1], none])
        most = np.concatenate([np.cumsum(np.maximum(a, b)[::-1])[::-1], none])
        return order, q, least, most


def _scan(block: Block, vector: np.ndarray, rows: np.ndarray, stays) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block that ``stays(partial scores, least rest, most rest)`` keeps to the last column, and their scores."""
    order, q, least, most = block.reading(vector)
    partial = np.zeros(len(rows), dtype=block.number)
    for lo in range(0, len(order), STRIDE):
        read = order[lo:lo + STRIDE]
        whole = len(rows) and rows[-1] - rows[0] + 1 == len(rows)      # neighbours: a view instead of a copy
        columns = block.columns[read, rows[0]:rows[-1] + 1] if whole else block.columns[np.ix_(read, rows)]
        partial = partial + q[lo:lo + STRIDE] @ columns
        bitmap = stays(partial, least[min(lo + STRIDE, len(order))], most[min(lo + STRIDE, len(order))])
        if not bitmap.all():
            rows, partial = rows[bitmap], partial[bitmap]
            if not len(rows):
                break
    if not len(order):
        bitmap = stays(partial, 0, 0)
        rows, partial = rows[bitmap], partial[bitmap]
    return rows, partial


def _first(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` first: higher score, then smaller id."""
    if len(scores) > 4 * n:                                 # what ties with the n-th stays in
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        some = np.arange(len(scores))
    order = np.lexsort((ids[some], (-scores[some]).astype(np.float64))) if scores.dtype != object else \
        np.array(sorted(range(len(some)), key=lambda k: (-scores[some[k]], ids[some[k]])), dtype=np.int64)
    return some[order[:n]]


def best_of_label(block: Block, vector: np.ndarray, label: int, own_id: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's ``n`` best rows of a label besides the anchor."""
    rows = np.arange(*np.searchsorted(block.labels, [label, label + 1]))
    rows = rows[block.ids[rows] != own_id]

    def stays(partial: np.ndarray, least, most) -> np.ndarray:
        if len(partial) <= n:
            return np.ones(len(partial), dtype=bool)
        return partial + most >= np.partition(partial, len(partial) - n)[len(partial) - n] + least

    rows, scores = _scan(block, vector, rows, stays)
    first = _first(block.ids[rows], scores, n)
    return block.ids[rows[first]], scores[first]


def windows_of(positive_scores: list[int], low_percent: int = LOW_PERCENT) -> list[tuple[int, int]]:
    """Least and largest score of a hard negative for every positive."""
    return [(-(-low_percent * s // 100), s) for s in positive_scores]


def best_in_windows(block: Block, vector: np.ndarray, label: int, windows: list[tuple[int, int]],
                    n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window: ids and scores of the block's ``n`` best rows of other labels inside it."""
    a, b = np.searchsorted(block.labels, [label, label + 1])
    rows = np.concatenate([np.arange(a), np.arange(b, len(block.ids))])
    open_windows = sorted({w for w in windows if w[0] <= w[1]})

    def stays(partial: np.ndarray, least, most) -> np.ndarray:
        bitmap = np.zeros(len(partial), dtype=bool)
        for low, high in open_windows:
            may = (partial + most >= low) & (partial + least <= high)
            sure = partial[may & (partial + least >= low) & (partial + most <= high)]
            if len(sure) > n:                               # n rows are surely in: worse ones are not needed here
                may &= partial + most >= np.partition(sure, len(sure) - n)[len(sure) - n] + least
            bitmap |= may
        return bitmap

    if open_windows:
        rows, scores = _scan(block, vector, rows, stays)
    else:
        rows, scores = rows[:0], np.zeros(0)
    out = []
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        first = inside[_first(block.ids[rows[inside]], scores[inside], n)]
        out.append((block.ids[rows[first]], scores[first]))
    return out


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers (an error beyond)."""
    return np.array([int(s) for s in scores], dtype=np.int64)


def _units(anchors: DataFrame, blocks: DataFrame, n_blocks: int, slices: int, run, schema: str) -> DataFrame:
    """Run ``run(anchors of a slice, block)`` on every (block, slice)."""
    def unit(asking: pa.Table, block: pa.Table) -> pa.Table:
        rows = asking.to_pylist() if block.num_rows else []
        if not rows:
            return pa.schema([(n, t) for n, t in types]).empty_table()
        vectors = [np.array(r["q"], dtype=np.int64) for r in rows]
        largest = max((int(np.abs(v).max(initial=0)) for v in vectors), default=0)
        found = run(rows, vectors, Block(block.to_pylist()[0], largest))
        return pa.table([pa.array(x, t) for x, (_, t) in zip(found, types)], names=[n for n, _ in types])

    types = [(c.split()[0], pa.int64()) for c in schema.split(", ")]
    dealt = anchors.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit("slice")), F.lit(slices)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    copies = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return dealt.groupBy("block", "slice").cogroup(copies.groupBy("block", "slice")).applyInArrow(unit, schema)


def positives(anchors: DataFrame, blocks: DataFrame, n_blocks: int, slices: int, n: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_id, score): the ``n`` best other rows of the anchor's label."""
    def run(rows: list[dict], vectors: list[np.ndarray], block: Block) -> list[np.ndarray]:
        anchor, other, score = [], [], []
        for r, v in zip(rows, vectors):
            ids, scores = best_of_label(block, v, r["label"], r["vec_id"], n)
            anchor.append(np.full(len(ids), r["vec_id"], dtype=np.int64))
            other.append(ids), score.append(_whole(scores))
        return [np.concatenate(x) for x in (anchor, other, score)]

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return (_units(anchors, blocks, n_blocks, slices, run, "anchor_id long, positive_id long, score long")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank"))


def mine(embeddings: DataFrame, every: int = ANCHOR_EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         low_percent: int = LOW_PERCENT, block_rows: int = BLOCK_ROWS, slice_anchors: int = SLICE_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialise(quantised(embeddings), "quantised")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    n_blocks, slices = max(1, -(-n_rows // block_rows)), max(1, -(-n_anchors // slice_anchors))
    blocks = materialise(column_blocks(rows, n_blocks), "blocks")
    best = materialise(positives(anchors, blocks, n_blocks, slices, n_positives), "positives")
    asked = anchors.join(best.groupBy(F.col("anchor_id").alias("vec_id")).agg(                # n_positives of each at most
        F.sort_array(F.collect_list(F.struct("positive_id", "score"))).alias("positives")), "vec_id")

    def run(found: list[dict], vectors: list[np.ndarray], block: Block) -> list[np.ndarray]:
        anchor, positive, ps, negative, ns = [], [], [], [], []
        for r, v in zip(found, vectors):
            scores = [p["score"] for p in r["positives"]]
            for p, (ids, got) in zip(r["positives"], best_in_windows(block, v, r["label"], windows_of(scores, low_percent), n_negatives)):
                anchor.append(np.full(len(ids), r["vec_id"], dtype=np.int64))
                positive.append(np.full(len(ids), p["positive_id"], dtype=np.int64))
                ps.append(np.full(len(ids), p["score"], dtype=np.int64))
                negative.append(ids), ns.append(_whole(got))
        return [np.concatenate(x) for x in (anchor, positive, ps, negative, ns)]

    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (_units(asked, blocks, n_blocks, slices, run,
                   "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ORACLE_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
     WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
r AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
      WHERE {LOW_PERCENT} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= {NEGATIVES}
"""
