"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon of words and word stems is learned from labelled texts by log odds.  Each
whole text becomes a dense vector (:data:`FEATURES`): lexicon densities, nearness of
lexicon words to second-person words, capitals, punctuation, and obfuscation rates
(symbols or digits inside words, lexicon words that show only after undoing them).
Spark's gradient-boosted trees give a margin, and an isotonic regression, fitted on
rows the trees have not seen, turns it into a probability.

Training bound: at most about ``TRAIN_ROWS`` labelled rows, those with the smallest hash
of their id; a quarter of them calibrates.  Scoring covers all rows and whole texts.

Defined cases: null and empty texts are scored like any other (all densities 0);
without labelled rows of both classes, with fewer than ``FEWEST`` of one, or with none of
one in the calibrating quarter, every score is the share of toxic rows (0 without any); labels that are null are left out; repeated rows are scored each for
itself; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pitchside.llm.textops import materialise, text_bytes, text_slices, word_hashes

TRAIN_ROWS = 20_000
LEXICON_SIZE = 4_000
MIN_Z = 4.0                  # least log odds of a lexicon entry, in standard errors
STEMS = (4, 5)               # a stem is the first so many bytes of a word
FEWEST = 8                   # least rows of each class to train and calibrate on
TREES, DEPTH = 20, 4
BATCH_BYTES = 2 << 20
# fixed values: second-person words of four languages, and characters used in place of letters
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
                 "tú ti usted ustedes vosotros").split()
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = ("log_words", "hits_per_word", "log_hits", "stems_per_word", "log_stems", "weight_per_word", "nearness",
            "near_hits_per_word", "capitals", "shouted_words", "punctuation", "exclamations", "symbols_in_words",
            "hidden_per_word", "log_hidden")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_LOWER = _class("abcdefghijklmnopqrstuvwxyz")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _LOWER | _UPPER
_LETTER[128:] = True
_PUNCT = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_INSIDE = _PUNCT | _class("0123456789")
_INSIDE[[ord("'"), ord("-")]] = False
_ALIKE = np.arange(256, dtype=np.uint8)
for _a, _b in LOOK_ALIKES.items():
    _ALIKE[ord(_a)] = ord(_b)


@dataclass
class Lexicon:
    """Hashes of words and stems (sorted) with their log odds."""

    words: np.ndarray
    weights: np.ndarray
    stems: np.ndarray

    @staticmethod
    def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
        return (table[at] == h if len(table) else np.zeros(len(h), dtype=bool)), at


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.zeros(len(data) + 2, dtype=np.int8)
    mask[1:-1] = _LETTER[data]
    edge = np.diff(mask)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Words:
    """Lower-cased words of a batch of texts."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
        self.edge = np.cumsum([len(t) + 1 for t in raw]) if raw else np.zeros(0, dtype=np.int64)
        self.start, self.end = _letters(self.data)
        self.owner = np.searchsorted(self.edge, self.start, side="right")
        self.hash = word_hashes(self.data, self.start, self.end)

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Stem hash of the words longer than a stem, and their indices."""
        long = np.flatnonzero(self.end - self.start > size)
        return word_hashes(self.data, self.start[long], self.start[long] + size), long


def _slices(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        yield from text_slices(batch, "text", BATCH_BYTES)


def lexicon_counts(labelled: DataFrame) -> DataFrame:
    """(kind, hash, toxic, clean): documents of each class that hold a word (kind 0) or a stem of ``kind`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            w = _Words([t or "" for t in part.column("text").to_pylist()])
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for kind, (h, index) in [(0, (w.hash, np.arange(len(w.hash))))] + [(s, w.stems(s)) for s in STEMS]:
                owner = w.owner[index]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                value, inverse = np.unique(h[new], return_inverse=True)
                is_toxic = toxic[owner[new]]
                n_toxic = np.bincount(inverse, weights=is_toxic, minlength=len(value)).astype(np.int64)
                n_clean = np.bincount(inverse, weights=1 - is_toxic, minlength=len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), kind), pa.int32()), pa.array(value.view(np.int64)), pa.array(n_toxic),
                     pa.array(n_clean)], ["kind", "hash", "toxic", "clean"])

    return (labelled.select("text", "toxic").mapInArrow(run, "kind int, hash long, toxic long, clean long")
            .groupBy("kind", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def learn_lexicon(labelled: DataFrame, n_toxic: int, n_clean: int, size: int = LEXICON_SIZE) -> Lexicon:
    """Entries whose log odds are at least ``MIN_Z`` standard errors above zero; at most ``size`` reach the driver."""
    def log_share(count: str, n: int) -> Column:
        return F.log((F.col(count) + 0.5) / (n + 1))

    odds = log_share("toxic", n_toxic) - log_share("clean", n_clean)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5) + F.lit(1 / (n_toxic + 1) + 1 / (n_clean + 1)))
    rows = (lexicon_counts(labelled).where("toxic >= 3").withColumn("odds", odds).withColumn("z", F.col("odds") / error)
            .where((F.col("z") >= MIN_Z) | ((F.col("clean") == 0) & (F.col("odds") >= 4.0)))
            .orderBy(F.desc("z"), "kind", "hash").limit(size).collect())
    words = sorted((np.uint64(r.hash % (1 << 64)), r.odds) for r in rows if r.kind == 0)
    stems = sorted(np.uint64(r.hash % (1 << 64)) for r in rows if r.kind > 0)
    return Lexicon(np.array([w for w, _ in words], dtype=np.uint64), np.array([x for _, x in words]),
                   np.array(stems, dtype=np.uint64))


def text_features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """The feature matrix of a batch of texts."""
    n = len(texts)
    w = _Words(texts)
    words = np.bincount(w.owner, minlength=n)
    per_word = 1.0 / np.maximum(words, 1)

    def per_text(owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights=weights, minlength=n).astype(float)

    hit, at = lexicon._find(lexicon.words, w.hash)
    stem = hit.copy()
    for size in STEMS:
        h, index = w.stems(size)
        stem[index] |= lexicon._find(lexicon.stems, h)[0]
    hits, stems = per_text(w.owner[hit]), per_text(w.owner[stem])
    weight = per_text(w.owner[hit], lexicon.weights[at[hit]])

    listed = [s.encode() for s in SECOND_PERSON]
    ends = np.cumsum([len(s) for s in listed])
    you = word_hashes(np.frombuffer(b"".join(listed), dtype=np.uint8), ends - [len(s) for s in listed], ends)
    place, address = np.flatnonzero(stem), np.flatnonzero(np.isin(w.hash, you))
    distance = np.full(len(place), np.inf)
    if len(address):
        right = np.searchsorted(address, place)
        for side in (np.minimum(right, len(address) - 1), np.maximum(right - 1, 0)):
            other = address[side]
            same = w.owner[other] == w.owner[place]
            distance = np.where(same, np.minimum(distance, np.abs(other - place)), distance)
    nearness = per_text(w.owner[place], 1 / (1 + distance)) / np.maximum(stems, 1)
    near = per_text(w.owner[place[distance <= 3]])

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    edge = np.cumsum([len(t) + 1 for t in raw]) if raw else np.zeros(0, dtype=np.int64)
    of = np.repeat(np.arange(n), [len(t) + 1 for t in raw])[:len(data)] if n else np.zeros(0, dtype=np.int64)
    letter, upper = _LETTER[data], _UPPER[data]
    letters = np.maximum(per_text(of[letter]), 1)
    start, end = _letters(data)
    owner = np.searchsorted(edge, start, side="right")
    caps = np.concatenate(([0], np.cumsum(upper)))
    shouted = (end - start > 2) & (caps[end] - caps[start] == end - start)
    symbol = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        symbol[1:-1] = _INSIDE[data[1:-1]] & letter[:-2] & letter[2:]
    size = np.maximum([len(t) for t in raw], 1) if n else np.zeros(0)

    # lexicon words that show only when look-alike characters are read as letters, or symbols inside words are dropped
    hidden = np.zeros(n)
    low = w.data
    for change in ("alike", "drop"):
        if change == "alike":
            seen, seen_edge = _ALIKE[low], w.edge
        else:
            inner = np.zeros(len(low), dtype=bool)
            if len(low) > 2:
                inner[1:-1] = _PUNCT[low[1:-1]] & _LETTER[low[:-2]] & _LETTER[low[2:]]
            seen = low[~inner]
            seen_edge = w.edge - np.concatenate((np.cumsum(inner), [0]))[np.minimum(w.edge, len(low)) - 1] if n else w.edge
        s, e = _letters(seen)
        h = word_hashes(seen, s, e)
        found = lexicon._find(lexicon.words, h)[0]
        hidden += np.maximum(per_text(np.minimum(np.searchsorted(seen_edge, s[found], side="right"), n - 1)) - hits, 0)

    return np.stack([
        np.log1p(words), hits * per_word, np.log1p(hits), stems * per_word, np.log1p(stems), weight * per_word, nearness,
        near * per_word, per_text(of[upper]) / letters, per_text(owner[shouted]) * per_word,
        per_text(of[_PUNCT[data]]) / size, per_text(of[data == ord("!")]) / size, per_text(of[symbol]) * per_word,
        hidden * per_word, np.log1p(hidden)], axis=1) if n else np.zeros((0, len(FEATURES)))


def with_features(docs: DataFrame, lexicon: Lexicon, column: str = "__features") -> DataFrame:
    """``docs`` with the dense features of its texts as an array column."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)   # at most LEXICON_SIZE entries
    schema = StructType(docs.schema.fields + [StructField(column, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            m = text_features([b.decode("utf-8", "replace") for b in text_bytes(part.column("text"))], shared.value)
            offsets = pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(part.columns + [pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))],
                                             part.schema.names + [column])

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic, part) of about ``limit`` labelled rows by the hash of their id; part in [0, 1) splits them."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = (known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(key < min(1.0, limit / max(n, 1))))
    # about ``limit`` narrow rows: the share of the hash range bounds the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) / 1000).alias("part"))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Callable[[DataFrame], DataFrame]:
    """Learn from labelled documents; returns a function that adds ``score`` to a frame with a text column."""
    rows = materialise(training_rows(docs, labels, limit), "toxic_rows")
    count = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        share = float(count.get(1, 0) > 0)
        return lambda frame: frame.withColumn("score", F.lit(share))
    lexicon = learn_lexicon(rows, count[1], count[0])
    points = materialise(with_features(rows, lexicon).select("toxic", "part", "__features"), "toxic_points").select(
        F.col("toxic").cast("double").alias("label"), "part", array_to_vector("__features").alias("__vector"))
    parts = {(r.label, r.calibrates) for r in points.select("label", (F.col("part") < 0.25).alias("calibrates")).distinct().collect()}
    if len(parts) < 4 or min(count.values()) < FEWEST:
        share = count[1] / (count[0] + count[1])
        return lambda frame: frame.withColumn("score", F.lit(share))
    trees = GBTClassifier(featuresCol="__vector", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1, maxBins=64,
                          minInstancesPerNode=2)
    model = trees.fit(points.where("part >= 0.25").coalesce(8))
    model = model.setRawPredictionCol("__raw").setPredictionCol("").setProbabilityCol("")

    def margin(frame: DataFrame) -> DataFrame:
        return model.transform(frame).withColumn("__margin", vector_to_array("__raw")[1])

    calibration = IsotonicRegression(featuresCol="__margin", labelCol="label", predictionCol="score").fit(
        margin(points.where("part < 0.25")).select("__margin", "label"))

    def score(frame: DataFrame) -> DataFrame:
        vectors = with_features(frame.drop("score"), lexicon).withColumn("__vector", array_to_vector("__features"))
        return (calibration.transform(margin(vectors)).drop("__features", "__vector", "__raw", "__margin")
                .withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))))

    return score


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
