"""Best-fit packing: best-fit decreasing over a segment tree of remaining capacities.

:func:`tokenised_pieces` turns every text into its token ids plus an end id and
cuts only sequences over ``max_len``.  :func:`pack` places the pieces:

1. a histogram of piece lengths (at most ``max_len`` rows, whatever the corpus);
2. best-fit decreasing over that histogram (:func:`best_fit_plan`): a segment
   tree over remaining capacities finds the tightest open bin, and all bins of
   one capacity take the pieces of one length in one step, which is exactly what
   placing them one after the other would do;
3. the plan says which ranks within a length go where, so each piece finds its
   sequence and offset from its rank alone.

Ranks come from row numbers within (length, salt); the salts of a length follow
its counted pieces, so no window task holds more than about ``ROWS_PER_SALT``
rows.

Defined cases: a null text is empty and becomes one piece holding the end id;
repeated rows are packed each for itself; equal lengths are ranked by hash,
document id, piece, checksum and stored row number; an empty table gives an empty result; further
columns of the documents are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import LongType, StructField, StructType

from pitchside.llm.textops import held, let_go, materialise, small_batches, text_slices, tidy

MAX_LEN = 2048
END_ID = 0
ROWS_PER_SALT = 100_000
BATCH_BYTES = 4 << 20
CACHE_BYTES = 40 << 20           # of each generation of words, and of the parts
ENTRY_BYTES = 160                # an entry of the caches, about

# Texts of these characters only are split at white space and looked up word by word: for them white space never
# joins a token, lower-casing works letter by letter and they are in composed form.  Others go to the tokenizer whole.
_PLAIN_CHARS = "\t-\r -~\xa1-įı-ž"
_PLAIN = re.compile(f"[{_PLAIN_CHARS}]*")
# fixed values: the split pattern of the tokenizer file, for lower-cased plain text; line ends part the words
_LETTER, _NUMBER = "a-zªµºß-öø-ž", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+|\n")
_BETWEEN = b"\xff\xff\xff\xff"   # between the ids of two words: the top byte of an id is 0


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    Words and their parts are remembered in two generations of bounded bytes: what was looked up since the last change is
    in the young one; when that is full it becomes the old one and the words not asked for since are forgotten.  New parts
    go to the tokenizer's BPE model by themselves, in the byte letters that its byte-level step writes.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters, plain = ByteLevel(add_prefix_space=False, use_regex=False), re.compile(f"[{_PLAIN_CHARS}]")
        self.byte_letters = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x180) if plain.match(chr(c))}
        self.cache_bytes = cache_bytes
        self.by_word, self.old_words, self.held = {}, {}, 0
        self.by_part: dict[str, bytes] = {"\n": _BETWEEN}
        self.held_parts = 0

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _parts(self, parts: set[str]) -> None:
        """Have all ``parts`` among the known ones."""
        if self.held_parts > self.cache_bytes:
            self.by_part, self.held_parts = {"\n": _BETWEEN}, 0
        part, tokenize, letters = self.by_part, self.model.tokenize, self.byte_letters
        new = list(parts - part.keys())
        for k in range(0, len(new), 2000):
            some = new[k:k + 2000]
            got = [tokenize(p if p.isascii() else p.translate(letters)) for p in some]
            ids = self._pack([t.id for tokens in got for t in tokens])
            at = 0
            for p, tokens in zip(some, got):
                to = at + 4 * len(tokens)
                part[p] = ids[at:to]
                at = to
            self.held_parts += len(ids) + ENTRY_BYTES * len(some)

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of words that are in neither generation."""
        parts = _SPLIT.findall("\n".join(words).lower())
        self._parts(set(parts))
        return b"".join(map(self.by_part.__getitem__, parts)).split(_BETWEEN) if words else []

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of ``words``, each given once; all are in the young generation then."""
        if self.held > self.cache_bytes:
            self.old_words, self.by_word, self.held = self.by_word, {}, 0
        ids = list(map(self.by_word.get, words))
        gaps = [k for k, i in enumerate(ids) if i is None]
        asked = [words[k] for k in gaps]
        found = list(map(self.old_words.get, asked))
        new = iter(self._learn([w for w, i in zip(asked, found) if i is None]))
        found = [next(new) if i is None else i for i in found]
        self.by_word.update(zip(asked, found))
        self.held += ENTRY_BYTES * len(asked)
        for k, i in zip(gaps, found):
            ids[k] = i
        return ids

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Plain texts: every distinct word is looked up once, its ids are dealt to all its places."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        ids = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        dealt = pa.array(ids, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(dealt.buffers()[1], dtype=np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(dealt.buffers()[2] or b"")
        return [data[a:b].tobytes() for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        words = iter(self._encode_plain([t for t, p in zip(texts, plain) if p]))
        return [next(words) if p else self._pack(self.tokenizer.encode(t, add_special_tokens=False).ids)
                for t, p in zip(texts, plain)]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID,
                     with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, a row number and, on request, the ids themselves.

    ``tokenizer_path`` is read on the executors (default: ``word_bpe_49k.json`` of the public tokenizers).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        # one encoder per worker process: the vocabulary is read once, and what one task learned serves the next
        encoder, end = held(f"encoder {path}", lambda: Encoder(path)), np.array([end_id], dtype="<u4").tobytes()
        step = 4 * max_len
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_BYTES):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, b in zip(part.column("doc_id").to_pylist(),
                                encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                    b += end
                    for k, at in enumerate(range(0, len(b), step)):
                        cut = b[at:at + step]
                        doc.append(d), piece.append(k), start.append(at // 4), length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut)), ids.append(cut)
                out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                out.append(pa.array(np.arange(row, row + len(doc)), pa.int64()))
                row += len(doc)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)


class CapacityTree:
    """Segment tree over the capacities 0..size: which of them some open bin still has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, present: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, needed: int) -> int | None:
        """The smallest present capacity of at least ``needed``."""
        i = self.leaves + needed
        if not self.any[i]:
            while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> np.ndarray:
    """Best-fit decreasing for ``{length: count}``: rows (length, first rank, bin, pieces per bin, offset).

    Pieces of a length with ranks from ``first rank`` on (up to the next row of
    the length) fill consecutive bins from ``bin`` on.
    """
    tree, opened = CapacityTree(max_len), [[] for _ in range(max_len + 1)]   # capacity -> [first bin, bins]
    rows, bins = [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            opened[capacity].append((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                per, first = max_len // length, bins
                capacity, count = max_len, -(-left // per)
                bins += count
            else:
                per = capacity // length
                first, count = opened[capacity].pop()
                tree.set(capacity, bool(opened[capacity]))
            full = min(count, left // per)
            rest = left - full * per if full < count else 0   # one more bin takes what is left of the length
            rows.append((length, rank, first, per, max_len - capacity))
            put(capacity - per * length, first, full)
            if rest:
                put(capacity - rest * length, first + full, 1)
            used = full + bool(rest)
            put(capacity, first + used, count - used) if capacity < max_len else None
            left, rank = left - full * per - rest, rank + full * per + rest
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, max_len: int = MAX_LEN, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) with their sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}   # <= max_len rows
    plan = best_fit_plan(counts, max_len)
    # from Arrow: rows given as Python objects go through Python workers of their own, which stay on every executor
    salts = spark.createDataFrame(pa.table({"length": pa.array(counts.keys(), pa.int64()),
                                            "salts": pa.array([-(-n // rows_per_salt) for n in counts.values()], pa.int64())}))
    # the stored row number spreads repeated rows and rows without an id over the salts of their length too
    numbered = pieces if "row" in pieces.columns else pieces.withColumn("row", F.lit(0))
    salted = (numbered.join(F.broadcast(salts), "length")
              .withColumn("__hash", F.xxhash64("doc_id", "piece", "ids_crc32", "row"))
              .withColumn("__salt", F.pmod("__hash", "salts")).drop("salts"))
    before = (salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
              .withColumn("__before", F.sum("n").over(W.Window.partitionBy("length").orderBy("__salt")) - F.col("n"))
              .drop("n"))
    order = W.Window.partitionBy("length", "__salt").orderBy("__hash", "doc_id", "piece", "ids_crc32", "row")
    ranked = (salted.withColumn("__row", F.row_number().over(order) - 1).join(before, ["length", "__salt"])
              .withColumn("__rank", F.col("__before") + F.col("__row"))
              .drop("__before", "__row", "__salt", "__hash", "row"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()                                        # the encoder has done its work
        stride = int(plan[:, 1].max(initial=0)) + 1
        keys = -plan[:, 0] * stride + plan[:, 1]   # ascending: longest first, then rank
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            row = np.searchsorted(keys, -length * stride + np.minimum(rank, stride - 1), side="right") - 1
            _, r0, first, per, offset = plan[row].T
            names = [n for n in batch.schema.names if n != "__rank"]
            out = [batch.column(n) for n in names]
            out.append(pa.array(first + (rank - r0) // per))
            out.append(pa.array(offset + (rank - r0) % per * length))
            yield pa.RecordBatch.from_arrays(out, names + ["sequence_id", "offset"])

    fields = [f for f in ranked.schema.fields if f.name != "__rank"]
    schema = StructType(fields + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(tidy(place), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """Tokenise and pack; the pieces are written once into the shared folder, as several jobs read them."""
    return pack(materialise(tokenised_pieces(docs, tokenizer_path, max_len, end_id, with_ids), "pieces"), max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences of packed pieces with ids: sequence_id, ids (each at most ``max_len`` long)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
