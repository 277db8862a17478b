r"""Repeated word windows by super-k-mer partitioning.

Words are ``[^\x20\x09-\x0D]+``, unchanged.  Consecutive windows of ``width`` words that
share a minimiser travel as one packed string (words joined by one space) to the
minimiser's bucket (:mod:`superkmers`); in the bucket the windows of texts that share a
minimiser are sorted as rows of word numbers, so equal windows become neighbours and
are counted exactly.

A window whose words also start earlier (smaller ``doc_id``, or the same document and
an earlier start) is repeated; every word under a repeated window goes.  Windows are
judged on the input.

Defined cases: a null text has no words; texts shorter than a window lose nothing;
rows that share a ``doc_id`` and their text are one place and get the same result;
different texts under one id are different documents, ordered by a hash of the text; null
ids sort last and are told apart by their texts alone; an empty table gives an empty
result; further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pitchside.llm.superkmers import Items, covered, repeated_spans, united, with_spans
from pitchside.llm.textops import gram_hashes, ranges, text_bytes, text_slices, word_hashes, word_spans

WIDTH = 20
KMER = 5
BATCH_BYTES = 4 << 20


def word_items(texts: list[bytes]) -> Items:
    """Words of all texts, packed with one space after each."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    start, end = word_spans(data)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    size = end - start
    packed = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
    begin = np.cumsum(size + 1) - (size + 1)
    packed[ranges(begin, size)] = data[ranges(start, size)]
    words = np.bincount(owner, minlength=len(texts))
    return Items(gram_hashes(word_hashes(data, start, end), KMER), np.concatenate(([0], np.cumsum(words))), packed.tobytes(),
                 begin, begin + size)


def matcher(width: int):
    def match(segments: list[bytes], windows: np.ndarray, first_only: bool) -> np.ndarray:
        words = [s.split(b" ") for s in segments]
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], dtype=np.int32)
        size = np.array([len(ws) for ws in words], dtype=np.int64)
        at = ranges(np.cumsum(size) - size, windows)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, width)[at])
        keys = rows.view(np.dtype((np.void, width * 4))).ravel()
        order = np.argsort(keys, kind="stable")          # equal windows keep their order of occurrence
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
        out = np.empty(len(order), dtype=bool)
        if first_only:
            out[order] = ~new
        else:
            last = np.append(new[1:], True)
            out[order] = ~(new & last)
        return out

    return match


def repeated_words(docs: DataFrame, width: int = WIDTH, keep_first: bool = True) -> DataFrame:
    """(__doc, __text_key, __spans): word spans to remove, for the documents (:func:`superkmers.keyed`) that have any."""
    return repeated_spans(docs, word_items, width, KMER, matcher(width), keep_first)


def removals(docs: DataFrame, width: int = WIDTH, keep_first: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (remaining words joined by one space) and kept_sha256 of every row."""
    marked = with_spans(docs.select("doc_id", "text"), lambda rows: repeated_words(rows, width, keep_first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_BYTES):
                texts = list(text_bytes(part.column("text")))
                items = word_items(texts)
                first, words = items.first[:-1], np.diff(items.first)
                packed = np.frombuffer(items.data, dtype=np.uint8)
                gone, kept, digest = [], [], []
                for j, spans in enumerate(part.column("__spans").to_pylist()):
                    n = int(words[j])
                    lo = int(items.begin[first[j]]) if n else 0
                    hi = int(items.end[first[j] + n - 1]) if n else 0
                    rest = items.data[lo:hi]
                    removed = 0
                    if spans:
                        mask = covered(*united(spans), n)
                        removed = int(mask.sum())
                        stay = first[j] + np.flatnonzero(~mask)
                        rest = packed[ranges(items.begin[stay], items.end[stay] - items.begin[stay] + 1)].tobytes()[:-1]
                    gone.append(removed), kept.append(rest), digest.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())], names)

    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept", StringType()), StructField("kept_sha256", StringType())])
    return marked.mapInArrow(run, schema)
