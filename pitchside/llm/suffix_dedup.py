"""Repeated byte strings by longest-previous-factor arrays.

Windows of ``width`` bytes meet in buckets by minimiser (:mod:`superkmers`).  There a
suffix array over the bucket's distinct segments is built to the depth of a window
(prefix doubling), neighbours get their longest common prefixes, and the previous
and the next smaller position in suffix order give every position's longest
previous factor: the longest match that begins earlier.  A window that has a
previous factor of its whole width is a later copy.

Two readings: ``keep_first=True`` removes later copies and keeps the first;
``keep_first=False`` removes every byte under a window that also starts anywhere else:
the places where the factors begin are marked as well.  Matches never cross documents and are
judged on the input.

Defined cases: a null text is empty; texts shorter than a window lose nothing; rows
that share a ``doc_id`` and their text get the same result, as one place; different texts
under one id are different documents, ordered by a hash of the text; null ids sort last
and are told apart by their texts alone; an empty table gives an empty result; :func:`dedup` keeps further columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from pitchside.llm.superkmers import Items, covered, repeated_spans, united, with_spans
from pitchside.llm.textops import _BYTE_VALUE, mix64, odd_powers, tidy

WIDTH = 200
KMER = 24


def byte_items(texts: list[bytes]) -> Items:
    data = b"".join(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    power = odd_powers(17)
    one = _BYTE_VALUE[np.frombuffer(data, dtype=np.uint8)]
    by_span, span = {1: one}, 1
    while span < 16:                                    # hashes of 2, 4, 8 and 16 bytes by doubling
        h = by_span[span]
        by_span[2 * span] = h[:-span] * power[span] + h[span:] if len(h) > span else h[:0]
        span *= 2
    eight, sixteen = by_span[8], by_span[16]
    n = max(len(one) - KMER + 1, 0)
    kmers = mix64(sixteen[:n] * power[8] + eight[16:16 + n])
    return Items(kmers, np.concatenate(([0], np.cumsum(size))), data)


def suffix_order(text: np.ndarray, unique: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions in the order of their first ``depth`` bytes, and ranks by the first 8, 16, ... bytes.

    Positions flagged ``unique`` differ from every other one: strings never run past them.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    word = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j:j + n]
    _, rank = np.unique(word, return_inverse=True)
    rank = rank.astype(np.int64)
    ends = np.flatnonzero(unique)
    rank[ends] = n + np.arange(len(ends))
    _, rank = np.unique(rank, return_inverse=True)
    kind = np.int32 if n < 1 << 31 else np.int64        # ranks as they are kept, of every level
    levels, have = [(8, rank.astype(kind))], 8
    while have < depth:
        step = min(have, depth - have)                  # the last level may overlap the one before
        pair = rank * (2 * n + 2)
        pair[:n - step] += rank[step:] + 1
        _, rank = np.unique(pair, return_inverse=True)
        have += step
        levels.append((have, rank.astype(kind)))
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Longest common prefix of the strings at ``a`` and ``b``, as far as the ranks tell: 0 or the span of a level."""
    out = np.zeros(len(a), dtype=np.int64)
    for span, rank in levels:
        out[rank[a] == rank[b]] = span
    return out


def _to_smaller(position: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in suffix order: common prefix with the nearest entry before that has a smaller position, and that entry
    (-1: none).

    ``near`` is the common prefix with the entry just before.  Pointers jump over entries with larger positions; every
    entry between an entry and its pointer is larger than the entry itself, so pointers may be followed from
    pointer to pointer and settle after about log n rounds.
    """
    n = len(position)
    to, least = np.arange(-1, n - 1), near.copy()
    todo = np.flatnonzero((to >= 0) & (position[np.maximum(to, 0)] > position))
    while len(todo):
        via = to[todo]
        hop, low = to[via], np.minimum(least[todo], least[via])   # both read before either is written
        to[todo], least[todo] = hop, low
        todo = todo[(hop >= 0) & (position[np.maximum(hop, 0)] > position[todo])]
    least[to < 0] = 0
    return least, to


def _previous(position: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per entry in suffix order: longest match and entry of the next smaller position before it, and the same after it."""
    before, b = _to_smaller(position, near)
    after, a = _to_smaller(position[::-1], np.concatenate((near[:1] * 0, near[:0:-1])))
    return before, b, after[::-1], np.where(a >= 0, len(a) - 1 - a, -1)[::-1]


def longest_previous_factors(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For every position the longest match (see :func:`common_prefixes`) that begins earlier."""
    near = np.concatenate(([0], common_prefixes(order[:-1], order[1:], levels)))
    before, _, after, _ = _previous(order, near)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


def repeated_positions(order: np.ndarray, levels: list[tuple[int, np.ndarray]], width: int, first_only: bool) -> np.ndarray:
    """Mask of positions whose ``width`` bytes occur earlier; without ``first_only`` also of those they occur at first.

    The factor arrays are taken over the entries that share ``width`` bytes with a neighbour in suffix order, as no other
    entry has a factor that long; equal windows are neighbours, so no pair of them is parted.  Of equal windows
    the smallest position has no earlier match, but is the next smaller position of the entry beside it: it is found as
    the place where that entry's factor begins.
    """
    out = np.zeros(len(order), dtype=bool)
    if not len(order):
        return out
    near = np.concatenate(([0], common_prefixes(order[:-1], order[1:], levels)))
    able = near >= width
    able[:-1] |= near[1:] >= width
    some = order[able]
    before, b, after, a = _previous(some, np.where(near[able] >= width, width, 0))
    for match, source in ((before, b), (after, a)):
        found = match >= width
        out[some[found]] = True
        if not first_only:
            out[some[source[found]]] = True
    return out


def matcher(width: int):
    def match(segments: list[bytes], windows: np.ndarray, first_only: bool) -> np.ndarray:
        text = np.frombuffer(b"".join(segments), dtype=np.uint8)
        size = np.array([len(s) for s in segments], dtype=np.int64)
        first = np.cumsum(size) - size
        left = np.repeat(first + size, size) - np.arange(len(text))
        order, levels = suffix_order(text, left < 8, width)
        return repeated_positions(order, levels, width, first_only)[left >= width]

    return match


def repeated_bytes(docs: DataFrame, width: int = WIDTH, keep_first: bool = True) -> DataFrame:
    """(__doc, __text_key, __spans): byte spans to remove, for the documents (:func:`superkmers.keyed`) that have any."""
    return repeated_spans(docs, byte_items, width, KMER, matcher(width), keep_first)


def removals(docs: DataFrame, width: int = WIDTH, keep_first: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every row."""
    marked = with_spans(docs.select("doc_id", "text"), lambda rows: repeated_bytes(rows, width, keep_first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
        for batch in batches:
            n_bytes, n_removed, n_spans, kept, digest = [], [], [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for t, spans in zip(texts, batch.column("__spans").to_pylist()):
                t = t or b""
                start, end = united(spans)
                end = np.minimum(end, len(t))
                start, end = start[start < end], end[start < end]
                cuts = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(t)]
                rest = b"".join([t[a:b] for a, b in zip(cuts[::2], cuts[1::2])])
                n_bytes.append(len(t)), n_removed.append(len(t) - len(rest)), n_spans.append(len(start))
                kept.append(rest), digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], names)

    schema = StructType([docs.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
                         StructField("n_spans", LongType()), StructField("kept", BinaryType()),
                         StructField("kept_sha256", StringType())])
    return marked.mapInArrow(tidy(run), schema)


def dedup(docs: DataFrame, width: int = WIDTH, keep_first: bool = True) -> DataFrame:
    """``docs`` with its texts cut (whole characters: one that loses a byte goes whole) and ``n_chars`` renewed if there.

    A document that held text and has nothing but white space left is dropped.
    """
    marked = with_spans(docs, lambda rows: repeated_bytes(rows, width, keep_first))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = batch.column("__spans").to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for j, s in enumerate(spans):
                if s and texts[j] is not None:
                    raw = np.frombuffer(texts[j].encode(), dtype=np.uint8)
                    gone = covered(*united(s), len(raw))
                    char = np.cumsum((raw & 0xC0) != 0x80) - 1          # character of every byte
                    gone = np.bincount(char, weights=gone)[char] > 0
                    texts[j] = raw[~gone].tobytes().decode()
                    keep[j] = bool(texts[j].strip())
            out = []
            for n in names:
                if n == "text":
                    out.append(pa.array(texts, pa.string()))
                elif n == "n_chars":
                    changed = pa.array([len(t) if s and t is not None else None for t, s in zip(texts, spans)], pa.int64())
                    out.append(pc.coalesce(changed, batch.column(n).cast(pa.int64())).cast(batch.column(n).type))
                else:
                    out.append(batch.column(n))
            yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(keep))

    return marked.mapInArrow(tidy(run), StructType(docs.schema.fields))
