"""Minimiser partitioning of long windows: equal windows meet in one bucket, packed.

Every window of ``width`` items (bytes or words) holds ``width - k + 1`` k-mers; the one
with the smallest hash (leftmost of equals) is its minimiser, which depends on the
window alone.  Consecutive windows with the same minimiser form a run, and the
text under a run travels as one packed string to the bucket of its minimiser, so
equal windows always meet.

A window can only repeat where its minimiser does.  So a first round sends nothing
but minimiser hashes (8 bytes a run), and marks each document's minimisers that
occur more than once anywhere; only runs with marked minimisers travel.

Copies are collapsed before each shuffle: of the equal hashes, and of the equal
segments, of one task's batch a single one travels; the others are answered on the
spot, as a segment that occurs twice repeats all of its windows.  A bucket gets at
most one entry per distinct segment and batch, however often a passage occurs.
Inside a bucket a minimiser whose entries are all one text is done by counting; only
minimisers with different texts go to the operator's own window matcher.

A minimiser in a common line or passage may have any number of different segments.  The first
round counts, and the runs of a minimiser with more than ``HOT_RUNS`` are cut by the
minimiser's offset in the window, each piece under a hash of the items that all its windows
share (:func:`refine`): equal windows meet again, others go to other buckets.  The more
runs, the finer the cut, down to single windows.  The list of these minimisers goes through
the driver, one of ``HOT_RUNS`` runs at most.  What a bucket gets of one hash beyond
``MATCH_BYTES`` is cut the same way before the matcher sees it, so a matcher's memory is bounded.

The documents are shuffled once: the exchange that brings the marks is used again when the
spans found are applied.  A document is known by its id and a hash of its text, so spans
never reach another text of the same id or another document without an id; places are
ordered by id, then by that hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from pitchside.llm.textops import (let_go, merge_spans, mix64, odd_powers, ranges, run_starts, small_batches, text_bytes, text_slices,
                                   tidy)

BATCH_BYTES = 1 << 20
MATCH_BYTES = 1 << 20        # text a matcher gets at once
HOT_RUNS = 4096              # runs of a minimiser beyond which they are cut before they travel
FINER = 4                    # times as many ranges of offsets from one cut to the next
HELD_BATCHES = 24            # slices whose hashes or segments are collapsed and packed together
LAST_ID = (1 << 63) - 1      # order of a null document id: after every other
KEYS = ["__doc", "__text_key"]
_FIELDS = (("doc", np.int64), ("key", np.int64), ("start", np.int32), ("windows", np.int32), ("size", np.int32), ("anchor", np.uint64),
           ("copies", np.uint8))
_DONE = (("done_doc", np.int64), ("done_key", np.int64), ("done_start", np.int32), ("done_end", np.int32))


@dataclass
class Items:
    """Flat items of a batch of texts: hashes of k items, and where each item lies in ``data``."""

    kmers: np.ndarray                 # hash of the k items from every item on
    first: np.ndarray                 # first item of every text, and the number of items
    data: bytes
    begin: np.ndarray | None = None   # first byte of every item in data (bytes: the item itself)
    end: np.ndarray | None = None     # end byte of every item in data

    def span(self, start: np.ndarray, stop: np.ndarray) -> tuple[list[int], list[int]]:
        """Byte spans of the items ``[start, stop)``."""
        if self.begin is None:
            return start.tolist(), stop.tolist()
        return self.begin[start].tolist(), self.end[stop - 1].tolist()


def sliding_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    if len(key) < width:
        return key[:0]
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def runs(items: Items, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First item, number of windows and minimiser hash of every run."""
    at, windows, place = _placed_runs(items, width, k)
    return at, windows, items.kmers[place]


def _placed_runs(items: Items, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First item, number of windows and place of the minimiser of every run."""
    low = np.uint64(0xFFFFFFFF)
    key = (items.kmers & ~low) | np.arange(len(items.kmers), dtype=np.uint64)
    least = sliding_minimum(key, width - k + 1)
    inside = np.ones(max(len(least), items.first[-1]), dtype=bool)
    stop = items.first[1:]
    outside = np.maximum(stop - width + 1, items.first[:-1])      # windows that would leave their text
    inside[ranges(outside, stop - outside)] = False
    window = np.flatnonzero(inside[:len(least)])
    at = (least[window] & low).astype(np.int64)
    first = run_starts(at)
    count = np.diff(np.append(first, len(at)))
    return window[first], count, at[first]


def refine(items: Items, at: np.ndarray, windows: np.ndarray, place: np.ndarray, width: int, k: int,
           classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut by the offset of their minimiser in the window, into ``classes`` ranges: run, first item, number of windows and
    hash of every piece, in their order.

    The hash is of the items that all windows of such a range share.  Equal windows have their minimiser at the same offset, so
    they get the same hash.
    """
    offsets = width - k + 1
    step = -(-offsets // classes)
    parts = []
    for low in range(0, offsets, step):
        high = min(low + step, offsets) - 1
        start, stop = np.maximum(at, place - high), np.minimum(at + windows, place - low + 1)
        run = np.flatnonzero(start < stop)
        shared = np.full(len(run), low, dtype=np.uint64)
        for j, p in enumerate(odd_powers(offsets - (high - low))):
            shared += items.kmers[place[run] - low + j] * p
        parts.append((run, start[run], (stop - start)[run], mix64(shared)))
    run, start, count, anchor = map(np.concatenate, zip(*parts))
    order = np.argsort(start, kind="stable")
    return run[order], start[order], count[order], anchor[order]


def hot_classes(times: int) -> int:
    """Ranges of offsets for a minimiser with ``times`` runs."""
    classes = FINER
    while times > HOT_RUNS * FINER * FINER:
        times, classes = times // (FINER * FINER), classes * FINER
    return classes


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _pack(parts: dict[str, np.ndarray], text: bytes) -> bytes:
    head = np.array([len(parts["doc"]), len(parts["done_doc"])], dtype=np.int64).tobytes()
    body = b"".join(parts[n].astype(t).tobytes() for n, t in _FIELDS + _DONE)
    return zstandard.compress(head + body + text, 3)


def _unpack(blob: bytes) -> tuple[dict[str, np.ndarray], memoryview]:
    raw = zstandard.decompress(blob)
    counts, at, parts = np.frombuffer(raw, dtype=np.int64, count=2), 16, {}
    for fields, n in ((_FIELDS, int(counts[0])), (_DONE, int(counts[1]))):
        for name, kind in fields:
            parts[name] = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += n * np.dtype(kind).itemsize
    return parts, memoryview(raw)[at:]


class _Segments:
    """Segments of several batches of one task, collapsed by their text."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.same: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, keys: np.ndarray, items: Items, width: int, k: int, marked: np.ndarray,
            hot: dict[int, np.ndarray]) -> None:
        """``hot``: minimisers whose runs are cut, by the number of ranges."""
        at, windows, place = _placed_runs(items, width, k)
        here = np.isin(items.kmers[place], marked)
        at, windows, place = at[here], windows[here], place[here]
        anchor, rest, parts = items.kmers[place], np.ones(len(at), dtype=bool), []
        for classes, some in hot.items():
            cut = np.isin(anchor, some)
            rest &= ~cut
            parts.append(refine(items, at[cut], windows[cut], place[cut], width, k, classes)[1:])
        at, windows, anchor = map(np.concatenate, zip((at[rest], windows[rest], anchor[rest]), *parts))
        owner = np.searchsorted(items.first, at, side="right") - 1
        data, seen = items.data, self.seen
        self.same.append(np.array([seen.setdefault(data[a:b], len(seen))
                                   for a, b in zip(*items.span(at, at + windows + width - 1))], dtype=np.int64))
        self.parts.append((ids[owner], keys[owner], at - items.first[owner], windows, anchor))

    def rows(self, buckets: int, width: int, first_only: bool) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob): one entry per distinct text, and the spans that are settled already."""
        same, (doc, key, start, windows, anchor) = np.concatenate(self.same), map(np.concatenate, zip(*self.parts))
        order = np.lexsort((start, key, doc, same))
        same, doc, key, start, windows, anchor = (x[order] for x in (same, doc, key, start, windows, anchor))
        head = run_starts(same)                          # the earliest of every text travels
        copies = np.diff(np.append(head, len(same)))
        sent = np.zeros(len(same), dtype=bool)
        sent[head] = True
        done = _elsewhere(head, same, doc, key, start) if first_only else copies[same] > 1
        bucket = _bucket(anchor, buckets)
        texts = list(self.seen)
        for b in np.unique(bucket):
            mine = bucket == b
            s, d = np.flatnonzero(mine & sent), np.flatnonzero(mine & done)
            some = [texts[j] for j in same[s].tolist()]
            yield int(b), _pack(
                {"doc": doc[s], "key": key[s], "start": start[s], "windows": windows[s], "size": np.array([len(t) for t in some]),
                 "anchor": anchor[s], "copies": np.minimum(copies[same[s]], 2), "done_doc": doc[d], "done_key": key[d],
                 "done_start": start[d], "done_end": start[d] + windows[d] + width - 1}, b"".join(some))


def _elsewhere(head: np.ndarray, same: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Entries of a text that lie at another place than its first one (a repeated row lies at the same place)."""
    first = head[same]
    return (doc != doc[first]) | (key != key[first]) | (start != start[first])


# a matcher gets the distinct segments of a bucket that share minimisers with others, in the order of their first
# occurrence, and the windows in each; it returns for all windows, segment after segment, whether the window occurs
# anywhere else among them, or only whether it occurs earlier
Matcher = Callable[[list[bytes], np.ndarray, bool], np.ndarray]


def _by_anchor(anchor: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in portions of at most ``MATCH_BYTES``, or a single minimiser, with whole minimisers (equal windows share theirs), in
    their order."""
    order = np.argsort(anchor, kind="stable")
    head = run_starts(anchor[order])
    cuts, held = [], 0
    for at, n in zip(head.tolist(), np.add.reduceat(size[order], head).tolist() if len(head) else ()):
        if held and held + n > MATCH_BYTES:
            cuts.append(at)
            held = 0
        held += n
    for part in np.split(order, cuts):
        yield np.sort(part)


@dataclass
class _Search:
    """How equal windows are found among texts."""

    items_of: Callable[[list[bytes]], Items]
    width: int
    k: int
    match: Matcher
    first_only: bool

    def among(self, texts: list[bytes], windows: np.ndarray, anchor: np.ndarray, classes: int = 1) -> np.ndarray:
        """What the matcher says of all windows of distinct texts; it gets portions of ``MATCH_BYTES``, and the texts of a
        minimiser with more than that are cut into pieces that share more."""
        first = np.cumsum(windows) - windows
        hit = np.empty(int(windows.sum()), dtype=bool)
        for some in _by_anchor(anchor, np.array([len(t) for t in texts], dtype=np.int64)):
            got = [texts[j] for j in some.tolist()]
            if classes <= self.width - self.k and sum(map(len, got)) > MATCH_BYTES:
                found = self._in_pieces(got, windows[some], classes * FINER)
            else:                                       # at the end a hash has the copies of one window
                found = self.match(got, windows[some], self.first_only)
            hit[ranges(first[some], windows[some])] = found
        return hit

    def _in_pieces(self, texts: list[bytes], windows: np.ndarray, classes: int) -> np.ndarray:
        seen: dict[bytes, int] = {}
        parts, same = [], []
        size = np.cumsum([len(t) for t in texts])
        for part in np.split(np.arange(len(texts)), run_starts(size // BATCH_BYTES)[1:]):
            items = self.items_of([texts[j] for j in part.tolist()])
            at, n, place = _placed_runs(items, self.width, self.k)      # a text is one run
            run, start, n, anchor = refine(items, at, n, place, self.width, self.k, classes)
            same += [seen.setdefault(items.data[a:b], len(seen)) for a, b in zip(*items.span(start, start + n + self.width - 1))]
            parts.append((part[run], start - at[run], n, anchor))
        of, start, n, anchor = map(np.concatenate, zip(*parts))
        same, copies = np.array(same, dtype=np.int64), np.bincount(same)
        head = np.full(len(seen), -1, dtype=np.int64)
        head[same[::-1]] = np.arange(len(same))[::-1]                   # first piece of every distinct text
        found = self.among(list(seen), n[head], anchor[head], classes)
        known = (head[same] != np.arange(len(same))) if self.first_only else copies[same] > 1
        first, begin = np.cumsum(windows) - windows, np.cumsum(n[head]) - n[head]
        hit = np.empty(int(windows.sum()), dtype=bool)
        hit[ranges(first[of] + start, n)] = found[ranges(begin[same], n)] | np.repeat(known, n)
        return hit


def _solve(blobs: list[bytes], search: _Search):
    """Spans (doc, text key, start, end) of repeated windows of one bucket."""
    width, first_only = search.width, search.first_only
    parts, texts = zip(*[_unpack(b) for b in blobs])
    e = {n: np.concatenate([p[n] for p in parts]) for n, _ in _FIELDS + _DONE}
    spans = [(e["done_doc"], e["done_key"], e["done_start"].astype(np.int64), e["done_end"].astype(np.int64))]
    source = np.repeat(np.arange(len(parts)), [len(p["doc"]) for p in parts])
    offset = np.concatenate([np.cumsum(p["size"].astype(np.int64)) - p["size"] for p in parts])
    _, group, per_group = np.unique(e["anchor"], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(per_group[group] > 1)
    shared = shared[np.lexsort((e["start"][shared], e["key"][shared], e["doc"][shared]))]
    seen: dict[bytes, int] = {}
    same = np.array([seen.setdefault(bytes(texts[source[j]][offset[j]:offset[j] + e["size"][j]]), len(seen))
                     for j in shared.tolist()], dtype=np.int64)
    if len(shared):
        distinct = list(seen)
        head = np.full(len(distinct), -1, dtype=np.int64)
        head[same[::-1]] = np.arange(len(same))[::-1]            # first entry of every distinct text
        total = np.bincount(same, weights=e["copies"][shared]).astype(np.int64)
        whole = (_elsewhere(head, same, e["doc"][shared], e["key"][shared], e["start"][shared]) if first_only
                 else (total[same] > 1) & (e["copies"][shared] < 2))
        j = shared[whole]
        spans.append((e["doc"][j], e["key"][j], e["start"][j].astype(np.int64), e["start"][j].astype(np.int64) + e["windows"][j] + width - 1))
        # texts that share their minimiser with another text
        of_text = group[shared[head]]
        mixed = np.flatnonzero(np.bincount(of_text, minlength=len(per_group))[of_text] > 1)
        if len(mixed):
            windows = e["windows"][shared[head[mixed]]].astype(np.int64)
            first = np.cumsum(windows) - windows
            hit = search.among([distinct[m] for m in mixed.tolist()], windows, of_text[mixed])
            # entries to answer: the first of each text; a text known to repeat as a whole is answered already
            entry = shared[head[mixed]]
            open_ = np.ones(len(mixed), dtype=bool) if first_only else (total[mixed] < 2)
            w_entry = np.repeat(np.arange(len(mixed)), windows)
            w_place = np.arange(len(hit)) - np.repeat(first, windows)
            ok = hit & open_[w_entry]
            w_entry, w_place = w_entry[ok], w_place[ok]
            new = np.ones(len(w_entry), dtype=bool)
            new[1:] = (w_entry[1:] != w_entry[:-1]) | (w_place[1:] != w_place[:-1] + 1)
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(w_entry))[:len(at)] - 1
            j = entry[w_entry[at]]
            spans.append((e["doc"][j], e["key"][j], e["start"][j] + w_place[at], e["start"][j] + w_place[last] + width))
    return [np.concatenate(x) for x in zip(*spans)]


class _Anchors:
    """Minimiser hashes of several batches of one task, one entry per hash."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, keys: np.ndarray, items: Items, width: int, k: int) -> None:
        at, _, anchor = runs(items, width, k)
        owner = np.searchsorted(items.first, at, side="right") - 1
        self.parts.append((anchor, ids[owner], keys[owner]))

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob): hash, document and how often it occurs in the batch; and marks that are settled already."""
        anchor, doc, key = map(np.concatenate, zip(*self.parts))
        order = np.argsort(anchor, kind="stable")
        anchor, doc, key = anchor[order], doc[order], key[order]
        head = run_starts(anchor)
        times = np.diff(np.append(head, len(anchor)))
        of = np.repeat(times > 1, times)
        bucket, settled = _bucket(anchor[head], buckets), (doc ^ key) % buckets   # settled marks are only passed on: by document
        for b in range(buckets):
            h = head[bucket == b]
            d = np.flatnonzero(of & (settled == b))
            if len(h) or len(d):
                parts = (anchor[h], doc[h], key[h], times[bucket == b].astype(np.int32), anchor[d], doc[d], key[d])
                sizes = np.array([len(h), len(d)], dtype=np.int64).tobytes()
                yield b, zstandard.compress(sizes + b"".join(p.tobytes() for p in parts), 1)


def _marks(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, text key, hash) of every minimiser of a bucket that occurs more than once; hash and count of those with more
    than ``HOT_RUNS`` runs."""
    parts = []
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n, d = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
        cut = np.cumsum([16, 8 * n, 8 * n, 8 * n, 4 * n, 8 * d, 8 * d]).tolist()
        kinds = (np.uint64, np.int64, np.int64, np.int32, np.uint64, np.int64, np.int64)
        parts.append([np.frombuffer(raw, dtype=t, count=c, offset=o) for t, c, o in zip(kinds, (n, n, n, n, d, d, d), cut)])
    anchor, doc, key, times, done_anchor, done_doc, done_key = map(np.concatenate, zip(*parts))
    value, group = np.unique(anchor, return_inverse=True)
    total = np.bincount(group, weights=times, minlength=len(value)).astype(np.int64)
    new = (total[group] > 1) & (times == 1)
    hot = total > HOT_RUNS
    return (np.concatenate([doc[new], done_doc]), np.concatenate([key[new], done_key]),
            np.concatenate([anchor[new], done_anchor]), value[hot], total[hot])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    by: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            by.setdefault(b, []).append(blob)
    for b in sorted(by):
        yield by.pop(b)


def repeated_spans(docs: DataFrame, items_of: Callable[[list[bytes]], Items], width: int, k: int, match: Matcher,
                   first_only: bool) -> DataFrame:
    """(__doc, __text_key, __spans) of all documents with repeated windows, from ``docs`` as :func:`keyed` makes them: item
    spans.

    ``first_only``: a window counts as repeated only where it occurs earlier (smaller id, then text key, or same document
    and earlier start).
    """
    small_batches(docs.sparkSession)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["bucket", "blob"]
    search = _Search(items_of, width, k, match, first_only)

    def packed(batches: Iterator[pa.RecordBatch], new: Callable, add: Callable, rows: Callable) -> Iterator[pa.RecordBatch]:
        def flushed(held) -> Iterator[pa.RecordBatch]:
            for b, blob in rows(held):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names)

        let_go()
        held, n_held = new(), 0
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_BYTES):
                ids, keys = (part.column(n).to_numpy(zero_copy_only=False) for n in KEYS)
                add(held, part, ids, keys, items_of(list(text_bytes(part.column("text")))))
                n_held += 1
                if n_held == HELD_BATCHES:
                    yield from flushed(held)
                    held, n_held = new(), 0
        if n_held:
            yield from flushed(held)

    def scatter_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(batches, _Anchors, lambda held, part, ids, keys, items: held.add(ids, keys, items, width, k),
                      lambda held: held.rows(buckets))

    def gather_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches):
            doc, key, anchor, hot, times = _marks(blobs)
            none = pa.nulls(len(hot), pa.int64())
            for columns in ((pa.array(doc), pa.array(key), pa.array(anchor.view(np.int64)), pa.nulls(len(doc), pa.int64())),
                            (none, none, pa.array(hot.view(np.int64)), pa.array(times))):
                yield pa.RecordBatch.from_arrays(list(columns), [*KEYS, "mark", "times"])

    def scatter_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(held: _Segments, part: pa.RecordBatch, ids: np.ndarray, keys: np.ndarray, items: Items) -> None:
            marked = part.column("__marks").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held.add(ids, keys, items, width, k, np.unique(marked), hot)

        return packed(batches, _Segments, add, lambda held: held.rows(buckets, width, first_only))

    def gather_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches):
            doc, key, start, end = _solve(blobs, search)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(start, pa.int64()),
                                                  pa.array(end, pa.int64())], [*KEYS, "start", "end"])

    # kept on the executors' disks, not in files: Hadoop starts a process for the rights of every file it makes, which for a
    # moment holds the executor's memory a second time
    counted = (docs.select(*KEYS, "text").mapInArrow(tidy(scatter_anchors), "bucket int, blob binary")
               .repartitionById(buckets, "bucket")
               .mapInArrow(tidy(gather_anchors), "__doc long, __text_key long, mark long, times long").persist(StorageLevel.DISK_ONLY))
    by_classes: dict[int, list[int]] = {}
    for r in counted.where("times is not null").select("mark", "times").collect():
        by_classes.setdefault(hot_classes(r.times), []).append(r.mark)
    hot = {c: np.array(sorted(some), dtype=np.int64).view(np.uint64) for c, some in by_classes.items()}
    marks = counted.where("times is null").groupBy(*KEYS).agg(F.collect_list("mark").alias("__marks"))
    found = (docs.join(marks, KEYS).mapInArrow(tidy(scatter_segments), "bucket int, blob binary")
             .repartitionById(buckets, "bucket").mapInArrow(tidy(gather_segments), "__doc long, __text_key long, start long, end long"))
    return found.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the document's place in the order of ids as ``__doc`` and a hash of its text as ``__text_key``."""
    return (docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
            .withColumn("__text_key", F.xxhash64(F.coalesce("text", F.lit("")))))


def with_spans(docs: DataFrame, spans: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with the spans that ``spans`` finds in them as ``__spans`` (null where there are none)."""
    rows = keyed(docs)
    return rows.join(spans(rows), KEYS, "left").drop(*KEYS)


def united(spans) -> tuple[np.ndarray, np.ndarray]:
    """Maximal disjoint runs of a document's list of span records."""
    if not spans:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    start = np.array([s["start"] for s in spans], dtype=np.int64)
    return merge_spans(start, np.array([s["end"] for s in spans], dtype=np.int64))


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Mask of ``n`` items: inside a span."""
    out = np.zeros(n, dtype=bool)
    end = np.minimum(end, n)
    ok = start < end
    out[ranges(start[ok], (end - start)[ok])] = True
    return out
