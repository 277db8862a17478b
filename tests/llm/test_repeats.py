"""Repeated bytes (7) and repeated word windows (8) against brute force on small rows."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from pitchside.llm import suffix_dedup, superkmers, window_dedup


def brute_bytes(docs, width, keep_first):
    """doc_id -> removed positions; docs: list of (doc_id, bytes)."""
    seen = {}
    for d, t in sorted(docs):
        for i in range(len(t) - width + 1):
            seen.setdefault(t[i:i + width], []).append((d, i))
    gone = {d: set() for d, _ in docs}
    for places in seen.values():
        first = min(places)
        for d, i in places:
            if (d, i) != first if keep_first else len(places) > 1:
                gone[d] |= set(range(i, i + width))
    return gone


def rows(seed, n=40, width=200):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(width // 2, 3 * width))) for _ in range(5)]
    out = []
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.5:
                parts.append("".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 300))))
            elif kind < 0.9:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 3)
                parts.append(p[a:a + rng.randint(1, len(p))])
            else:
                parts.append(rng.choice(["ab", "x", "la "]) * rng.randint(1, 300))
        out.append((d * 3, "".join(parts)))
    out += [(1000, out[3][1]), (1001, out[3][1] + "!"), (1002, None), (1003, "")]
    return out


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bytes_against_brute_force(spark, monkeypatch, seed, keep_first):
    data = rows(seed)
    got = {r.doc_id: r for r in suffix_dedup.removals(
        spark.createDataFrame(data, "doc_id long, text string").repartition(3), keep_first=keep_first).collect()}
    gone = brute_bytes([(d, (t or "").encode()) for d, t in data], 200, keep_first)
    assert len(got) == len(data)
    for d, t in data:
        raw = (t or "").encode()
        kept = bytes(b for i, b in enumerate(raw) if i not in gone[d])
        spans = sum(1 for i in gone[d] if i - 1 not in gone[d])
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(raw), len(raw) - len(kept), spans), d
        assert got[d].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_longest_previous_factors_against_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        text = np.array([rng.randint(97, 98) for _ in range(rng.randint(20, 120))], dtype=np.uint8)
        n, depth = len(text), 16
        left = n - np.arange(n)
        order, levels = suffix_dedup.suffix_order(text, left < 8, depth)
        got = suffix_dedup.longest_previous_factors(order, levels)
        raw = text.tobytes()
        for i in range(n):
            want = max((s for s in (8, 16) for j in range(i) if left[i] >= s and raw[i:i + s] == raw[j:j + s]), default=0)
            assert got[i] == want, (i, got[i], want)


def test_repeated_positions_against_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(4)]
        raw = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6))).encode()
        text = np.frombuffer(raw, dtype=np.uint8)
        left = len(text) - np.arange(len(text))
        for width in (8, 11, 16):
            order, levels = suffix_dedup.suffix_order(text, left < 8, width)
            at = {}
            for i in range(len(raw) - width + 1):
                at.setdefault(raw[i:i + width], []).append(i)
            for first_only in (True, False):
                got = suffix_dedup.repeated_positions(order, levels, width, first_only)
                want = {i for places in at.values() for i in (places[1:] if first_only else places if len(places) > 1 else [])}
                assert set(np.flatnonzero(got & (left >= width)).tolist()) == want


def test_runs_cover_every_window_once():
    texts = [b"abcabcabc" * 60, b"", b"x" * 199, b"y" * 200, bytes(range(256)) * 4]
    items = suffix_dedup.byte_items(texts)
    at, windows, _ = superkmers.runs(items, 200, suffix_dedup.KMER)
    seen = sorted((int(d), int(a - items.first[d]) + j) for a, w in zip(at, windows) for j in range(w)
                  for d in [np.searchsorted(items.first, a, side="right") - 1])
    assert seen == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 199)]


def test_repeated_rows_nulls_and_extra_columns(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefg ") for _ in range(500))
    docs = spark.createDataFrame([(1, text, "a", 500), (1, text, "a", 500), (None, None, "b", 0), (4, "éè" * 20 + text, None, 540)],
                                 "doc_id long, text string, spans string, n_chars long")
    out = {(r.doc_id, r.spans): r for r in suffix_dedup.dedup(docs).collect()}
    assert set(out) == {(1, "a"), (None, "b"), (4, None)}
    assert out[(1, "a")].text == text                      # two rows of one id are one place: nothing is earlier
    assert out[(4, None)].text == "éè" * 20 and out[(4, None)].n_chars == 40
    assert suffix_dedup.dedup(docs.limit(0)).columns == docs.columns
    assert suffix_dedup.removals(docs.limit(0)).count() == 0


def brute_words(docs, width):
    """doc_id -> (words, removed positions) where the window also starts earlier."""
    seen, words = {}, {d: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for d, t in docs}
    gone = {d: set() for d in words}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            key = tuple(words[d][i:i + width])
            if seen.setdefault(key, (d, i)) != (d, i):
                gone[d] |= set(range(i, i + width))
    return words, gone


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_words_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "cé", "dd", "e,", "\u00a0f", "G."]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 70))] for _ in range(5)]
    data = []
    for d in range(50):
        out = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
            a = rng.randint(0, len(p) // 2)
            out += p[a:a + rng.randint(0, len(p))] * rng.choice([1, 1, 1, 2])
        data.append((d * 2, rng.choice(["", " "]) + rng.choice([" ", "\n", "\t \x0b"]).join(out)))
    data += [(500, data[7][1]), (501, None), (502, ""), (503, " \n "), (504, "w " * 300)]
    got = {r.doc_id: r for r in window_dedup.removals(
        spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    words, gone = brute_words(data, 20)
    for d, _ in data:
        kept = " ".join(w for i, w in enumerate(words[d]) if i not in gone[d])
        assert (got[d].n_words, got[d].n_removed) == (len(words[d]), len(gone[d])), d
        assert got[d].kept == kept and got[d].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_words_of_repeated_rows_and_empty_tables(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefg") for _ in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 9, r.n_removed) for r in window_dedup.removals(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 60), (9, 60)]
    assert window_dedup.removals(docs.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_spans_stay_with_their_text(spark, doc_id):
    """Documents without an id, or different texts under one id: each loses its own repeats and nothing else."""
    rng = random.Random(21)
    letters = "".join(rng.choice("abcdefghijklm ") for _ in range(1200))
    passage, clean, other = letters[:400], letters[400:800], letters[800:]
    docs = spark.createDataFrame([(1, passage), (doc_id, passage + "?" + other), (doc_id, clean), (doc_id, None)],
                                 "doc_id long, text string").repartition(2)
    assert sorted(r.text or "" for r in suffix_dedup.dedup(docs).collect()) == sorted([passage, "?" + other, clean, ""])
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.removals(docs, keep_first=False).collect())
    assert got == [(0, 0), (400, 0), (400, 400), (801, 400)]

    words = [f"w{j}" for j in range(90)]
    a, b, c = (" ".join(words[i:i + 30]) for i in (0, 30, 60))
    docs = spark.createDataFrame([(1, a), (doc_id, f"{a} {b}"), (doc_id, c)], "doc_id long, text string")
    assert sorted(r.kept for r in window_dedup.removals(docs).collect()) == sorted([a, b, c])
    # the same passage at the same offset of two such documents is at two places: one of them goes
    docs = spark.createDataFrame([(doc_id, f"{a} {b}"), (doc_id, f"{a} {c}")], "doc_id long, text string")
    assert sorted(r.n_removed for r in window_dedup.removals(docs).collect()) == [0, 30]


def test_matchers_get_whole_minimisers_in_portions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    anchor, size = rng.integers(0, 30, 400), rng.integers(200, 400, 400)
    monkeypatch.setattr(superkmers, "MATCH_BYTES", 5000)
    parts = list(superkmers._by_anchor(anchor, size))
    assert sorted(np.concatenate(parts).tolist()) == list(range(400)) and len(parts) > 5
    assert sum(len(set(anchor[p])) for p in parts) == len(set(anchor))
    assert all((np.diff(p) > 0).all() for p in parts)


def test_a_portion_is_matched_in_bounded_memory():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 110, 3000, dtype=np.uint8)
    segments = [base[a:a + 400].tobytes() for a in rng.integers(0, 2500, superkmers.MATCH_BYTES // 400)]
    match, windows = suffix_dedup.matcher(200), np.full(len(segments), 201)
    tracemalloc.start()
    try:
        hit = match(segments, windows, True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    seen, expected = set(), []                          # a window of the base is known by its place
    for s in segments:
        at = base.tobytes().find(s)
        expected += [p in seen for p in range(at, at + 201)]
        seen.update(range(at, at + 201))
    assert hit.tolist() == expected
    assert peak < 160 << 20


def in_buckets(docs, items_of, width, k, matcher, first_only, buckets=5):
    """doc -> removed items, by the steps of the two rounds without Spark; every two documents are a batch."""
    batches = [docs[j:j + 2] for j in range(0, len(docs), 2)]
    ids = [np.array([d for d, _ in b]) for b in batches]
    items = [items_of([t for _, t in b]) for b in batches]

    def dealt(rows):
        by = {}
        for b, blob in rows:
            by.setdefault(b, []).append(blob)
        return by.values()

    sent = []
    for i, it in zip(ids, items):
        held = superkmers._Anchors()
        held.add(i, i * 0, it, width, k)
        sent += held.rows(buckets)
    marks, hot = {}, {}
    for blobs in dealt(sent):
        doc, _, anchor, value, times = superkmers._marks(blobs)
        for d, a in zip(doc.tolist(), anchor.tolist()):
            marks.setdefault(d, set()).add(a)
        for a, n in zip(value.tolist(), times.tolist()):
            hot.setdefault(superkmers.hot_classes(n), []).append(a)
    hot = {c: np.array(a, dtype=np.uint64) for c, a in hot.items()}
    sent = []
    for i, it in zip(ids, items):
        held = superkmers._Segments()
        marked = np.array(sorted(set().union(*(marks.get(d, set()) for d in i.tolist()))), dtype=np.uint64)
        held.add(i, i * 0, it, width, k, marked, hot)
        sent += held.rows(buckets, width, first_only)
    gone = {d: set() for d, _ in docs}
    for blobs in dealt(sent):
        spans = superkmers._solve(blobs, superkmers._Search(items_of, width, k, matcher(width), first_only))
        for d, _, a, b in zip(*(x.tolist() for x in spans)):
            gone[d] |= set(range(a, b))
    return gone, hot


@pytest.mark.parametrize("first_only", [True, False])
@pytest.mark.parametrize("hot_runs", [1, 6, 10_000])
@pytest.mark.parametrize("match_bytes", [60, 400])
def test_hot_minimisers_are_cut_exactly(monkeypatch, first_only, hot_runs, match_bytes):
    """A line and a passage in most documents: minimisers are cut before they travel, in their bucket, or both."""
    monkeypatch.setattr(superkmers, "HOT_RUNS", hot_runs)
    monkeypatch.setattr(superkmers, "MATCH_BYTES", match_bytes)
    rng = random.Random(17)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = own(30), own(120)
    docs = []
    for d in range(30):
        parts = [own(rng.randint(0, 60)), line, own(rng.randint(0, 9)), line, passage[rng.randint(0, 20):], own(5), "ab" * 40]
        rng.shuffle(parts)
        docs.append((d, "".join(parts[:rng.randint(1, 7)]).encode()))
    docs.append((30, docs[4][1] + b"!"))
    gone, hot = in_buckets(docs, suffix_dedup.byte_items, 48, suffix_dedup.KMER, suffix_dedup.matcher, first_only)
    assert gone == brute_bytes(docs, 48, first_only)
    assert bool(hot) == (hot_runs < 10_000) and (hot_runs > 1 or len(hot) > 1)

    vocab = [f"w{j}" for j in range(40)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]               # noqa: E731
    line, passage = some(7), some(40)
    docs = [(d, " ".join(some(rng.randint(0, 9)) + line + some(rng.randint(0, 9)) + passage[rng.randint(0, 9):] + ["x"] * 30).encode())
            for d in range(30)]
    gone, _ = in_buckets(docs, window_dedup.word_items, 12, window_dedup.KMER, window_dedup.matcher, True)
    assert gone == brute_words([(d, t.decode()) for d, t in docs], 12)[1]


def test_texts_of_one_minimiser_are_matched_in_bounded_memory():
    """A common line with a text of its own on either side, three portions in all."""
    rng = np.random.default_rng(4)
    line = b"the very common line in so many documents of the table"
    texts = list({rng.integers(97, 123, 150, dtype=np.uint8).tobytes() + line + rng.integers(97, 123, 150, dtype=np.uint8).tobytes()
                  for _ in range(3 * superkmers.MATCH_BYTES // 354)})
    texts += [texts[5][:300], texts[9][20:]]
    items = suffix_dedup.byte_items([line])
    least = int((items.kmers >> np.uint64(32)).argmin())                 # the windows that hold the line's least k-mer stand in
    cut = [t[max(0, t.find(line) + least - 100):][:224] for t in texts]
    search = superkmers._Search(lambda some: fixed_minimiser(some, line, least), 200, suffix_dedup.KMER, suffix_dedup.matcher(200), False)
    windows = np.array([len(t) - 199 for t in cut])
    tracemalloc.start()
    try:
        hit = search.among(cut, windows, np.ones(len(cut), dtype=np.uint64))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    places = {}
    first = np.cumsum(windows) - windows
    for j, t in enumerate(cut):
        for i in range(windows[j]):
            places.setdefault(t[i:i + 200], []).append(first[j] + i)
    assert set(np.flatnonzero(hit).tolist()) == {p for at in places.values() if len(at) > 1 for p in at}
    assert peak < 200 << 20


def fixed_minimiser(texts, line, least):
    """Items whose least hash is that of a k-mer of ``line``, whatever is beside it."""
    items = suffix_dedup.byte_items(texts)
    items.kmers[np.isin(items.kmers, suffix_dedup.byte_items([line]).kmers[least])] = 0
    return items


def test_a_line_in_thousands_of_documents(spark):
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    line, passage = own(70), own(230)
    data = [(d, own(rng.randint(0, 60)) + (passage if d % 100 == 0 else line) + own(160)) for d in range(superkmers.HOT_RUNS + 400)]
    data += [(100_000 + d, "?" + data[d][1]) for d in range(1, 20)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removals(docs, keep_first=False).select("doc_id", "n_removed").collect()}
    gone = brute_bytes([(d, t.encode()) for d, t in data], 200, False)
    assert got == {d: len(g) for d, g in gone.items()}
