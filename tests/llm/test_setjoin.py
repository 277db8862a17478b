"""N-gram Jaccard join (4): components against brute force, copies, near-copy groups, defined cases."""

import itertools
import random
import re

import pytest

from pitchside.llm import graph, setjoin


def sets(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1)))


def brute(rows, k=4, percent=85):
    """doc_id -> (set size, smallest id in reach)."""
    s = {d: sets(t, k) for d, t in rows}
    up = {d: d for d in s}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s[d]), root(d)) for d in s}


def documents(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    rows = []
    for d in range(150):
        base = list(bases[0] if rng.random() < 0.4 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):          # edits
            base[rng.randrange(len(base))] = rng.choice(vocab)
        if rng.random() < 0.3:
            base += passage
        rows.append((d * 7 % 1009, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in base)))
    return rows + [(2000, "one two"), (2001, "One  two"), (2002, "one two three"), (2003, ""), (2004, " \n"), (2005, None), (2006, "é É")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = documents(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.linked_components(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_prefixes_of_linked_sets_share_enough():
    import numpy as np
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 60)
        a = rng.sample(range(1000), n)
        b = a[:rng.randint(max(1, int(n * 0.85)), n)] + rng.sample(range(1000, 2000), rng.randint(0, 5))
        if 100 * len(set(a) & set(b)) < 85 * len(set(a) | set(b)):
            continue
        token = np.array(sorted(a) + sorted(b), dtype=np.uint64)
        size = np.array([len(a), len(b)])
        frequent = (np.array(sorted(rng.sample(range(1000), 50)), dtype=np.uint64), np.array([rng.randint(2, 10**6) for _ in range(50)]))
        t, owner, matches, _, last = setjoin.prefixes(token, size, frequent, 85)
        shared = len(set(t[owner == 0].tolist()) & set(t[owner == 1].tolist()))
        assert shared >= min(matches)
        # of the set whose prefix ends earlier: shared prefix tokens and what follows the prefix bound the overlap
        early = [i for i in (0, 1) if last[i] == last.min()]
        assert any(len(set(a) & set(b)) <= shared + size[i] - (owner == i).sum() for i in early)


def test_hubs_with_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_NODES", 5)
    monkeypatch.setattr(setjoin, "STAR_ROUNDS", 1)
    rows = documents(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.linked_components(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=70).collect()}
    assert got == brute(rows, percent=70)


def test_repeated_rows_null_ids_and_keep_one(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(5, long, "x"), (3, long + " b", "x"), (3, long + " b", "x"), (None, long, "n"), (8, "other words here", "x"), (9, None, "x"),
            (10, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((r.doc_id or 99, r.n_shingles, r.component_id) for r in setjoin.linked_components(docs).collect())
    assert got == [(3, 58, 3), (3, 58, 3), (5, 57, 3), (8, 1, 8), (9, 0, 9), (10, 0, 10), (99, 57, None)]
    kept = setjoin.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 99) for r in kept.collect()) == [3, 8, 9, 10, 99]
    assert setjoin.linked_components(docs.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    path = spark.range(60).selectExpr("id AS u", "id + 1 AS v").union(spark.createDataFrame([(100, 101), (100, 100)], "u long, v long"))
    got = {r.node: r.component for r in graph.components(path).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_texts_under_a_shared_id_stand_for_themselves(spark):
    """Two texts of one id: only what links, or repeats with its id, goes."""
    long = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"z{i}" for i in range(60))
    for rows, want in (
            ([(1, long), (5, long + " b"), (5, other)], [(1, long), (5, other)]),
            ([(5, long), (5, other)], [(5, long), (5, other)]),
            ([(5, long), (5, long), (5, other), (7, other + " q")], [(5, long), (5, other)]),
            ([(3, None), (3, ""), (3, " "), (3, other)], [(3, None), (3, " "), (3, other)]),
            ([(None, long), (None, long), (4, long)], [(None, long), (None, long), (4, long)])):
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, text_key int")
        got = sorted(((r.doc_id, r.text or None) for r in setjoin.keep_one(docs).collect()), key=str)
        assert got == sorted(((i, t or None) for i, t in want), key=str), rows
    linked = [(5, long), (5, long + " b"), (9, long + " c")]
    kept = setjoin.keep_one(spark.createDataFrame(linked, "doc_id long, text string")).collect()
    assert len(kept) == 1 and kept[0].doc_id == 5


def test_very_long_text(spark):
    body = " ".join(f"w{i % 7919} x{i}" for i in range(150_000))
    rows = [(1, body), (2, body + " tail"), (3, "short text of a few words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.linked_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (299_997, 1), 2: (299_998, 1), 3: (3, 3)}
