"""Line dedup (11): perfect hash by hand, rows against brute force, hot lines, defined cases."""

import random

import numpy as np
import pytest

from pitchside.llm import line_dedup
from pitchside.llm.perfect_hash import PerfectHash

SPACE = " \t\n\x0b\x0c\r"


def lower(key):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def brute(docs, min_chars=10):
    """Result per row, from (id, text) with ids; a null id is a document of its own after all others."""
    holders = {}
    order = [(d is None, d if d is not None else t or "") for d, t in docs]
    for o, (_, t) in zip(order, docs):
        for line in (t or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(o)
    out = []
    for o, (d, t) in zip(order, docs):
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := lower(x.strip(SPACE))) not in holders or min(holders[k]) == o]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(spark, docs, **how):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, line string").repartition(3)
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.removals(df, **how).collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 50_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    a[: n // 2] = a[:1] if n else a[:0]                      # half the keys differ in b only
    f = PerfectHash.of(a, b)
    assert sorted(f.slots(a, b)) == list(range(n)) and f.keys == n
    assert len(f.words) * 64 <= 5 * n + 64 * 12


def test_equal_keys_have_no_perfect_hash():
    with pytest.raises(ValueError, match="equal keys"):
        PerfectHash.of(np.array([1, 1], dtype=np.uint64), np.array([2, 2], dtype=np.uint64))


def test_rows_against_brute_force(spark):
    rng = random.Random(3)
    lines = ["", "short", "  Ten Chars!", "ten chars! ", "nine char", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "line\rwith return", "a nbsp is kept  ",
             *(f"common line number {i}" for i in range(12))]
    docs = [(rng.randint(-5, 10 ** 12), "\n".join(rng.choice(lines) + rng.choice(["", " ", "\t", "X"]) for _ in range(rng.randint(0, 9))))
            for _ in range(60)]
    docs += [(1, None), (2, ""), (3, "\n\n"), (4, "common line number 1\n" * 3), (5, "COMMON line number 1\r"), (6, "common line number 0\nx" + "y" * 200_000)]
    want = brute(docs)
    assert result(spark, docs) == want and sum(w[3] for w in want) > 50
    assert result(spark, docs, shards=7) == want


def test_shared_and_null_ids_and_repeated_rows(spark):
    docs = [(7, "shared line of seven\nonly here now"), (7, "shared line of seven\nother text of 7"), (8, "shared line of seven"), (8, "shared line of seven"),
            (None, "shared line of seven\nnull only line"), (None, "zzz other null text\nnull only line"), (None, "zzz other null text\nnull only line")]
    got = result(spark, docs)
    assert [(r[0], r[3]) for r in got if r[0] == 7] == [(7, 0), (7, 0)]      # one document with two rows
    assert [(r[1], r[3]) for r in got if r[0] == 8] == [("", 1), ("", 1)]
    nulls = [r for r in got if r[0] is None]
    assert len(nulls) == 3 and all("shared" not in r[1] for r in nulls)
    assert sum("null only line" in r[1] for r in nulls) in (1, 2)            # it stays in one of the two texts
    assert len({r[1] for r in nulls if r[1].startswith("zzz")}) == 1


def test_hot_lines_are_dealt_to_copies_of_their_shard(spark):
    docs = [(i, f"the line that all documents have\nown line of document {i}\nTHE LINE that all documents have") for i in range(400)]
    assert result(spark, docs, per_task=50, shards=3) == brute(docs)


def test_dedup_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a line to be found\nb", 5, "p"), (2, "a line to be found\nc", 6, None), (3, None, 7, "q")],
                                 "doc_id int, text string, n_lines int, line string")
    got = line_dedup.dedup(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "a line to be found\nb", 5, "p"), (2, "c", 6, None), (3, None, 7, "q")]
    assert line_dedup.dedup(docs.limit(0)).collect() == []


def test_foreign_lines_are_refused(spark):
    docs = spark.createDataFrame([(1, "a line to be found")], "doc_id long, text string")
    other = spark.createDataFrame([(2, "this line was never indexed\n" + "\n".join(f"and not this one {i}" for i in range(50)))], "doc_id long, text string")
    with pytest.raises(Exception, match="not in the index"):
        line_dedup.probe(other, line_dedup.build_index(docs, 1), 1).collect()
