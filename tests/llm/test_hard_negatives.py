"""Hard negatives (12): the scan against all scores by hand, bounds that prune, defined cases."""

import math
import random

import numpy as np
import pytest

from pitchside.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, rank int"


def brute(rows, every=100, n_pos=5, n_neg=5):
    ok = {}
    for i, v, l in rows:
        if i is None or v is None or l is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v])
        ok[i] = min(ok.get(i, row), row)
    out = []
    for a, (la, va) in ok.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(va, vb)) for b, (_, vb) in ok.items()}
        best = sorted((-score[b], b) for b, (lb, _) in ok.items() if lb == la and b != a)[:n_pos]
        for s, p in best:
            s = -s
            neg = sorted((-score[b], b) for b, (lb, _) in ok.items() if lb != la and 80 * s <= 100 * score[b] <= 100 * s)[:n_neg]
            out += [(a, p, k + 1, b, s, -ns) for k, (ns, b) in enumerate(neg)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3)
    got = H.mine(df, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(seed, n, dim=24, coarse=False):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(10)]
    draw = (lambda x: round(x * 4) / 4) if coarse else (lambda x: x)       # coarse components make many ties
    return [(i, [draw(c + rng.gauss(0, 0.1)) for c in centres[rng.randint(0, 9)]], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
def test_against_all_scores(spark, coarse):
    rows = vectors(1, 700, coarse=coarse)
    want = brute(rows)
    assert len(want) > 50
    assert mined(spark, rows) == want
    assert mined(spark, rows, block_rows=100, slice_anchors=2) == want


def test_defined_cases(spark):
    rows = vectors(2, 320)
    rows += [(None, rows[0][1], 0), (400, None, 0), (401, rows[1][1], None), (402, [None] * 24, 0), (403, [math.nan] * 24, 0),
             (404, [math.inf] * 24, 0), (5, rows[5][1], rows[5][2]), (6, rows[7][1], 0), (500, [], 0), (501, rows[3][1][:4], 1),
             (600, [-x for x in rows[0][1]], 0), (700, rows[0][1], 77)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 3)]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [1e5 * ((i * 37) % 11 - 5), float(i), 3e5], i % 2) for i in range(120)]
    assert mined(spark, rows) == brute(rows)
    wide = [(i, [float(2 ** 22) + i, float(2 ** 22) - i], i % 2) for i in range(150)]     # beyond exact doubles
    assert mined(spark, wide) == brute(wide)
    with pytest.raises(Exception):                                                         # beyond 64 bits
        mined(spark, [(i, [1e30], i % 2) for i in range(101)])


def test_bounds_empty_the_bitmap_before_the_last_column():
    rng = np.random.default_rng(4)
    n, dim = 4000, 64
    columns = rng.integers(-20, 20, (dim, n))
    columns[:8, :10] = 500                                   # ten rows stand out in the columns read first
    vector = np.concatenate([np.full(8, 100), np.ones(dim - 8, dtype=np.int64)])
    labels = np.zeros(n, dtype=np.int64)
    row = dict(zip(("ids", "labels", "columns", "low", "high"),
                   (x.astype("<i8").tobytes() for x in (np.arange(n), labels, columns, columns.min(axis=1), columns.max(axis=1)))))
    block, sizes = H.Block(row, 100), []
    best = H._scan

    def watched(block, vector, rows, stays):
        return best(block, vector, rows, lambda *a: (sizes.append(len(a[0])), stays(*a))[1])

    H._scan, kept = watched, H._scan
    try:
        ids, scores = H.best_of_label(block, vector, 0, -1, 5)
    finally:
        H._scan = kept
    full = vector @ columns
    order = sorted(range(n), key=lambda k: (-full[k], k))[:5]
    assert list(ids) == order and list(scores) == [full[k] for k in order]
    assert sizes[0] == n and sizes[1] <= 10 and len(sizes) == dim // H.STRIDE
