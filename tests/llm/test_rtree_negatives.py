"""Hard negatives by R-trees against all pairs."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipshape.llm import rtree_negatives as rt

SCHEMA = "vec_id long, embedding array<double>, label int, block string"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """Sorted result rows; ``rows``: (vec_id, embedding, label)."""
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ya in fine:
        if not anchors(a):
            continue
        scored = sorted((-sum(map(int.__mul__, va, v)), i, y) for i, v, y in fine if i != a and len(v) == len(va))
        for s, p, _ in [r for r in scored if r[2] == ya][:positives]:
            fit = [r for r in scored if r[2] != ya and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in rt.hard_negatives(df, anchors, **kw).collect())


@pytest.mark.parametrize("blocks", [{}, {"shard_rows": 300, "block_rows": 7}])
def test_against_all_pairs(spark, blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.7).round(2).tolist(), int(rng.integers(4))) for i in range(1500)]
    rows += [(i, [0.5] * 8, 1 + i % 2) for i in range(1500, 1900)]  # a third of equal vectors: ties by id
    got = mined(spark, rows, F.col("vec_id") % 100 == 0, **blocks)
    assert got == brute(rows, lambda i: i % 100 == 0) and len(got) > 300


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2),
            (5, [None, 1.0], 2), (6, None, 2), (7, [0.5, 0.1], None), (None, [0.5, 0.1], 2), (8, [0.5], 2), (9, [], 2),
            (10, [], 1), (11, [0.6, 1e6], 3), (12, [-1.0, 0.0], 1), (100, [-1.0, 0.0], 4), (100, [1.0, 1.0], 4),
            (13, [0.4, 0.4], 2), (13, [0.4, 0.4], 2), (14, [1e300, 1e300], 2), (200, [0.0, 0.0], 1)]
    got = mined(spark, rows, F.col("vec_id") % 100 == 0)
    assert got == brute(rows, lambda i: i % 100 == 0) and got
    assert mined(spark, [], F.col("vec_id") % 100 == 0) == []
    assert mined(spark, rows[1:3], F.col("vec_id") % 100 == 0) == []


def test_scores_beyond_doubles(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(2 ** 24) / 8 + i, float(rng.randrange(2 ** 21))], i % 3) for i in range(300)]
    assert mined(spark, rows, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0)


def test_boxes_bound_and_prune():
    """Intervals hold every inner product, and the search opens fewer leaves than there are."""
    rng = np.random.default_rng(4)
    x, labels, ids = np.floor(rng.normal(size=(5000, 3)) * 256), rng.integers(0, 3, 5000), rng.permutation(5000)
    order, starts = rt.str_order(x, labels, ids, [0, 1, 2])
    assert sorted(order) == list(range(5000)) and max(np.diff(np.append(starts, 5000))) <= rt.LEAF
    x, labels, ids = x[order], labels[order], ids[order]
    tree = rt.RTree(x, labels, ids, starts)
    q = x[17]
    lo, hi = tree.bounds(0, 0, len(starts), q)
    for i, (a, b) in enumerate(zip(starts, np.append(starts[1:], 5000))):
        s = x[a:b] @ q
        assert lo[i] <= s.min() and s.max() <= hi[i] and len(set(labels[a:b])) == 1
    opened = []
    got = tree.best(q, [(None, None)], 5, lambda y: opened.append(1) or y == 1, lambda a, b: a <= 1 <= b, -1)[0]
    want = sorted(((-s, i) for s, i, y in zip(x @ q, ids, labels) if y == 1))[:5]
    assert [(-s, i) for s, i in got] == want and len(opened) < len(starts) / 4
