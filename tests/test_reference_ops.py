"""Sphere join, Fourier features, sketches, encoder and tree paths against plain Python."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipshape.operators import features, kernel, models, nearest, ranks
from shipshape.session import scratch_dir


def km(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_nearest_of_many_centres_is_the_fold_s(spark):
    rng = random.Random(3)
    spot = lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180))
    centres = [(i, f"c{i}", *spot()) for i in range(70)] + [(70, "north", 90.0, 0.0), (71, "same", 90.0, 120.0)]
    points = [(i, *spot()) for i in range(500)] + [(500, None, 3.0), (501, float("nan"), 1.0), (502, 89.9, -179.99),
                                                  (503, centres[4][2], centres[4][3]), (504, 0.0, 180.0), (505, 0.0, -180.0)]
    c = spark.createDataFrame(centres, "seq int, city string, latitude double, longitude double")
    p = spark.createDataFrame(points, "id int, la double, lo double").withColumn("seq", F.lit("clash"))
    one = {r.id: (r.nearest_city, r.nearest_city_km) for r in nearest.nearest_centre(p, c, "la", "lo").collect()}
    two = {r.id: (r.nearest_city, r.nearest_city_km) for r in nearest.nearest_centre_join(p, c, "la", "lo").collect()}
    assert two.pop(500) == (None, None) and two.pop(501) == (None, None) and len(two) == 504
    assert {k: v[0] for k, v in two.items()} == {k: one[k][0] for k in two}
    assert all(v[1] == pytest.approx(one[k][1], abs=2e-6) for k, v in two.items())


def test_nearest_of_50_000_centres(spark):
    rng = random.Random(5)
    centres = [(i, f"c{i}", rng.uniform(10, 11), rng.uniform(106, 107)) for i in range(50_000)]
    points = [(i, rng.uniform(9.9, 11.1), rng.uniform(105.9, 107.1)) for i in range(60)]
    c = spark.createDataFrame(centres, "seq int, city string, latitude double, longitude double")
    p = spark.createDataFrame(points, "id int, la double, lo double")
    got = {r.id: r.nearest_city for r in nearest.nearest_centre(p, c, "la", "lo").collect()}
    at = np.array([x[2:] for x in centres])
    for i, la, lo in points:
        near = np.argsort((at[:, 0] - la) ** 2 + ((at[:, 1] - lo) * math.cos(math.radians(la))) ** 2)[:50]
        best = min(near.tolist(), key=lambda j: (round(km((la, lo), centres[j][2:]), 6), j))
        assert got[i] == f"c{best}"


def test_nearest_without_centres(spark):
    c = spark.createDataFrame([(1, "x", None, 2.0)], "seq int, city string, latitude double, longitude double")
    p = spark.createDataFrame([(1, 2.0, 3.0)], "id int, la double, lo double")
    assert [tuple(r) for r in nearest.nearest_centre_join(p, c, "la", "lo").collect()] == [(1, 2.0, 3.0, None, None)]


def test_fourier_features_approximate_the_kernel(spark):
    rng = random.Random(2)
    rows = [tuple(rng.gauss(0, 1) for _ in range(4)) for _ in range(60)] + [(None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    unit = [(0.0, 1.0)] * 4
    got = [r.features.toArray() for r in kernel.with_fourier(df, list("abcd"), unit, 4000, 0.3).collect()]
    worst = 0.0
    for i in range(60):
        for j in range(i):
            want = math.exp(-0.3 * sum((x - y) ** 2 for x, y in zip(rows[i], rows[j])))
            worst = max(worst, abs(want - got[i] @ got[j]))
    assert worst < 0.08  # errors are about one over the root of 4,000
    assert kernel.scaling(df, ["a"])[0][0] == pytest.approx(np.mean([r[0] for r in rows[:60]]))


def test_kernel_parts_a_ring_from_its_middle(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        r, a = (rng.uniform(0, 1) if i % 2 else rng.uniform(1.5, 2.5)), rng.uniform(0, 2 * math.pi)
        rows.append((r * math.cos(a), r * math.sin(a), float(i % 2)))
    df = spark.createDataFrame(rows, "x double, y double, label double")
    plain = features.assemble(df, ["x", "y"])
    hot = kernel.with_fourier(df, ["x", "y"], count=100, gamma=1.0)
    assert models.train_and_score(plain, plain, "svc").first().accuracy < 0.7
    assert models.train_and_score(hot, hot, "svc").first().accuracy > 0.95


def test_sketches_merge(spark):
    rng = random.Random(1)
    rows = [(i % 40, None if i % 97 == 0 else rng.gauss(0, 1)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day int, x double")
    sketches = ranks.sketch_by(df, ["day"], "x")
    assert sketches.count() == 40
    r = ranks.sketch_quantiles(sketches, [0.1, 0.5, 0.9]).first()
    x = sorted(v for _, v in rows if v is not None)
    assert r.n == len(x)
    for q, p in ((r.q0, 0.1), (r.q1, 0.5), (r.q2, 0.9)):
        assert abs(sum(v <= q for v in x) / len(x) - p) < 0.015
    months = ranks.sketch_quantiles(sketches.withColumn("m", F.col("day") % 4), [0.5], ["m"])
    assert months.count() == 4 and months.agg(F.sum("n")).first()[0] == len(x)


def test_saved_encoder_on_new_rows(spark):
    df = spark.createDataFrame([(1, "b", 2), (2, "a", 10), (3, "c", 9), (4, None, None)], "id int, k string, month int")
    path = scratch_dir(spark, "encoder-test")
    features.fit_encoder(df, path, ["k", "month"])
    got = lambda x: {(r.id, r.feature) for r in features.encode_long(x, path, ["id"], ["k", "month"]).collect()}
    assert got(df) == {(1, "k_b"), (2, "month_10"), (3, "k_c"), (3, "month_9")}  # a and month 2 come first
    new = spark.createDataFrame([(7, "z", 10), (8, "c", 11), (9, "a", None)], "id int, k string, month int")
    assert got(new) == {(7, "month_10"), (8, "k_c")}
    long = {(r.id, r.feature) for r in features.one_hot_long(df, ["id"], ["k", "month"]).collect()}
    assert got(df) == long


def test_rows_walk_their_paths(spark):
    rng = random.Random(4)
    rows = [(rng.random(), rng.random(), rng.randrange(3) * 1.0) for _ in range(300)]
    df = spark.createDataFrame([(*r, float(r[0] + r[1] * r[2] > 0.9)) for r in rows], "a double, b double, c double, label double")
    model = models.estimator("rf", num_trees=3, max_depth=5).fit(features.assemble(df, ["a", "b", "c"]))
    nodes = models.node_table(model)
    for tree in range(3):
        paths = models.tree_paths(nodes, ["a", "b", "c"], tree).collect()
        mine = [r for r in nodes.collect() if r.tree_id == tree]
        assert {p.node_id for p in paths} == {r.node_id for r in mine if r.left_child < 0}
        seen = df.select(sum((F.expr(p.conditions or "true").cast("int") for p in paths), F.lit(0)).alias("n")).distinct().collect()
        assert [r.n for r in seen] == [1]  # every row meets the conditions of one leaf
        assert all(p.depth == len([c for c in p.conditions.split(" AND ") if c]) for p in paths)
    leaf = spark.createDataFrame([(0, 0, -1, None, 1.0, -1, -1)], "tree_id int, node_id int, feature_index int, threshold double, "
                                 "prediction double, left_child int, right_child int")
    assert [tuple(r) for r in models.tree_paths(leaf, ["a"], 0).collect()] == [(0, 0, 0, 1.0, "")]


def test_folds_in_parallel_are_the_same(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random(), i % 5) for i in range(300)]
    df = features.assemble(spark.createDataFrame([(a, b, float(a > b), f) for a, b, f in rows],
                                                 "a double, b double, label double, fold int"), ["a", "b"]).cache()
    one, five = (sorted(map(tuple, models.cross_validate(df, "dt", 5, parallel=n).collect())) for n in (1, 5))
    assert [r[0] for r in five] == list(range(5)) and one == five


def test_correlation_is_pairwise_complete(spark):
    from shipshape.operators import stats
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 3, (500, 4))
    x[:, 1] += 2 * (x[:, 0] - 1e6)
    gone = rng.random((500, 4)) < [0, 0.2, 0.1, 0]
    rows = [tuple(None if g else float(v) for v, g in zip(r, m)) + (5.0, None) for r, m in zip(x, gone)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(7)
    got = {(r.i, r.j): r["corr"] for r in stats.correlation(df, list("abcdef")).collect()}
    for i in range(4):
        for j in range(4):
            both = ~gone[:, i] & ~gone[:, j]
            assert got[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert len(got) == 36 and all(got[i, j] is None for i in range(6) for j in (4, 5))
    assert all(r["corr"] is None for r in stats.correlation(df.limit(0), ["a", "b"]).collect())


def test_sparse_vectors_hold_the_one_hot_columns(spark):
    df = spark.createDataFrame([(1, 2.5, "b", 2), (2, None, "a", 10), (3, 1.0, "c", 9), (4, 4.0, None, None)],
                               "id int, x double, k string, month int")
    path = scratch_dir(spark, "encoder-vectors")
    features.fit_encoder(df, path, ["k", "month"])
    new = df.unionByName(spark.createDataFrame([(5, 3.0, "z", 11)], df.schema))
    got, names = features.encoded_vectors(new, path, ["id"], ["x"], ["k", "month"])
    assert names == ["x", "k_b", "k_c", "month_9", "month_10"]
    rows = {r.id: r.features.toArray().tolist() for r in got.collect()}
    assert rows == {1: [2.5, 1, 0, 0, 0], 2: [0, 0, 0, 0, 1], 3: [1, 0, 1, 1, 0], 4: [4, 0, 0, 0, 0], 5: [3, 0, 0, 0, 0]}
