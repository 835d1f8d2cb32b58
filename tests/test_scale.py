"""What a query computes, shuffles and writes follows the columns that it names."""
import datetime
import glob

import pytest
from pyspark.sql import functions as F

from shipshape.operators import joins
from shipshape.plans import catalog, stages
from shipshape.sources import files

SF = "/root/testdata/sf0.001"


def _plan(df, part="optimizedPlan"):
    return str(getattr(df._jdf.queryExecution(), part)())


def test_enriched_lines_are_computed_by_column(spark):
    stages.release(spark)
    plan = _plan(catalog._enriched(spark, SF).select("difot"), "executedPlan")
    for unused in ("p_brand", "p_type", "l_extendedprice", "o_orderpriority", "c_mktsegment", "n_name"):
        assert unused not in plan
    written = {key[-1] for key in stages._PATHS}
    assert not written & {"fact", "labelled", "enriched"}


def test_lines_meet_the_customers_tables_in_one_shuffle(spark):
    lines = spark.createDataFrame([("C1", "D1", 1), ("C1", "D2", 2), ("C9", "D1", 3)], "customer_code string, distributor_code string, n int")
    cus = spark.createDataFrame([("C1", 1.0, 2.0), ("C1", 5.0, 6.0)], "customerid string, latitude double, longitude double")
    dist = spark.createDataFrame([("D1", 3.0, 4.0)], "customerid string, latitude double, longitude double")
    urban = spark.createDataFrame([("C1", "a", "b", 7.0)], "customerid string, city string, province_standard string, urban_rate double")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = joins.with_urban(joins.with_gps(lines, cus, dist), urban)
        assert _plan(out, "executedPlan").count("Exchange hashpartitioning") == 5  # lines by both codes, three tables
        got = sorted(map(tuple, out.select("n", "gps_cus_latitude", "gps_dist_latitude", "urban_rate").collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(1, 1.0, 3.0, 7.0), (1, 5.0, 3.0, 7.0), (2, 1.0, None, 7.0), (2, 5.0, None, 7.0)]


def test_gzip_parts_are_bounded(spark, tmp_path):
    path = files.write_csv_gz(spark.range(1000).repartition(1).withColumn("x", F.lit("a")), str(tmp_path / "parts"), max_rows=300)
    assert len(glob.glob(f"{path}/*.gz")) == 4
    assert files.read_parts(spark, path, ["id", "x"]).count() == 1000


def test_neighbours_are_found_by_blocks():
    """Few distances are computed, and ties at the bound go to the lesser value."""
    import numpy as np

    from shipshape.operators import knn
    rng = np.random.default_rng(5)
    x, q = rng.integers(0, 40, (4000, 3)).astype(float), rng.integers(0, 40, (700, 3)).astype(float)
    val = rng.integers(0, 2, 4000).astype(float)
    counted, plain = [], knn._distances
    knn._distances = lambda a, b: counted.append(len(a) * len(b)) or plain(a, b)
    try:
        found = list(knn._search(q, np.full(700, np.inf), x, val, 3))
    finally:
        knn._distances = plain
    assert sum(counted) < 700 * 4000 / 3
    got = {}
    for rows, points, dist in found:
        for r, p, d in zip(rows.tolist(), points.tolist(), dist.tolist()):
            got.setdefault(r, []).append((d, val[p]))
    d = np.round(plain(q, x), knn.DIGITS)
    assert all(got[i] == sorted(zip(d[i].tolist(), val.tolist()))[:3] for i in range(700))


@pytest.mark.parametrize("odd", [None, float("inf")])
def test_pairs_are_sifted_before_their_distance_is_computed(monkeypatch, odd):
    """Far fewer distances than pairs of the blocks that meet, far from the origin, too; with an infinite number all of them."""
    import numpy as np

    from shipshape.operators import knn
    rng = np.random.default_rng(7)
    x, q = (rng.random((n, 4)) * [1, 1e-3, 5, 40] + 1e4 for n in (3000, 500))
    if odd:
        x[5, 2] = odd
    val, pairs, whole = np.zeros(3000), [], []
    each, every = knn._paired, knn._distances
    monkeypatch.setattr(knn, "_paired", lambda a, b: pairs.append(len(a)) or each(a, b))
    monkeypatch.setattr(knn, "_distances", lambda a, b: whole.append(len(a) * len(b)) or every(a, b))
    found = list(knn._search(q, np.full(500, np.inf), x, val, 3))
    if odd:
        assert not pairs and whole
    else:
        assert not whole and 1500 <= sum(pairs) < 500 * 3000 / 20
    got = {}
    for rows, _, dist in found:
        for r, d in zip(rows.tolist(), dist.tolist()):
            got.setdefault(r, []).append(d)
    d = np.sort(np.round(every(q, x), knn.DIGITS), axis=1)[:, :3]
    assert all(got[i] == d[i].tolist() for i in range(500))


def _order_tables(spark, folder):
    """Small driver tables with null, unknown and repeated keys."""
    ts = datetime.datetime
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, "EUROPE")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 1)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string",
                     [(i, i % 2, "M") for i in range(1, 13)] + [(5, 1, "M"), (61, 0, "M"), (None, 0, "M")]),
        "supplier": ("s_suppkey long", [(1,), (2,), (2,), (None,)]),
        "part": ("p_partkey long, p_brand string, p_type string, p_size int", [(1, "B", "T", 3), (2, "B", None, 4), (2, "C", "T", 5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
                   [(i, i % 14, ts(2024, 1, 1 + i % 28), "1-URGENT") for i in range(1, 60)]
                   + [(25, 5, ts(2024, 2, 1), "2-HIGH"), (None, 5, ts(2024, 2, 1), None), (30, None, ts(2024, 2, 1), None), (35, 61, None, None)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double",
                     [(i % 62, 1 + i % 3, i % 4, float(i % 7), 10.0 * i) for i in range(200)] + [(None, 1, 1, 1.0, 1.0), (25, 2, None, None, None)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_orders_are_enriched_before_they_meet_their_lines(spark, tmp_path):
    from shipshape.plans import labelling as L
    folder = _order_tables(spark, tmp_path)
    inp = L.Inputs.from_fixtures(spark, folder)
    plain = L.Inputs(inp.fact, inp.gps_customer, inp.gps_distributor, inp.day_off, inp.urban, inp.free_goods)
    columns = [*L.fixtures.FACT_COLUMNS, *L.GPS_COLUMNS, *L.LABEL_COLUMNS, *L.ENRICHED_EXTRA]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    for dedupe in (False, True):
        got = rows(L.enriched(inp, dedupe))
        assert got and got == rows(L.enriched(plain, dedupe)) == rows(L.enriched(inp, dedupe, flag_last=True))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = _plan(catalog._enriched(spark, folder), "executedPlan").split("\n")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "FileScan" in line and "l_orderkey" in line)
    above, shuffles = depth(plan[at]), 0
    for line in reversed(plan[:at]):
        if depth(line) < above:
            above, shuffles = depth(line), shuffles + ("Exchange hashpartitioning" in line)
    assert shuffles == 3  # by part, order and distributor; before: by customer and free good, too


def test_counts_of_orders_do_without_the_free_goods(spark):
    plan = _plan(catalog.kpi_by_customer(spark, SF))
    assert "_fg_" not in plan and "gps_cus_latitude" in plan
