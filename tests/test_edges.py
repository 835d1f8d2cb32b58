import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shipshape.functions.geo import haversine_km
from shipshape.operators import cleaning, joins, kpi, ranks, stats
from shipshape.sources import files

D = dt.date


def test_haversine_null_and_value(spark):
    df = spark.createDataFrame([(10.0, 106.0, 10.0, 106.0), (None, 106.0, 10.0, 106.0), (0.0, 0.0, 0.0, 180.0),
                                (10.7, 106.6, None, None)], "a double, b double, c double, d double")
    r = [x[0] for x in df.select(haversine_km("a", "b", "c", "d")).collect()]
    assert r[0] == 0.0 and r[1] is None and r[3] is None
    assert abs(r[2] - math.pi * 6371.0) < 1e-6


def test_fill_zero_and_missing(spark):
    cols = "gps_cus_latitude double, gps_cus_longitude double, gps_dist_latitude double, gps_dist_longitude double, " \
           "distance_km double"
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 3.0), (0.0, 1.0, 1.0, 1.0, 9.0), (1.0, 1.0, 1.0, 1.0, None)], cols)
    out = [r[0] for r in cleaning.fill_distance(df, 5.0).select("distance_km").collect()]
    assert out == [3.0, 5.0, 5.0]


def _cal(spark, dates):
    return spark.createDataFrame([(d,) for d in dates], "d_date date")


def test_days_off_ends_duplicates_and_nulls(spark):
    # 2024-06-02 is a Sunday and also listed as a holiday: counted once
    cal = _cal(spark, [D(2024, 6, 2), D(2024, 6, 2), D(2024, 6, 9), D(2024, 6, 1)])
    rows = [("o1", "c1", D(2024, 6, 1), D(2024, 6, 2)),   # both ends included -> 2
            ("o2", "c1", D(2024, 6, 3), D(2024, 6, 8)),   # none -> 0
            ("o3", "c1", D(2024, 6, 5), D(2024, 6, 4)),   # settlement before order -> 0
            ("o4", None, D(2024, 6, 1), D(2024, 6, 9)),   # NULL key part -> 0
            ("o5", "c1", D(2024, 6, 1), None),            # unknown settlement -> 0
            ("o6", "c1", D(2024, 5, 1), D(2024, 7, 1))]   # beyond the calendar on both sides -> 3
    df = spark.createDataFrame(rows, "order_no string, customer_code string, order_date date, settlement_date date")
    got = {r.order_no: r.days_off_count for r in joins.days_off(df, cal).collect()}
    assert got == {"o1": 2.0, "o2": 0.0, "o3": 0.0, "o4": 0.0, "o5": 0.0, "o6": 3.0}


def test_days_off_equals_counting(spark):
    import random
    rnd = random.Random(7)
    base = D(2020, 1, 1)
    days = [base + dt.timedelta(days=rnd.randrange(0, 400)) for _ in range(120)]
    rows = []
    for i in range(400):
        o = base + dt.timedelta(days=rnd.randrange(-30, 430))
        s = o + dt.timedelta(days=rnd.randrange(-3, 15)) if i % 13 else None
        rows.append((f"o{i}", "c", o, s))
    df = spark.createDataFrame(rows, "order_no string, customer_code string, order_date date, settlement_date date")
    want = {n: float(sum(o <= d <= s for d in set(days))) if s else 0.0 for n, _, o, s in rows}
    assert {r.order_no: r.days_off_count for r in joins.days_off(df, _cal(spark, days)).collect()} == want
    stray = {r.order_no: r.days_off_count for r in joins.days_off(df, _cal(spark, [*days, D(9000, 1, 1)])).collect()}
    assert stray == want  # a stray date makes the spine long, not wrong


def test_valid_gps_strict(spark):
    cols = "gps_cus_latitude double, gps_cus_longitude double, gps_dist_latitude double, gps_dist_longitude double"
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0), (1.0, 1.0, None, 1.0), (None, 1.0, 1.0, 1.0)], cols)
    assert cleaning.valid_gps(df).count() == 2 and cleaning.valid_gps(df, strict=True).count() == 1


def test_pivot_takes_all_regions(spark):
    df = spark.createDataFrame([("P1", "ASIA", 10.0), ("P1", "NEW.LAND", 50.0), ("P2", "ASIA", 40.0), ("P3", None, 9.0)],
                               "item_code string, region string, difot_pct double")
    p = kpi.pivot_kpi(df, kpi.FIXTURE_REGION_CODES)
    assert p.columns == ["item_code", "ASI", "NEW.LAND"]
    top = kpi.top_items(p, 2).collect()
    assert [r.item_code for r in top] == ["P1", "P2"] and top[0]["NEW.LAND"] == 50.0


def test_correlation_pairwise_complete(spark):
    import random
    rnd = random.Random(2)
    rows = [(x := rnd.gauss(1e6, 1), x + rnd.gauss(0, 1) if i % 3 else None, float(i % 5) if i % 7 else None, 3.0)
            for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(r.row_var, r.col_var): r["corr"] for r in stats.correlation(df, ["a", "b", "c", "k"]).collect()}
    for x in "abc":
        for y in "abc":
            want = df.where(f"{x} IS NOT NULL AND {y} IS NOT NULL").agg(F.corr(x, y)).first()[0]
            assert abs(got[x, y] - want) < 1e-9
    assert got["a", "k"] is None and got["k", "k"] is None


def test_histogram_boundaries(spark):
    vals = [0.0, 1.99, 2.0, 26.0, 27.5, 28.0, 28.1, -0.1, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = {r.bucket: r.frequency for r in stats.histogram(df, "x").collect()}
    assert h[0] == 2 and h[1] == 1 and h[13] == 3 and sum(h.values()) == 6


def test_kpi_zero_denominator_and_double_count(spark):
    df = spark.createDataFrame([("g", "o1", 1.0), ("g", "o1", 0.0), ("g", "o2", 1.0), ("h", None, 1.0)],
                               "g string, order_no string, difot double")
    r = {x.g: x for x in kpi.kpi(df, "g").collect()}
    assert (r["g"].order_non_difot, r["g"].order_difot) == (1, 2)
    assert r["h"].order_difot == 0 and r["h"].difot_pct is None


def test_read_table_drops_repeated_header(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n1,x\na,b\n,y\n2,z\n")
    df = files.read_table(spark, str(p), ["a", "b"])
    assert sorted(r.a for r in df.collect()) == ["1", "2"]


def test_read_table_finds_columns_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("b,a,extra\nbee,1,x\nb,a,extra\n")
    (tmp_path / "2.csv").write_text('a,"b"\n2,"c,d"\n')
    got = files.read_parts(spark, str(tmp_path), ["a", "b"])
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [("1", "bee"), ("2", "c,d")]
    (tmp_path / "3.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="no column b in .*3.csv"):
        files.read_parts(spark, str(tmp_path), ["a", "b"])


def test_read_parts_of_gzip_files(spark, tmp_path):
    import gzip
    for i, text in enumerate(("a,b\n1,x\n", "b,a\ny,2\n")):
        with gzip.open(tmp_path / f"{i}.csv.gz", "wt") as f:
            f.write(text)
    assert sorted(map(tuple, files.read_parts(spark, str(tmp_path), ["a", "b"]).collect())) == [("1", "x"), ("2", "y")]


def test_typed_bad_values_become_null(spark):
    df = spark.createDataFrame([("1.5", "01-05-2023", "01-May-95"), ("N/A", "x", "1-May-23")], "n string, d string, e string")
    r = files.typed(df, {"n": "double", "d": ("date", "dd-MM-yyyy"), "e": ("date", "d-MMM-yy")}).collect()
    assert r[0].n == 1.5 and r[0].d == D(2023, 5, 1) and r[0].e == D(1995, 5, 1)
    assert r[1].n is None and r[1].d is None and r[1].e == D(2023, 5, 1)


def test_ranks_equal_percentile(spark):
    import random
    rnd = random.Random(3)
    for n in (1, 2, 7, 1000, 1001):
        vals = [float(rnd.randrange(0, 50)) for _ in range(n)] + [None, float("nan")]
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        got = ranks.quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0])
        want = df.where("NOT isnan(x)").agg(F.percentile("x", [0.0, 0.25, 0.5, 0.9, 1.0])).first()[0]
        assert got[0] == n and got[1] == pytest.approx(want)
    assert ranks.quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == (0, [None])


def test_ranks_of_weighted_and_uneven_values(spark):
    vals = [(-1e300, 1), (0.0, 5), (1e-12, 2), (2e-12, 1), (7.0, 3), (1e12, 1), (1e300, 2)]
    df = spark.createDataFrame([(float(v), w) for v, w in vals], "x double, w int")
    flat = [v for v, w in vals for _ in range(w)]
    n, at = ranks.values_at_ranks(df, "x", range(0, 20), "w")
    assert n == len(flat) and at == {k: flat[k - 1] for k in range(1, n + 1)}
