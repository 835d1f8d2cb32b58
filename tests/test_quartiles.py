"""Statistics of the filled distances: exact by selection, approximate within their rank error."""
import pytest
from pyspark.sql import functions as F

from shipshape.operators import cleaning
from shipshape.plans import labelling as L
from shipshape.plans import stages

SF = "/root/testdata/sf0.001"


def test_statistics_equal_row_level_percentiles(spark):
    inp = L.Inputs.from_fixtures(spark, SF)
    n, median = L.median_distance(inp)
    rows = cleaning.valid_gps(L.with_distance(inp))
    assert (n, median) == (rows.count(), pytest.approx(rows.agg(F.percentile("distance_km", 0.5)).first()[0]))
    want = L.filled_lines(inp).agg(F.percentile("distance_km", [0.25, 0.75])).first()[0]
    assert L.quartiles(inp) == pytest.approx(tuple(want))


def test_approx_quartiles_rank_error(spark):
    inp = L.Inputs.from_fixtures(spark, SF)
    lines = L.filled_lines(inp)
    n = lines.count()
    for q, p in zip(L.quartiles(inp, rel_error=0.01), (0.25, 0.75)):
        assert abs(lines.filter(F.col("distance_km") <= q).count() / n - p) <= 0.02


def test_labelled_equals_plain_definitions(spark):
    from shipshape.checks import baseline_sql
    inp = L.Inputs.from_fixtures(spark, SF)
    cols = ["order_no", "item_code", "distributor_code", "totalec_so", "days_off_count", "day_processing", "ontime",
            "infull", "difot"]
    plain = sorted(map(tuple, baseline_sql.labelled(inp).select(*cols).collect()), key=str)
    ours = sorted(map(tuple, L.labelled(inp).select(*cols).collect()), key=str)
    assert ours == plain and len(ours) > 5000


def test_inputs_without_a_session_stage(spark):
    a = L.Inputs.from_fixtures(spark, SF)
    b = L.Inputs(a.fact, a.gps_customer, a.gps_distributor, a.day_off, a.urban, a.free_goods)
    assert L.median_distance(b) == L.median_distance(a) and L.quartiles(b) == L.quartiles(a)


def test_stages_follow_their_files(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(5).write.parquet(str(folder / "t.parquet"))
    build = lambda: spark.read.parquet(str(folder / "t.parquet"))
    assert stages.materialized(spark, str(folder), "copy", build).count() == 5
    spark.range(9).write.mode("overwrite").parquet(str(folder / "t.parquet"))
    assert stages.materialized(spark, str(folder), "copy", build).count() == 9
