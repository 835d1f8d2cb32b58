"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables through the fixtures of FIXTURES.md and
runs the library's operators on the whole of them (only ``sample_by_key`` samples; models are
fitted on all training rows). Doubles are rounded to 6 digits at the very end so results compare
across engines.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from shipshape.functions.columns import (double_to_yes_no, order_key, order_key3, to_date_fmt, to_double,
                                         yes_no_to_double)
from shipshape.operators import cleaning, features, joins, kpi, metrics, nearest, ranking, ranks, stats
from shipshape.plans import labelling as L
from shipshape.sources import fixtures, literals

KEY = ["order_no", "item_code", "distributor_code", "totalec_so"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _inp(spark, sf_dir) -> L.Inputs:
    return L.Inputs.from_fixtures(spark, sf_dir)


def _median_row(spark, sf_dir):
    return spark.createDataFrame([L.median_distance(_inp(spark, sf_dir))], "n long, median_distance double")


# ---------------------------------------------------------------- stage 1

@query
def join_gps_left(spark, sf_dir):
    return r6(L.with_distance(_inp(spark, sf_dir)).select(*KEY, "customer_code", *L.GPS_COLUMNS))


@query
def proj_fact_gps(spark, sf_dir):
    return r6(L.with_distance(_inp(spark, sf_dir)).select(*fixtures.FACT_COLUMNS, *L.GPS_COLUMNS))


@query
def distance_haversine(spark, sf_dir):
    p = L.pair_distances(_inp(spark, sf_dir))
    return r6(p.select("customer_code", "distributor_code", "n_lines", "distance_km"))


@query
def filter_valid_gps(spark, sf_dir):
    return r6(cleaning.valid_gps(L.with_distance(_inp(spark, sf_dir))).select(*KEY, "distance_km"))


@query
def median_distance(spark, sf_dir):
    return r6(_median_row(spark, sf_dir))


@query
def fill_distance_median(spark, sf_dir):
    return r6(L.filled_lines(_inp(spark, sf_dir)).select(*KEY, "distance_km"))


@query
def quartiles_exact(spark, sf_dir):
    q1, q3 = L.quartiles(_inp(spark, sf_dir))
    lo, hi = cleaning.bounds(q1, q3)
    return r6(spark.createDataFrame([(q1, q3, q3 - q1, lo, hi)], "q1 double, q3 double, iqr double, "
                                                                 "lower_bound double, upper_bound double"))


def _filled(spark, sf_dir):
    """Order date and filled distance of all lines (a stage for queries of several passes)."""
    from shipshape.plans.stages import materialized
    return materialized(spark, sf_dir, "filled", lambda: L.filled_lines(_inp(spark, sf_dir)).select("order_date", "distance_km"))


@query
def quartiles_approx(spark, sf_dir):
    """Whether the approximate quartiles keep their rank error of 0.01 among the filled lines."""
    inp = _inp(spark, sf_dir)
    q1, q3 = L.quartiles(inp, rel_error=0.01)
    n, x = F.count(F.lit(1)), F.col("distance_km")
    share = lambda c: F.count(F.when(c, 1)) / n
    within = lambda q, p: (share(x < q) <= p + 0.01) & (share(x <= q) >= p - 0.01)
    return _filled(spark, sf_dir).where("distance_km IS NOT NULL").agg(
        n.alias("n"), within(q1, 0.25).alias("q1_within"), within(q3, 0.75).alias("q3_within"))


@query
def quartiles_sketched(spark, sf_dir):
    """Whether quartiles from merged sketches, one stored for each order date, keep a rank error of 0.01."""
    from shipshape.plans.stages import materialized
    lines = _filled(spark, sf_dir).where("distance_km IS NOT NULL")
    stored = materialized(spark, sf_dir, "sketches", lambda: ranks.sketch_by(lines, ["order_date"], "distance_km"))
    q = ranks.sketch_quantiles(stored, [0.25, 0.5, 0.75]).first()
    n, x = F.count(F.lit(1)), F.col("distance_km")
    share = lambda c: F.count(F.when(c, 1)) / n
    return lines.agg(n.alias("n"), F.lit(q.n).cast("long").alias("sketched"), *[
        ((share(x < q[f"q{i}"]) <= p + 0.01) & (share(x <= q[f"q{i}"]) >= p - 0.01)).alias(f"q{i + 1}_within")
        for i, p in enumerate((0.25, 0.5, 0.75))])


@query
def iqr_filter(spark, sf_dir):
    return r6(L.cleaned(_inp(spark, sf_dir)).select(*KEY, "distance_km"))


@query
def iqr_retention(spark, sf_dir):
    inp = _inp(spark, sf_dir)
    lo, hi = cleaning.bounds(*L.quartiles(inp))
    d = F.col("distance_km")
    return r6(cleaning.retention(L.filled_lines(inp), (d >= lo) & (d <= hi)))


def _labelled(spark, sf_dir):
    """The labelled lines as a plan, of which a query computes and shuffles only the columns that it names. Queries
    that read them more than once write those columns as a stage of their own."""
    return L.labelled(_inp(spark, sf_dir))


@query
def delivery_day(spark, sf_dir):
    return r6(_labelled(spark, sf_dir).select(*KEY, "order_date", "settlement_date", "delivery_day"))


@query
def range_join_days_off(spark, sf_dir):
    """Off days per distinct (order date, settlement date) range of the cleaned lines."""
    inp = _inp(spark, sf_dir)
    ranges = L.cleaned(inp).select("order_date", "settlement_date").distinct()
    return r6(joins.days_off(ranges, inp.day_off, guards=()))


@query
def days_off_count(spark, sf_dir):
    return r6(_labelled(spark, sf_dir).select(*KEY, "order_key", "days_off_count"))


@query
def day_processing(spark, sf_dir):
    return r6(_labelled(spark, sf_dir).select(*KEY, "delivery_day", "days_off_count", "day_processing"))


@query
def cond_labels(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    return lab.select(*KEY, *[double_to_yes_no(c).alias(c) for c in ("ontime", "infull", "difot")])


@query
def label_numeric(spark, sf_dir):
    yn = cond_labels(spark, sf_dir)
    return yn.select(*KEY, *[yes_no_to_double(c).alias(c) for c in ("ontime", "infull", "difot")])


@query
def difot_label(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    return r6(lab.groupBy("difot").agg(F.count(F.lit(1)).alias("rows"),
                                       F.sum("days_off_count").alias("sum_days_off"),
                                       F.sum("day_processing").alias("sum_day_processing"),
                                       F.sum("ontime").alias("sum_ontime"),
                                       F.sum("infull").alias("sum_infull")))


@query
def composite_keys(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    return lab.select(*KEY, order_key().alias("order_key"), order_key3().alias("key"))


# ---------------------------------------------------------------- stage 2

def _enriched(spark, sf_dir, dedupe=False):
    return L.enriched(_inp(spark, sf_dir), dedupe)


def _for_kpi(spark, sf_dir):
    """The enriched lines for distinct counts of orders, which need neither the free-good flag nor its repeats."""
    return L.enriched(_inp(spark, sf_dir), flag_last=True)


def _enriched_columns(spark, sf_dir, *columns: str) -> DataFrame:
    """Some columns of the enriched lines, written once for queries of several passes (a stage)."""
    from shipshape.plans.stages import materialized
    return materialized(spark, sf_dir, f"enriched-{'-'.join(columns)}", lambda: _enriched(spark, sf_dir).select(*columns))


@query
def join_urban(spark, sf_dir):
    u = L.with_rates(_inp(spark, sf_dir))
    return r6(u.select(*KEY, "city", "province_standard", "urban_rate"))


@query
def count_by_urban_rate(spark, sf_dir):
    u = L.with_rates(_inp(spark, sf_dir))
    return r6(u.groupBy("urban_rate").agg(F.count(F.lit(1)).alias("count")))


@query
def sql_view_distinct(spark, sf_dir):
    L.with_rates(_inp(spark, sf_dir)).createOrReplaceTempView("urban_table")
    return r6(spark.sql("SELECT DISTINCT urban_rate FROM urban_table"))


@query
def join_free_good_fanout(spark, sf_dir):
    return r6(_enriched(spark, sf_dir).select(*KEY, "isfreegood_order_no"))


@query
def join_free_good_flag(spark, sf_dir):
    return r6(_enriched(spark, sf_dir, dedupe=True).select(*KEY, "isfreegood_order_no"))


@query
def flag_free_good(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return r6(e.groupBy("isfreegood_order_no").agg(F.count(F.lit(1)).alias("rows"),
                                                   F.countDistinct("order_no").alias("orders")))


@query
def describe_flag(spark, sf_dir):
    return r6(stats.describe(_enriched(spark, sf_dir), "isfreegood_order_no"))


# ---------------------------------------------------------------- KPI

@query
def kpi_by_customer(spark, sf_dir):
    return r6(kpi.kpi(_for_kpi(spark, sf_dir), "customer_code", "gps_cus_longitude", "gps_cus_latitude"))


@query
def kpi_by_pack_type(spark, sf_dir):
    k = kpi.kpi(_for_kpi(spark, sf_dir), "pack_type").dropna(subset=["pack_type"])
    return r6(k.orderBy(F.col("difot_pct").desc(), "pack_type"))


@query
def kpi_by_urban_rate(spark, sf_dir):
    return r6(kpi.kpi(_for_kpi(spark, sf_dir), "urban_rate"))


@query
def kpi_by_region_item(spark, sf_dir):
    return r6(kpi.kpi(_for_kpi(spark, sf_dir), "region", "item_code"))


@query
def kpi_by_order_date(spark, sf_dir):
    return r6(kpi.kpi(_for_kpi(spark, sf_dir), "order_date"))


@query
def kpi_monthly_trend(spark, sf_dir):
    daily = kpi.kpi(_for_kpi(spark, sf_dir), "order_date")
    return r6(kpi.kpi_monthly(daily).orderBy("month_year"))


def _customer_points(spark, sf_dir):
    k = kpi.kpi(_for_kpi(spark, sf_dir), "customer_code", "gps_cus_longitude", "gps_cus_latitude")
    return cleaning.clean_points(k, "gps_cus_latitude", "gps_cus_longitude")


@query
def customer_geo_points(spark, sf_dir):
    return r6(_customer_points(spark, sf_dir))


@query
def nearest_centre(spark, sf_dir):
    pts = _customer_points(spark, sf_dir)
    n = nearest.nearest_centre(pts, fixtures.centres(spark, sf_dir), "gps_cus_latitude", "gps_cus_longitude")
    return r6(n.select("customer_code", "gps_cus_latitude", "gps_cus_longitude", "nearest_city", "nearest_city_km"))


def _by_centre(points: DataFrame) -> DataFrame:
    return points.groupBy("nearest_city").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("difot_pct").alias("difot_pct"),
        F.min_by("gps_cus_latitude", "customer_code").alias("gps_cus_latitude"),
        F.min_by("gps_cus_longitude", "customer_code").alias("gps_cus_longitude"))


@query
def nearest_distributor(spark, sf_dir):
    """Each customer's nearest distributor by great circle: a list that grows with the data, joined."""
    from shipshape.plans.stages import materialized
    gps = _inp(spark, sf_dir).gps_distributor.where("latitude >= 1 AND longitude >= 1")
    listed = gps.select(F.expr("CAST(substring(customerid, 2) AS BIGINT)").alias("seq"), F.col("customerid").alias("city"),
                        "latitude", "longitude")
    pts = materialized(spark, sf_dir, "customer-points", lambda: _customer_points(spark, sf_dir).select(
        "customer_code", "gps_cus_latitude", "gps_cus_longitude"))
    return r6(nearest.nearest_centre_join(pts, listed, "gps_cus_latitude", "gps_cus_longitude", "distributor"))


@query
def kpi_by_centre(spark, sf_dir):
    pts = _customer_points(spark, sf_dir)
    n = nearest.nearest_centre(pts, fixtures.centres(spark, sf_dir), "gps_cus_latitude", "gps_cus_longitude")
    return r6(_by_centre(n))


@query
def src_centres(spark, sf_dir):
    """The reference's 70 city centres as a source, used for the customers' nearest city."""
    pts = _customer_points(spark, sf_dir)
    n = nearest.nearest_centre(pts, literals.city_centres(spark), "gps_cus_latitude", "gps_cus_longitude")
    return r6(_by_centre(n))


# ---------------------------------------------------------------- distributions

@query
def histogram_distance(spark, sf_dir):
    return r6(stats.histogram(_labelled(spark, sf_dir), "distance_km"))


@query
def histogram_table(spark, sf_dir):
    return stats.histogram_table(stats.histogram(_labelled(spark, sf_dir), "distance_km"))


def _region_items(spark, sf_dir):
    """The KPI of every region and item (a stage: a pivot lists the regions first)."""
    from shipshape.plans.stages import materialized
    return materialized(spark, sf_dir, "region-items", lambda: kpi.kpi(_for_kpi(spark, sf_dir), "region", "item_code"))


@query
def pivot_item_region(spark, sf_dir):
    k = _region_items(spark, sf_dir)
    return r6(kpi.pivot_kpi(k, kpi.FIXTURE_REGION_CODES))


@query
def top_items_pivot(spark, sf_dir):
    k = _region_items(spark, sf_dir)
    return r6(kpi.top_items(kpi.pivot_kpi(k, kpi.FIXTURE_REGION_CODES), 20))


@query
def median_by_rank(spark, sf_dir):
    """The row-number form of the median: the value at the middle ranks of the population."""
    pop = cleaning.valid_gps(L.pair_distances(_inp(spark, sf_dir)))
    n, at = ranks.values_at_ranks(pop, "distance_km", lambda n: [(n + 1) // 2, n // 2 + 1], "n_lines")
    median = (at[(n + 1) // 2] + at[n // 2 + 1]) / 2 if n else None
    return r6(spark.createDataFrame([(n, median)], "n long, median_distance double"))


@query
def row_number_by_distance(spark, sf_dir):
    """Every line of the median's population with its place in the order of the distance; ties by the line's key."""
    from shipshape.plans.stages import materialized
    pop = materialized(spark, sf_dir, "population", lambda: cleaning.valid_gps(L.with_distance(_inp(spark, sf_dir))).select(
        *KEY, F.round("distance_km", 6).alias("distance_km")))
    return r6(ranking.global_row_number(pop, ["distance_km", *KEY]))


@query
def normality_shapiro_francia(spark, sf_dir):
    """Of the filled distances of all lines, by normal scores of their ranks."""
    return r6(ranking.shapiro_francia(_filled(spark, sf_dir), "distance_km"))


@query
def box_distance_by_pack_type(spark, sf_dir):
    """The box-plot numbers of the delivery distance for every pack type, exact, all groups at once."""
    return r6(ranking.grouped_quantiles(_enriched_columns(spark, sf_dir, "pack_type", "distance_km"), ["pack_type"], "distance_km", [0.0, 0.25, 0.5, 0.75, 1.0],
                                        ["min", "q1", "median", "q3", "max"]))


# ---------------------------------------------------------------- feature preparation

def _sample(spark, sf_dir):
    return features.sample_by_key(_enriched(spark, sf_dir), "order_no", 10, 1, 1505)


MF_KEYS = ["k_order_no", "k_item_code", "k_distributor_code", "k_totalec_so"]


def _model_frame(spark, sf_dir, fill=True):
    return features.model_frame(_enriched(spark, sf_dir), fill=fill)


def _model_columns(spark, sf_dir, *columns: str) -> DataFrame:
    """Some columns of the filled model frame, all if none is named, for queries of several passes (a stage)."""
    from shipshape.plans.stages import materialized
    return materialized(spark, sf_dir, f"model-{'-'.join(columns)}",
                        lambda: (f := _model_frame(spark, sf_dir)).select(*(columns or f.columns)))


def _categories(spark, sf_dir) -> DataFrame:
    return _model_columns(spark, sf_dir, *MF_KEYS, *features.CATEGORICAL_FEATURES)


@query
def sample_by_key(spark, sf_dir):
    return r6(_sample(spark, sf_dir).select(*KEY, "difot"))


@query
def class_distribution_before(spark, sf_dir):
    return r6(stats.class_distribution(_enriched(spark, sf_dir), "difot"))


@query
def rename_swap(spark, sf_dir):
    s = features.swap_names(_enriched(spark, sf_dir).select(*KEY, "channelname", "segmentation"),
                            "channelname", "segmentation")
    return s


@query
def audit_nulls(spark, sf_dir):
    mf = _model_frame(spark, sf_dir, fill=False)
    return cleaning.null_audit(mf, [c for c in mf.columns if not c.startswith("k_")])


@query
def fill_category_defaults(spark, sf_dir):
    return r6(_model_frame(spark, sf_dir).select(*MF_KEYS, *cleaning.CATEGORY_DEFAULTS))


@query
def date_parts(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return r6(e.select(*KEY, "order_date", F.month("order_date").alias("month"), F.year("order_date").alias("year"),
                       F.date_format("order_date", "yyyy-MM").alias("month_year"),
                       F.to_date(F.date_format("order_date", "yyyy-MM"), "yyyy-MM").alias("month_start")))


@query
def model_frame(spark, sf_dir):
    return r6(_model_frame(spark, sf_dir))


@query
def one_hot_encode(spark, sf_dir):
    return r6(features.one_hot_long(_categories(spark, sf_dir), MF_KEYS))


@query
def one_hot_fitted(spark, sf_dir):
    """The same columns by a fitted encoder that was saved and loaded again."""
    path = remembered(spark, sf_dir, "encoder", lambda: _saved_encoder(spark, sf_dir))
    return r6(features.encode_long(_categories(spark, sf_dir), path, MF_KEYS))


def _saved_encoder(spark, sf_dir) -> str:
    path = scratch_dir(spark, "encoder")
    features.fit_encoder(_categories(spark, sf_dir), path)
    return path


@query
def feature_matrix(spark, sf_dir):
    return r6(features.encoded_features(_model_frame(spark, sf_dir), MF_KEYS, features.FIXTURE_FEATURES))


@query
def train_test_split(spark, sf_dir):
    return features.split_by_key(_model_frame(spark, sf_dir), "k_order_no", 20, 1505).select(
        *MF_KEYS, "label", "is_test")


def _folds(spark, sf_dir):
    return features.stratified_folds(_model_columns(spark, sf_dir, *MF_KEYS, "distance_km", "label"), 5, "label", MF_KEYS,
                                     1505)


@query
def stratified_folds(spark, sf_dir):
    return r6(_folds(spark, sf_dir).select(*MF_KEYS, "label", "fold"))


CORR_COLUMNS = ["totalnsr_so", "totalec_so", "distance_km", "delivery_day", "days_off_count", "day_processing",
                "ontime", "infull", "difot", "urban_rate", "isfreegood_order_no"]


@query
def correlation_matrix(spark, sf_dir):
    return r6(stats.correlation(_enriched_columns(spark, sf_dir, *CORR_COLUMNS), CORR_COLUMNS))


@query
def correlation_lower(spark, sf_dir):
    return r6(stats.lower_triangle(stats.correlation(_enriched_columns(spark, sf_dir, *CORR_COLUMNS), CORR_COLUMNS)))


@query
def normality_jarque_bera(spark, sf_dir):
    """Of the filled distances before the outlier filter, whose choice the test serves."""
    return r6(stats.jarque_bera(L.filled_lines(_inp(spark, sf_dir)), "distance_km"))


# ---------------------------------------------------------------- metrics on a deterministic rule

def _rule(df: DataFrame, spark, sf_dir) -> DataFrame:
    """prediction = 1 when the distance is below the median distance (a fixed rule)."""
    m = L.median_distance(_inp(spark, sf_dir))[1]
    return df.withColumn("prediction", F.when(F.col("distance_km") < m, 1.0).otherwise(0.0))


def _pred(spark, sf_dir):
    return _rule(_enriched(spark, sf_dir).withColumn("label", F.col("difot")), spark, sf_dir)


@query
def metrics_weighted(spark, sf_dir):
    return r6(metrics.weighted(_pred(spark, sf_dir)))


@query
def metrics_per_class(spark, sf_dir):
    return r6(metrics.per_class(_pred(spark, sf_dir)))


@query
def fit_verdict(spark, sf_dir):
    p = features.split_by_key(_pred(spark, sf_dir), "order_no", 20, 1505)  # noqa: E501
    acc = p.agg(*[(F.sum(F.when((F.col("is_test") == t) & (F.col("label") == F.col("prediction")), 1).otherwise(0))
                   / F.sum(F.when(F.col("is_test") == t, 1).otherwise(0))).alias(n)
                  for t, n in ((0, "train_accuracy"), (1, "test_accuracy"))])
    return r6(acc.withColumn("verdict", metrics.fit_verdict(F.col("train_accuracy"), F.col("test_accuracy"))))


def _fold_scores(spark, sf_dir):
    p = _rule(_folds(spark, sf_dir), spark, sf_dir)
    w = metrics.weighted(p, keys=["fold"])
    return w.select("fold", F.col("accuracy").alias("Accuracy"), F.col("precision_pos").alias("Precision"),
                    F.col("recall_pos").alias("Recall"), F.col("f1_pos").alias("F1"))


@query
def unpivot_metrics(spark, sf_dir):
    return r6(stats.unpivot(_fold_scores(spark, sf_dir), ["fold"], ["Accuracy", "Precision", "Recall", "F1"]))


@query
def cv_fold_summary(spark, sf_dir):
    long = stats.unpivot(_fold_scores(spark, sf_dir), ["fold"], ["Accuracy", "Precision", "Recall", "F1"])
    return r6(stats.fold_summary(long, ["metric"]))


@query
def box_summary(spark, sf_dir):
    long = stats.unpivot(_fold_scores(spark, sf_dir), ["fold"], ["Accuracy", "Precision", "Recall", "F1"])
    return r6(stats.five_number(long, ["metric"]))


# ---------------------------------------------------------------- CSV sources and sinks

from shipshape.session import scratch_dir, staged  # noqa: E402
from shipshape.sources import files  # noqa: E402

FACT_TYPES = {**{c: "double" for c in ("totalec_sr", "totalnsr_sr", "totalnsr_so", "totalec_so", "diff_ec",
                                       "diff_nsr")},
              "order_date": ("date", "dd-MM-yyyy"), "settlement_date": ("date", "dd-MM-yyyy")}


def _fact_csv(spark, sf_dir) -> str:
    """The fact as text CSV with reference date patterns; a repeated header line is
    planted inside the data and missing numbers / dates are written as 'N/A'."""
    fact = fixtures.order_lines(spark, sf_dir)
    text = files.as_text(fact, {"order_date": "dd-MM-yyyy", "settlement_date": "dd-MM-yyyy"},
                         {"settlement_date": "N/A", "diff_ec": "N/A"})
    header_row = spark.createDataFrame([tuple(fixtures.FACT_COLUMNS)], files.string_schema(fixtures.FACT_COLUMNS))
    path = scratch_dir(spark, "fact-csv")
    files.write_csv(text.unionByName(header_row), path)
    return path


def _fact_from_csv(spark, sf_dir) -> DataFrame:
    raw = files.read_table(spark, _fact_csv(spark, sf_dir), fixtures.FACT_COLUMNS)
    return files.typed(raw, FACT_TYPES)


@query
def src_csv_header(spark, sf_dir):
    return r6(_fact_from_csv(spark, sf_dir).select(*fixtures.FACT_COLUMNS))


@query
def typed_dates(spark, sf_dir):
    f = _fact_from_csv(spark, sf_dir)
    cal = fixtures.day_off(spark, sf_dir)
    cal_path = scratch_dir(spark, "dayoff-csv")
    files.write_csv(files.as_text(cal, {"d_date": "dd-MMM-yy", "eomonth_ko": "dd-MMM-yy"}), cal_path)
    cal_back = files.typed(files.read_table(spark, cal_path, ["d_date", "eomonth_ko", "year"]),
                           {"d_date": ("date", "dd-MMM-yy"), "eomonth_ko": ("date", "dd-MMM-yy"), "year": "double"})
    days = cal_back.groupBy("d_date").agg(F.count(F.lit(1)).alias("listed"))
    return f.select(*KEY, "order_date", "settlement_date").join(
        days.withColumnRenamed("d_date", "order_date"), "order_date", "left").fillna(0, ["listed"])


@query
def typed_cast(spark, sf_dir):
    return r6(_fact_from_csv(spark, sf_dir).select(*KEY, "totalec_sr", "totalnsr_sr", "totalnsr_so", "diff_ec",
                                                   "diff_nsr"))


LABELLED_TYPES = {**FACT_TYPES, "order_date": ("date", "yyyy-MM-dd"), "settlement_date": ("date", "yyyy-MM-dd"),
                  **{c: "double" for c in L.GPS_COLUMNS + ["distance_km", "delivery_day", "days_off_count",
                                                            "day_processing", "ontime", "infull", "difot"]}}


@query
def sink_csv_gzip_roundtrip(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    path = files.write_csv_gz(lab, scratch_dir(spark, "labelled-csv-gz"))
    back = files.typed(files.read_parts(spark, path, lab.columns), LABELLED_TYPES)
    return r6(back.select(*KEY, "order_date", "settlement_date", "distance_km", "days_off_count", "difot"))


#: Rows of a gzip part at most; a part is read by one task, so its size must not grow with the table.
PART_ROWS = 250_000


@query
def src_multi_gzip(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    path = files.write_csv_gz(e, scratch_dir(spark, "enriched-parts"), max_rows=PART_ROWS)
    back = files.typed(files.read_parts(spark, path, e.columns),
                       {**LABELLED_TYPES, "urban_rate": "double", "isfreegood_order_no": "double"})
    return r6(back.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("difot").alias("difot_rows"),
                                         F.sum("isfreegood_order_no").alias("free_good_rows"),
                                         F.sum("distance_km").alias("sum_distance_km")))


# ---------------------------------------------------------------- NearMiss and k-NN

from shipshape.operators import knn_lsh, nearmiss as nm  # noqa: E402
from shipshape.operators.knn import knn_mean  # noqa: E402
from shipshape.plans.stages import materialized, remembered  # noqa: E402


def _selected(spark, sf_dir):
    """Row keys, the 15 selected features and the label of every line (a stage)."""
    return materialized(spark, sf_dir, "selected", lambda: features.encoded_features(
        _model_frame(spark, sf_dir), MF_KEYS, features.FIXTURE_FEATURES))


def _nearmiss(spark, sf_dir):
    """The balanced model frame with its 15 selected features (a stage)."""
    def build():
        frame = _selected(spark, sf_dir)
        return nm.nearmiss(frame, features.FIXTURE_FEATURES, "label", MF_KEYS, 3)
    return materialized(spark, sf_dir, "nearmiss", build)


@query
def nearmiss_undersample(spark, sf_dir):
    return r6(_nearmiss(spark, sf_dir).select(*MF_KEYS, "label"))


@query
def knn_hashed_recall(spark, sf_dir):
    """Neighbours of the larger class in the smaller one by hashing, against the exact join: whether at least nine tenths of the
    lines keep their mean distance."""
    def build():
        frame = _selected(spark, sf_dir).drop(*MF_KEYS)
        small, large = (r.label for r in frame.groupBy("label").count().orderBy("count", "label").collect())
        names = features.FIXTURE_FEATURES
        lines = frame.fillna(0.0, names)
        asked, held = lines.where(F.col("label") == large).select(*names), lines.where(F.col("label") == small).select(*names)
        hashed = staged(knn_lsh.approx_knn_mean(asked, held, names, 3), "hashed")
        vs = [F.col(c).alias(f"_v{i}") for i, c in enumerate(names)]
        exact = knn_mean(asked.distinct().select(*vs), held.select(*vs).groupBy(*[f"_v{i}" for i in range(len(names))]).agg(
            F.count(F.lit(1)).alias("_m")), len(names), 3)
        exact = exact.select(*[F.col(f"_v{i}").alias(c) for i, c in enumerate(names)], F.col("knn_mean").alias("true_mean"))
        right = F.abs(F.col("knn_mean") - F.col("true_mean")) <= 1e-6
        return hashed.join(exact.hint("merge"), names).agg(F.count(F.lit(1)).alias("points"), (F.avg(right.cast("int")) >= 0.9).alias("recalled"),
                                             (F.min(F.col("knn_mean") - F.col("true_mean")) > -1e-6).alias("none_below"))
    return materialized(spark, sf_dir, "knn-hashed", build)


@query
def class_distribution_after(spark, sf_dir):
    return r6(stats.class_distribution(_nearmiss(spark, sf_dir), "label"))


def _knn_predictions(spark, sf_dir):
    def build():
        split = features.split_by_key(_nearmiss(spark, sf_dir), "k_order_no", 20, 1505)
        return nm.knn_vote(split.filter("is_test = 0"), split.filter("is_test = 1"), features.FIXTURE_FEATURES,
                           "label", 5)
    return materialized(spark, sf_dir, "knn-vote", build)


@query
def knn_vote(spark, sf_dir):
    """5-NN vote on the 15 features: train rows (split 0) predict test rows (split 1)."""
    return r6(metrics.weighted(_knn_predictions(spark, sf_dir)))


# ---------------------------------------------------------------- models

from shipshape.operators import boosting, extra_trees, kernel, models  # noqa: E402


def _training(spark, sf_dir) -> DataFrame:
    """The balanced rows as assembled vectors (NULL features as 0) with the hash split, the folds and
    ``fit``, which marks the rows that models are fitted on: all training rows (a stage)."""
    def build():
        fm = _nearmiss(spark, sf_dir).fillna(0.0, features.FIXTURE_FEATURES)
        fm = features.split_by_key(fm, "k_order_no", 20, 1505)
        fm = features.stratified_folds(fm, 5, "label", MF_KEYS, 1505)
        return fm.withColumn("fit", 1 - F.col("is_test"))
    return features.assemble(materialized(spark, sf_dir, "training", build), features.FIXTURE_FEATURES)


def _scored(spark, sf_dir, kind, **kw) -> DataFrame:
    """(label, prediction, is_test, fit): all balanced rows scored by the model (a stage)."""
    def build():
        t = _training(spark, sf_dir)
        model = models.estimator(kind, **kw).fit(models.spread(t.filter("fit = 1")))
        return model.transform(t).select(*MF_KEYS, "label", "prediction", "is_test", "fit")
    return materialized(spark, sf_dir, "-".join(["scored", kind, *(f"{k}{v}" for k, v in sorted(kw.items()))]), build)


def _fit_query(kind, **kw):
    def run(spark, sf_dir):
        held = _scored(spark, sf_dir, kind, **kw).filter("is_test = 1")
        return r6(metrics.weighted(held).withColumn("model", F.lit(kind)))
    run.__name__ = f"model_{kind}"
    return run


QUERIES["model_decision_tree"] = _fit_query("dt")
QUERIES["model_random_forest"] = _fit_query("rf")
QUERIES["model_gbt"] = _fit_query("gbt", max_iter=200)
QUERIES["model_logistic"] = _fit_query("lr")
QUERIES["model_linear_svc"] = _fit_query("svc")


def _kernel_frame(spark, sf_dir) -> DataFrame:
    """The balanced rows with Fourier features in place of the selected columns, scaled by the training rows (a stage)."""
    def build():
        t = _training(spark, sf_dir).drop("features")
        scale = kernel.scaling(t.filter("is_test = 0"), features.FIXTURE_FEATURES)
        return kernel.with_fourier(t, features.FIXTURE_FEATURES, scale).select("label", "is_test", "fold", "features")
    return materialized(spark, sf_dir, "fourier", build)


@query
def model_kernel_svm(spark, sf_dir):
    """A support vector machine with a Gaussian kernel, approximated, fitted on all training rows."""
    t = _kernel_frame(spark, sf_dir)
    s = models.train_and_score(models.compact(t.filter("is_test = 0")), t.filter("is_test = 1"), "svc")
    return r6(s.withColumn("model", F.lit("kernel_svm")))


@query
def kernel_svm_folds(spark, sf_dir):
    """Accuracy by fold on the training part, with the kernel and without."""
    def folds(name, frame):
        return materialized(spark, sf_dir, f"folds-{name}", lambda: models.cross_validate(
            frame.filter("is_test = 0"), "svc", 5, parallel=5)).withColumn("model", F.lit(name))
    both = folds("kernel_svm", _kernel_frame(spark, sf_dir)).unionByName(folds("linear_svm", _training(spark, sf_dir)))
    return r6(both.select("model", "fold", "accuracy"))


@query
def model_fit_verdict(spark, sf_dir):
    """Over- or underfitting of the trained models: all four metrics on the fitted and the held-out rows."""
    parts = []
    for kind in ("dt", "rf"):
        s = _scored(spark, sf_dir, kind)
        both = [metrics.weighted(s.filter(c)).select(*[F.col(m).alias(f"{side}_{m}") for m in
                ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")])
                for side, c in (("train", "fit = 1"), ("test", "is_test = 1"))]
        parts.append(both[0].join(F.broadcast(both[1])).withColumn("model", F.lit(kind)))
    v = parts[0].unionByName(parts[1])
    return r6(v.withColumn("verdict", metrics.fit_verdict(F.col("train_accuracy"), F.col("test_accuracy"))))


@query
def feature_importance_top15(spark, sf_dir):
    """Importance before selection: a forest over all numeric and one-hot columns, of which the
    best 15 are taken."""
    def build():
        frame = features.split_by_key(_model_columns(spark, sf_dir), "k_order_no", 20, 1505).filter("is_test = 0")
        path = remembered(spark, sf_dir, "encoder", lambda: _saved_encoder(spark, sf_dir))
        fm, names = features.encoded_vectors(frame, path, ["label"])
        return models.importances(models.estimator("rf").fit(models.spread(fm)), names)
    imp = materialized(spark, sf_dir, "importances", build)
    return r6(imp.orderBy(F.col("importance").desc(), "feature").limit(15))


def _all_columns(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """The training lines with every numeric and one-hot column, before selection and balancing (a stage)."""
    names = remembered(spark, sf_dir, "all-features", lambda: features.all_features(_model_columns(spark, sf_dir)))

    def build():
        frame = features.split_by_key(_model_columns(spark, sf_dir), "k_order_no", 20, 1505).filter("is_test = 0")
        return features.encoded_features(frame, [], names)
    return materialized(spark, sf_dir, "all-columns", build), names


@query
def importance_extra_trees(spark, sf_dir):
    """The 15 greatest importances of 50 extremely randomised trees over all training lines and all columns."""
    def build():
        rows, names = _all_columns(spark, sf_dir)
        forest = extra_trees.grow(rows, names, "label", trees=50, depth=8)
        return spark.createDataFrame(list(zip(names, forest.importances())), "feature string, importance double")
    imp = materialized(spark, sf_dir, "importances-extra", build)
    return r6(imp.orderBy(F.col("importance").desc(), "feature").limit(15))


@query
def boosting_split_gains(spark, sf_dir):
    """Every split of the first tree's root that second-order boosting weighs, with its gain, over all lines."""
    s = boosting.Settings()
    frame = materialized(spark, sf_dir, "selected-columns", lambda: features.encoded_features(
        _model_frame(spark, sf_dir), [], features.FIXTURE_FEATURES))
    edges = boosting.quantile_edges(frame, features.FIXTURE_FEATURES, s.bins)
    rows = boosting.binned(frame, features.FIXTURE_FEATURES, edges, ["label"]).withColumn("margin", F.lit(0.0))
    gains = boosting.split_gains(boosting.level_sums(rows, [], {}, [1]), edges, s)
    return r6(spark.createDataFrame(
        [(features.FIXTURE_FEATURES[f], edges[f][b], left, gain, gl, hl) for _, f, b, left, gain, _, _, gl, hl in gains],
        "feature string, threshold double, missing_left boolean, gain double, left_g double, left_h double"))


def _boosted(spark, sf_dir, rounds: int = 30) -> DataFrame:
    """(label, prediction, is_test) of all balanced lines by trees fitted on all training lines (a stage)."""
    def build():
        t = _training(spark, sf_dir)
        model = boosting.fit(t.filter("is_test = 0"), features.FIXTURE_FEATURES, "label", boosting.Settings(rounds=rounds))
        return boosting.predict(model, t, ["label", "is_test"])
    return materialized(spark, sf_dir, f"boosted-{rounds}", build)


@query
def model_boosted_trees(spark, sf_dir):
    """30 second-order boosted trees of depth 6, fitted on all training lines, on the held-out ones."""
    return r6(metrics.weighted(_boosted(spark, sf_dir).filter("is_test = 1")).withColumn("model", F.lit("boosted")))


def _gbt_nodes(spark, sf_dir):
    def build():
        m = models.estimator("gbt", max_iter=100).fit(models.spread(_training(spark, sf_dir).filter("fit = 1")))
        return models.node_table(m)
    return materialized(spark, sf_dir, "gbt-nodes", build)


@query
def feature_split_count_top5(spark, sf_dir):
    sc = models.split_counts(_gbt_nodes(spark, sf_dir), features.FIXTURE_FEATURES)
    return sc.orderBy(F.col("splits").desc(), "feature").limit(5)


@query
def tree_paths(spark, sf_dir):
    """Every leaf of tree 9 with the conditions that lead to it."""
    return r6(models.tree_paths(_gbt_nodes(spark, sf_dir), features.FIXTURE_FEATURES, 9))


@query
def tree_nodes(spark, sf_dir):
    nodes = _gbt_nodes(spark, sf_dir).filter(F.col("tree_id") == 9)
    names = spark.createDataFrame(list(enumerate(features.FIXTURE_FEATURES)), "feature_index int, feature string")
    return r6(nodes.join(F.broadcast(names), "feature_index", "left"))


def _fold_table(spark, sf_dir, kind, part, **kw):
    """The fold scores of a model over all training rows, or all test rows, fitted on all of the other folds (a stage)."""
    def build():
        t = _training(spark, sf_dir).filter("is_test = 0" if part == "train" else "is_test = 1")
        with models.folds_at_once(5):
            return models.cross_validate(t, kind, 5, fit="fit = 1" if part == "train" else None, **kw)
    return materialized(spark, sf_dir, f"folds-{kind}-{part}", build)


@query
def cross_validate_train(spark, sf_dir):
    """Accuracy by fold on the training part, for the decision tree, the forest and the boosted trees."""
    parts = [_fold_table(spark, sf_dir, kind, "train", **kw).withColumn("model", F.lit(kind))
             for kind, kw in (("dt", {}), ("rf", {}), ("gbt", {"max_iter": 100}))]
    return r6(reduce(DataFrame.unionByName, parts).select("model", "fold", "accuracy"))


@query
def cross_validate_gbt(spark, sf_dir):
    """The four metrics by fold on the test part."""
    return r6(_fold_table(spark, sf_dir, "gbt", "test", max_iter=100))


@query
def model_comparison_recorded(spark, sf_dir):
    """Each model's mean fold accuracy here beside the recorded one, with both ranks."""
    names = {"DT": "dt", "RF": "rf", "XGB": "gbt", "SVM": "svc", "LR": "lr", "KNN": "knn"}
    recorded = literals.recorded_folds(spark).where("metric = 'Accuracy' AND model <> 'XGB-final'").replace(names, subset="model")
    mean = stats.fold_summary(recorded, ["model"]).select("model", F.col("mean").alias("recorded"))
    here = model_comparison(spark, sf_dir).select("model", "folds", "mean")
    both = here.join(F.broadcast(mean), "model")
    rank = lambda c: (F.lit(1) + F.size(F.filter(F.col("all"), lambda o: o[c] > F.col(c)))).alias(f"{c}_rank")
    every = both.agg(F.collect_list(F.struct("mean", "recorded"))).scalar()  # one entry per model
    return r6(both.withColumn("all", every).select("model", "folds", "mean", "recorded", rank("mean"), rank("recorded")))


@query
def model_comparison(spark, sf_dir):
    parts = [_fold_table(spark, sf_dir, kind, "train", **kw).withColumn("model", F.lit(kind))
             for kind, kw in (("dt", {}), ("rf", {}), ("gbt", {"max_iter": 100}), ("lr", {}), ("svc", {}), ("knn", {}))]
    folds = reduce(DataFrame.unionByName, parts)
    return r6(stats.five_number(folds, ["model"], "accuracy")
              .join(stats.fold_summary(folds, ["model"], "accuracy"), "model"))
