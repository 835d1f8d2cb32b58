"""DuckDB SQL that recomputes each checkable query independently.

The driver registers the parquet tables as views and runs these texts next to
the Spark queries. The fixtures are rebuilt here from the same formulas
(FIXTURES.md); the stage logic is written the way the reference states it
(row-level median, literal range join for the days off, text keys), so the two
engines share no plan. Doubles are rounded to 6 digits, as on the Spark side.
"""
from __future__ import annotations

KEY = "order_no, item_code, distributor_code, totalec_so"


def rnd(e: str, digits: int = 6) -> str:
    """Round half-up on the shortest decimal text of the double, as Spark's ``round``
    does (DuckDB's own ``round`` scales by 10^d first and can differ on exact halves)."""
    return (f"(CASE WHEN isfinite({e}) THEN CAST(round(CAST(CAST({e} AS VARCHAR) AS DECIMAL(38,18)), {digits})"
            f" AS DOUBLE) ELSE {e} END)")


def r6(*cols: str) -> str:
    return ", ".join(f"{rnd(c)} AS {c.split('.')[-1]}" for c in cols)


HAVERSINE = """6371.0e0 * 2 * atan2(sqrt(CASE WHEN {a} > 1.0e0 THEN 1.0e0 ELSE {a} END),
                                  sqrt(1 - CASE WHEN {a} > 1.0e0 THEN 1.0e0 ELSE {a} END))"""


def _a(lat1, lon1, lat2, lon2):
    return (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
            f" * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")


SETTLE_M = "((l.l_orderkey * 7 + l.l_partkey) % 20)"
CTES = [
    ("f_base", f"""
SELECT CAST(o.o_orderdate AS DATE) AS order_date,
       CASE WHEN l.l_orderkey % 101 = 0 THEN NULL
            ELSE CAST(o.o_orderdate AS DATE) + CAST(CASE WHEN {SETTLE_M} < 17 THEN {SETTLE_M} % 3
                                                         WHEN {SETTLE_M} = 17 THEN -1
                                                         WHEN {SETTLE_M} = 18 THEN 5 ELSE 9 END AS INTEGER)
       END AS settlement_date,
       r.r_name AS region,
       'D' || CAST(l.l_suppkey AS VARCHAR) AS distributor_code,
       'C' || CAST(o.o_custkey AS VARCHAR) AS customer_code,
       CASE WHEN l.l_orderkey % 67 = 0 THEN NULL ELSE o.o_orderpriority END AS segmentation,
       c.c_mktsegment AS channelname,
       'SO' || CAST(l.l_orderkey AS VARCHAR) AS order_no,
       'P' || CAST(l.l_partkey AS VARCHAR) AS item_code,
       p.p_brand AS brand,
       CASE WHEN l.l_partkey % 71 = 0 THEN NULL ELSE p.p_type END AS pack_type,
       CAST(p.p_size AS VARCHAR) || 'ML' AS pack_size,
       l.l_quantity AS totalec_so,
       l.l_extendedprice AS totalnsr_so,
       CASE WHEN l.l_partkey % 97 = 0 THEN NULL
            WHEN (l.l_orderkey + l.l_partkey) % 10 = 0 THEN 1.0e0
            WHEN (l.l_orderkey + l.l_partkey) % 10 = 3 THEN 0.05e0
            WHEN (l.l_orderkey + l.l_partkey) % 10 = 7 THEN -0.5e0
            ELSE 0.0e0 END AS diff_ec
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey"""),
    ("f_sr", """
SELECT *, order_no || '-' || item_code AS key_so, totalec_so - coalesce(diff_ec, 0.0e0) AS totalec_sr FROM f_base"""),
    ("f_fact", """
SELECT order_date, settlement_date, region, distributor_code, customer_code, segmentation, channelname,
       order_no, item_code, brand, pack_type, pack_size, key_so, totalec_sr,
       totalnsr_so * totalec_sr / totalec_so AS totalnsr_sr, totalnsr_so, totalec_so, diff_ec,
       totalnsr_so - totalnsr_so * totalec_sr / totalec_so AS diff_nsr
FROM f_sr"""),
    ("f_gps_customer", """
SELECT 'C' || CAST(c_custkey AS VARCHAR) AS customerid,
       CASE WHEN c_custkey % 83 = 0 THEN NULL WHEN c_custkey % 79 = 0 THEN 0.0e0
            ELSE 10.70e0 + (c_custkey * 37 % 97) / 1000.0e0 + CASE WHEN c_custkey % 50 = 0 THEN 2.0e0 ELSE 0.0e0 END
       END AS latitude,
       CASE WHEN c_custkey % 83 = 0 THEN NULL WHEN c_custkey % 79 = 0 THEN 0.0e0
            ELSE 106.60e0 + (c_custkey * 53 % 89) / 1000.0e0 END AS longitude
FROM customer WHERE c_custkey % 89 <> 0"""),
    ("f_gps_distributor", """
SELECT 'D' || CAST(s_suppkey AS VARCHAR) AS customerid,
       CASE WHEN s_suppkey % 47 = 0 THEN 0.0e0 ELSE 10.70e0 + (s_suppkey * 31 % 97) / 1000.0e0 END AS latitude,
       CASE WHEN s_suppkey % 47 = 0 THEN 0.0e0 ELSE 106.60e0 + (s_suppkey * 41 % 89) / 1000.0e0 END AS longitude
FROM supplier WHERE s_suppkey % 43 <> 1"""),
    ("f_days", """
SELECT CAST(unnest(generate_series(CAST(make_date(y0, 1, 1) AS TIMESTAMP), CAST(make_date(y1 + 1, 12, 31) AS TIMESTAMP),
                                   INTERVAL 1 DAY)) AS DATE) AS d_date
FROM (SELECT CAST(year(min(o_orderdate)) AS INTEGER) AS y0, CAST(year(max(o_orderdate)) AS INTEGER) AS y1 FROM orders)"""),
    ("f_day_off", """
SELECT d_date FROM f_days WHERE dayofweek(d_date) = 0
UNION ALL
SELECT d_date FROM f_days WHERE strftime(d_date, '%m-%d') IN ('01-01', '04-30', '05-01', '09-02')"""),
    ("f_urban", """
SELECT 'C' || CAST(c.c_custkey AS VARCHAR) AS customerid, n.n_name AS city, r.r_name AS province_standard,
       CASE WHEN c.c_custkey % 59 = 0 THEN NULL ELSE CAST(20.5e0 + (n.n_nationkey * 13 % 60) AS DOUBLE) END AS urban_rate
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE c.c_custkey % 61 <> 0"""),
    ("f_free_good", """
SELECT CAST(o_orderdate AS DATE) AS order_date, 'SO' || CAST(o_orderkey AS VARCHAR) AS order_no,
       'C' || CAST(o_custkey AS VARCHAR) AS customer_code FROM orders WHERE o_orderkey % 5 = 0
UNION ALL
SELECT CAST(o_orderdate AS DATE), 'SO' || CAST(o_orderkey AS VARCHAR), 'C' || CAST(o_custkey AS VARCHAR)
FROM orders WHERE o_orderkey % 25 = 0"""),
    ("f_centre", """
SELECT CAST(n_nationkey AS INTEGER) AS seq, n_name AS city,
       10.70e0 + (n_nationkey * 29 % 97) / 1000.0e0 AS latitude,
       106.60e0 + (n_nationkey * 23 % 89) / 1000.0e0 AS longitude
FROM nation"""),
    # ---- stage 1, written row by row as the reference does
    ("s_gps", """
SELECT f.*, gc.latitude AS gps_cus_latitude, gc.longitude AS gps_cus_longitude,
       gd.latitude AS gps_dist_latitude, gd.longitude AS gps_dist_longitude
FROM f_fact f
LEFT JOIN f_gps_customer gc ON f.customer_code = gc.customerid
LEFT JOIN f_gps_distributor gd ON f.distributor_code = gd.customerid"""),
    ("s_a", f"""
SELECT *, {_a('gps_cus_latitude', 'gps_cus_longitude', 'gps_dist_latitude', 'gps_dist_longitude')} AS _a FROM s_gps"""),
    ("s_dist", f"""
SELECT * EXCLUDE (_a), {HAVERSINE.format(a='_a')} AS distance_km FROM s_a"""),
    ("s_valid", """
SELECT * FROM s_dist WHERE gps_cus_latitude IS NOT NULL AND gps_cus_longitude IS NOT NULL
                       AND gps_dist_latitude <> 0 AND gps_dist_longitude <> 0"""),
    ("s_median", """
SELECT count(*) AS n, quantile_cont(distance_km, 0.5) AS median_distance FROM s_valid"""),
    ("s_filled", """
SELECT * REPLACE (CASE WHEN gps_cus_latitude = 0 OR gps_cus_longitude = 0 OR gps_dist_latitude = 0
                            OR gps_dist_longitude = 0 OR distance_km IS NULL
                       THEN (SELECT median_distance FROM s_median) ELSE distance_km END AS distance_km)
FROM s_dist"""),
    ("s_bounds", """
SELECT q1, q3, q3 - q1 AS iqr, q1 - 2.0e0 * (q3 - q1) AS lower_bound, q3 + 2.0e0 * (q3 - q1) AS upper_bound
FROM (SELECT quantile_cont(distance_km, 0.25) AS q1, quantile_cont(distance_km, 0.75) AS q3 FROM s_filled)"""),
    ("s_clean", """
SELECT * FROM s_filled
WHERE distance_km >= (SELECT lower_bound FROM s_bounds) AND distance_km <= (SELECT upper_bound FROM s_bounds)"""),
    ("s_dd", """
SELECT *, CAST(settlement_date - order_date AS DOUBLE) AS delivery_day,
       CAST(order_date AS VARCHAR) || '-' || order_no || '-' || CAST(settlement_date AS VARCHAR) || '-' || customer_code
         AS order_key
FROM s_clean"""),
    ("s_offcount", """
SELECT k.order_key, count(DISTINCT c.d_date) AS n
FROM (SELECT DISTINCT order_key, order_date, settlement_date FROM s_dd) k
LEFT JOIN f_day_off c ON c.d_date >= k.order_date AND c.d_date <= k.settlement_date
GROUP BY k.order_key"""),
    ("s_off", """
SELECT d.*, CAST(coalesce(o.n, 0) AS DOUBLE) AS days_off_count
FROM s_dd d LEFT JOIN s_offcount o ON d.order_key = o.order_key"""),
    ("s_proc", """
SELECT *, CASE WHEN delivery_day - days_off_count < 0 THEN 0.0e0 ELSE delivery_day - days_off_count END
            AS day_processing FROM s_off"""),
    ("s_lab2", """
SELECT *, CASE WHEN day_processing <= 2 THEN 1.0e0 ELSE 0.0e0 END AS ontime,
          CASE WHEN diff_ec <= 0.1e0 THEN 1.0e0 ELSE 0.0e0 END AS infull FROM s_proc"""),
    ("s_labelled", """
SELECT *, CASE WHEN ontime = 1.0e0 AND infull = 1.0e0 THEN 1.0e0 ELSE 0.0e0 END AS difot FROM s_lab2"""),
    # ---- stage 2
    ("s_urban", """
SELECT l.*, u.city, u.province_standard, u.urban_rate
FROM s_labelled l LEFT JOIN f_urban u ON l.customer_code = u.customerid
WHERE u.urban_rate IS NOT NULL"""),
    ("s_enriched", """
SELECT u.*, CASE WHEN fg.order_no IS NULL THEN 0.0e0 ELSE 1.0e0 END AS isfreegood_order_no
FROM s_urban u LEFT JOIN f_free_good fg
  ON u.order_date = fg.order_date AND u.order_no = fg.order_no AND u.customer_code = fg.customer_code"""),
]


def with_ctes(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    parts = CTES + (extra or [])
    return "WITH " + ",\n".join(f"{n} AS ({s}\n)" for n, s in parts) + "\n" + body


def kpi_sql(src: str, dims: str) -> str:
    """The reference's conditional distinct counts, verbatim."""
    return (f"SELECT {dims}, count(DISTINCT CASE WHEN difot = 0 THEN order_no END) AS order_non_difot, "
            f"count(DISTINCT CASE WHEN difot = 1 THEN order_no END) AS order_difot FROM {src} GROUP BY {dims}")


def kpi_pct(good: str = "order_difot", bad: str = "order_non_difot", digits: int | None = 6) -> str:
    e = (f"CASE WHEN {good} + {bad} = 0 THEN NULL "
         f"ELSE CAST({good} AS DOUBLE) / CAST({good} + {bad} AS DOUBLE) * 100.0e0 END")
    return (f"round({e}, {digits})" if digits is not None else e) + " AS difot_pct"


GPS = ["gps_cus_latitude", "gps_cus_longitude", "gps_dist_latitude", "gps_dist_longitude"]
FACT = ["order_date", "settlement_date", "region", "distributor_code", "customer_code", "segmentation",
        "channelname", "order_no", "item_code", "brand", "pack_type", "pack_size", "key_so"]
FACT_D = ["totalec_sr", "totalnsr_sr", "totalnsr_so", "totalec_so", "diff_ec", "diff_nsr"]

CUSTOMER_KPI_RAW = f"""
SELECT customer_code, gps_cus_longitude, gps_cus_latitude, order_non_difot, order_difot, {kpi_pct(digits=None)}
FROM ({kpi_sql('s_enriched', 'customer_code, gps_cus_longitude, gps_cus_latitude')})"""
CUSTOMER_KPI = f"""
SELECT customer_code, gps_cus_longitude, gps_cus_latitude, order_non_difot, order_difot, round(difot_pct, 6) AS difot_pct
FROM ({CUSTOMER_KPI_RAW})"""
CUSTOMER_POINTS = f"""
SELECT * FROM ({CUSTOMER_KPI_RAW})
WHERE gps_cus_longitude IS NOT NULL AND gps_cus_latitude IS NOT NULL
  AND gps_cus_latitude >= 1 AND gps_cus_longitude >= 1"""


def nearest_sql(centres: str) -> str:
    a = _a("c.latitude", "c.longitude", "p.gps_cus_latitude", "p.gps_cus_longitude")
    d = f"round(6371.0e0 * 2 * asin(sqrt(CASE WHEN {a} > 1.0e0 THEN 1.0e0 ELSE {a} END)), 6)"
    return f"""
SELECT p.*, arg_min(c.city, row(c.d, c.seq)) AS nearest_city, min(c.d) AS nearest_city_km
FROM ({CUSTOMER_POINTS}) p, LATERAL (SELECT c.*, {d} AS d FROM {centres} c) c
GROUP BY ALL"""


def by_centre_sql(centres: str) -> str:
    return f"""
SELECT nearest_city, count(*) AS customers, round(avg(difot_pct), 6) AS difot_pct,
       round(arg_min(gps_cus_latitude, customer_code), 6) AS gps_cus_latitude,
       round(arg_min(gps_cus_longitude, customer_code), 6) AS gps_cus_longitude
FROM ({nearest_sql(centres)}) GROUP BY nearest_city"""


def _hist_body() -> str:
    edges = list(range(0, 30, 2))
    buckets = " UNION ALL ".join(f"SELECT {i} AS bucket, {a}.0e0 AS lower, {b}.0e0 AS upper"
                                 for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"""
SELECT b.bucket, b.lower, b.upper, CAST(coalesce(c.frequency, 0) AS BIGINT) AS frequency,
       CAST(coalesce(c.frequency, 0) AS BIGINT) * 100.0e0 / (SELECT sum(frequency) FROM hc) AS pct
FROM ({buckets}) b LEFT JOIN hc c ON b.bucket = c.bucket"""


HIST_CTE = ("hc", """
SELECT CAST(CASE WHEN distance_km >= 28 THEN 13 ELSE floor(distance_km / 2) END AS INTEGER) AS bucket,
       count(*) AS frequency
FROM s_labelled WHERE distance_km >= 0 AND distance_km <= 28 AND NOT isnan(distance_km) GROUP BY 1""")

FIXTURE_REGIONS = [("AFRICA", "AFR"), ("AMERICA", "AME"), ("ASIA", "ASI"), ("EUROPE", "EUR"), ("MIDDLE EAST", "MEA")]
PIVOT_RAW = f"""
SELECT item_code, {', '.join(f"avg(CASE WHEN region = '{n}' THEN difot_pct END) AS {c}" for n, c in FIXTURE_REGIONS)}
FROM (SELECT region, item_code, {kpi_pct(digits=None)} FROM ({kpi_sql('s_enriched', 'region, item_code')}))
GROUP BY item_code"""
PIVOT = f"SELECT item_code, {', '.join(f'round({c}, 6) AS {c}' for _, c in FIXTURE_REGIONS)} FROM ({PIVOT_RAW})"

ORACLE: dict[str, str] = {
    "join_gps_left": with_ctes(f"SELECT {KEY}, customer_code, {r6(*GPS)} FROM s_gps"),
    "proj_fact_gps": with_ctes(f"SELECT {', '.join(FACT)}, {r6(*FACT_D, *GPS)} FROM s_gps"),
    "distance_haversine": with_ctes(
        "SELECT customer_code, distributor_code, count(*) AS n_lines, round(any_value(distance_km), 6) AS distance_km "
        "FROM s_dist GROUP BY customer_code, distributor_code"),
    "filter_valid_gps": with_ctes(f"SELECT {KEY}, {r6('distance_km')} FROM s_valid"),
    "median_distance": with_ctes(f"SELECT n, {r6('median_distance')} FROM s_median"),
    "median_by_rank": with_ctes(f"SELECT n, {r6('median_distance')} FROM s_median"),
    "fill_distance_median": with_ctes(f"SELECT {KEY}, {r6('distance_km')} FROM s_filled"),
    "quartiles_exact": with_ctes(f"SELECT {r6('q1', 'q3', 'iqr', 'lower_bound', 'upper_bound')} FROM s_bounds"),
    "quartiles_approx": with_ctes("SELECT count(distance_km) AS n, TRUE AS q1_within, TRUE AS q3_within FROM s_filled"),
    "iqr_filter": with_ctes(f"SELECT {KEY}, {r6('distance_km')} FROM s_clean"),
    "iqr_retention": with_ctes(
        "SELECT (SELECT count(*) FROM s_filled) AS rows_before, (SELECT count(*) FROM s_clean) AS rows_after, "
        "round((SELECT count(*) FROM s_clean) * 100.0e0 / (SELECT count(*) FROM s_filled), 6) AS pct_kept"),
    "delivery_day": with_ctes(f"SELECT {KEY}, order_date, settlement_date, delivery_day FROM s_labelled"),
    "range_join_days_off": with_ctes(
        "SELECT k.order_date, k.settlement_date, CAST(count(DISTINCT c.d_date) AS DOUBLE) AS days_off_count "
        "FROM (SELECT DISTINCT order_date, settlement_date FROM s_clean) k "
        "LEFT JOIN f_day_off c ON c.d_date >= k.order_date AND c.d_date <= k.settlement_date "
        "GROUP BY k.order_date, k.settlement_date"),
    "days_off_count": with_ctes(f"SELECT {KEY}, order_key, days_off_count FROM s_labelled"),
    "day_processing": with_ctes(f"SELECT {KEY}, delivery_day, days_off_count, day_processing FROM s_labelled"),
    "cond_labels": with_ctes(
        f"SELECT {KEY}, " + ", ".join(f"CASE WHEN {c} = 1 THEN 'Yes' ELSE 'No' END AS {c}"
                                     for c in ("ontime", "infull", "difot")) + " FROM s_labelled"),
    "label_numeric": with_ctes(f"SELECT {KEY}, ontime, infull, difot FROM s_labelled"),
    "difot_label": with_ctes(
        "SELECT difot, count(*) AS rows, round(sum(days_off_count), 6) AS sum_days_off, "
        "round(sum(day_processing), 6) AS sum_day_processing, round(sum(ontime), 6) AS sum_ontime, "
        "round(sum(infull), 6) AS sum_infull FROM s_labelled GROUP BY difot"),
    "composite_keys": with_ctes(
        f"SELECT {KEY}, order_key, CAST(order_date AS VARCHAR) || '-' || order_no || '-' || customer_code AS key "
        "FROM s_labelled"),
    "join_urban": with_ctes(f"SELECT {KEY}, city, province_standard, {r6('urban_rate')} FROM s_urban"),
    "count_by_urban_rate": with_ctes(f"SELECT {r6('urban_rate')}, count(*) AS count FROM s_urban GROUP BY urban_rate"),
    "sql_view_distinct": with_ctes(f"SELECT DISTINCT {r6('urban_rate')} FROM s_urban"),
    "join_free_good_fanout": with_ctes(f"SELECT {KEY}, isfreegood_order_no FROM s_enriched"),
    "join_free_good_flag": with_ctes(
        f"SELECT {KEY}, CASE WHEN EXISTS (SELECT 1 FROM f_free_good fg WHERE fg.order_date = u.order_date "
        "AND fg.order_no = u.order_no AND fg.customer_code = u.customer_code) THEN 1.0e0 ELSE 0.0e0 END "
        "AS isfreegood_order_no FROM s_urban u"),
    "flag_free_good": with_ctes(
        "SELECT isfreegood_order_no, count(*) AS rows, count(DISTINCT order_no) AS orders FROM s_enriched "
        "GROUP BY isfreegood_order_no"),
    "describe_flag": with_ctes(
        "SELECT count(isfreegood_order_no) AS count, round(avg(isfreegood_order_no), 6) AS mean, "
        "round(stddev_samp(isfreegood_order_no), 6) AS stddev, round(min(isfreegood_order_no), 6) AS min, "
        "round(max(isfreegood_order_no), 6) AS max FROM s_enriched"),
    "kpi_by_customer": with_ctes(CUSTOMER_KPI),
    "kpi_by_pack_type": with_ctes(
        f"SELECT pack_type, order_non_difot, order_difot, {kpi_pct()} FROM ({kpi_sql('s_enriched', 'pack_type')}) "
        "WHERE pack_type IS NOT NULL"),
    "kpi_by_urban_rate": with_ctes(
        f"SELECT round(urban_rate, 6) AS urban_rate, order_non_difot, order_difot, {kpi_pct()} "
        f"FROM ({kpi_sql('s_enriched', 'urban_rate')})"),
    "kpi_by_region_item": with_ctes(
        f"SELECT region, item_code, order_non_difot, order_difot, {kpi_pct()} "
        f"FROM ({kpi_sql('s_enriched', 'region, item_code')})"),
    "kpi_by_order_date": with_ctes(
        f"SELECT order_date, order_non_difot, order_difot, {kpi_pct()} FROM ({kpi_sql('s_enriched', 'order_date')})"),
    "kpi_monthly_trend": with_ctes(
        f"SELECT month_year, total_difot, total_non_difot, {kpi_pct('total_difot', 'total_non_difot')}, "
        "CAST(strptime(month_year, '%Y-%m') AS DATE) AS month_start FROM ("
        "SELECT strftime(order_date, '%Y-%m') AS month_year, CAST(sum(order_difot) AS BIGINT) AS total_difot, "
        "CAST(sum(order_non_difot) AS BIGINT) AS total_non_difot "
        f"FROM ({kpi_sql('s_enriched', 'order_date')}) GROUP BY 1)"),
    "customer_geo_points": with_ctes(CUSTOMER_POINTS),
    "nearest_centre": with_ctes(
        "SELECT customer_code, gps_cus_latitude, gps_cus_longitude, nearest_city, nearest_city_km "
        f"FROM ({nearest_sql('f_centre')})"),
    "kpi_by_centre": with_ctes(by_centre_sql("f_centre")),
    "histogram_distance": with_ctes(
        "SELECT bucket, lower, upper, frequency, round(pct, 6) AS pct FROM (" + _hist_body() + ")", [HIST_CTE]),
    "histogram_table": with_ctes(
        "SELECT bucket, CAST(CAST(lower AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(upper AS INTEGER) AS VARCHAR) "
        "AS distance_range, format('{:,}', frequency) AS frequency, printf('%.1f%%', round(pct, 1)) "
        "AS pct_contribution FROM (" + _hist_body() + ")", [HIST_CTE]),
    "pivot_item_region": with_ctes(PIVOT),
    "top_items_pivot": with_ctes(
        f"SELECT item_code, {', '.join(f'round({c}, 6) AS {c}' for _, c in FIXTURE_REGIONS)} FROM ({PIVOT_RAW}) "
        f"ORDER BY {' + '.join(f'coalesce({c}, 0)' for _, c in FIXTURE_REGIONS)} DESC, item_code LIMIT 20"),
}


def md5_hash(e: str) -> str:
    return f"CAST(('0x' || substr(md5({e}), 1, 8)) AS BIGINT)"


MF_KEYS = ["k_order_no", "k_item_code", "k_distributor_code", "k_totalec_so"]
NUMERIC = ["totalec_so", "distance_km", "delivery_day", "days_off_count", "day_processing", "urban_rate",
           "isfreegood_order_no"]
CATS = ["region", "channelname", "segmentation", "brand", "pack_type", "pack_size", "month"]
DEFAULTS = [("channelname", "DRINKING"), ("segmentation", "Bronze"), ("brand", "*******"), ("pack_type", "PET"),
            ("pack_size", "320ML")]
MF_CTES = [
    ("s_sample", f"SELECT * FROM s_enriched WHERE {md5_hash(chr(39) + '1505-' + chr(39) + ' || order_no')} % 10 < 1"),
    ("s_mf0", """
SELECT order_no AS k_order_no, item_code AS k_item_code, distributor_code AS k_distributor_code,
       totalec_so AS k_totalec_so, totalec_so, distance_km, delivery_day, days_off_count, day_processing,
       urban_rate, isfreegood_order_no, region, channelname AS segmentation, segmentation AS channelname,
       brand, pack_type, pack_size, CAST(month(order_date) AS INTEGER) AS month, difot AS label
FROM s_enriched"""),
    ("s_mf", "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, '{v}') AS {c}" for c, v in DEFAULTS) + ") FROM s_mf0"),
]
FOLD_KEY = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in MF_KEYS) + ")"
FOLD_CTES = MF_CTES + [
    ("s_fh", f"SELECT *, {md5_hash(chr(39) + 'fold-1505-' + chr(39) + ' || ' + FOLD_KEY)} AS _h FROM s_mf"),
    ("s_folds", f"""
SELECT * EXCLUDE (_h), CAST((row_number() OVER (PARTITION BY label ORDER BY _h, {', '.join(MF_KEYS)}) - 1) % 5
                            AS INTEGER) AS fold
FROM s_fh"""),
]

FIXTURE_FEATURES = ["day_processing", "delivery_day", "totalec_so", "distance_km", "days_off_count",
                    "urban_rate", "isfreegood_order_no", "month_3", "pack_size_29ML", "month_4",
                    "month_8", "region_ASIA", "pack_size_30ML", "segmentation_MACHINERY", "segmentation_BUILDING"]


def _feature(f: str) -> str:
    if f in NUMERIC:
        return f"CAST({f} AS DOUBLE) AS {f}"
    col = next(c for c in CATS if f.startswith(c + "_"))
    return f"CASE WHEN CAST({col} AS VARCHAR) = '{f[len(col) + 1:]}' THEN 1.0e0 ELSE 0.0e0 END AS {f}"


ONE_HOT = " UNION ALL ".join(
    f"SELECT {', '.join(MF_KEYS)}, '{c}_' || CAST({c} AS VARCHAR) AS feature, 1.0e0 AS value FROM s_mf "
    f"WHERE {c} IS NOT NULL AND {c} <> (SELECT min({c}) FROM s_mf)" for c in CATS)

CORR = ["totalnsr_so", "totalec_so", "distance_km", "delivery_day", "days_off_count", "day_processing",
        "ontime", "infull", "difot", "urban_rate", "isfreegood_order_no"]
_CW = ", ".join(f"corr({CORR[a]}, {CORR[b]}) AS c_{a}_{b}" for a in range(len(CORR)) for b in range(a, len(CORR)))
CORR_LONG = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{CORR[i]}' AS row_var, '{CORR[j]}' AS col_var, round(c_{min(i, j)}_{max(i, j)}, 6) "
    f"AS corr FROM cw" for i in range(len(CORR)) for j in range(len(CORR)))
CORR_CTES = [("cw", f"SELECT {_CW} FROM s_enriched")]


def metric_ctes(src: str, keys: list[str]) -> list[tuple[str, str]]:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = " AND ".join([f"c.{x} = p.{x}" for x in keys] + ["TRUE"])
    return [
        ("m_cls", f"SELECT DISTINCT {kc}class FROM (SELECT {kc}label AS class FROM {src} "
                  f"UNION ALL SELECT {kc}prediction FROM {src})"),
        ("m_cnt", f"""
SELECT {', '.join('c.' + x for x in keys) + (', ' if keys else '')}c.class,
       count(*) FILTER (WHERE p.label = c.class AND p.prediction = c.class) AS tp,
       count(*) FILTER (WHERE p.label = c.class) AS support,
       count(*) FILTER (WHERE p.prediction = c.class) AS predicted
FROM m_cls c JOIN {src} p ON {on}
GROUP BY ALL"""),
        ("m_pr", """
SELECT *, CASE WHEN predicted = 0 THEN 0.0e0 ELSE CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) END AS precision,
          CASE WHEN support = 0 THEN 0.0e0 ELSE CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall
FROM m_cnt"""),
        ("m_pc", """
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1
FROM m_pr"""),
        ("m_w", f"""
SELECT {kc}CAST(sum(tp) AS DOUBLE) / sum(CAST(support AS DOUBLE)) AS accuracy, CAST(sum(support) AS BIGINT) AS rows,
       sum(precision * CAST(support AS DOUBLE)) / sum(CAST(support AS DOUBLE)) AS precision_weighted,
       sum(recall * CAST(support AS DOUBLE)) / sum(CAST(support AS DOUBLE)) AS recall_weighted,
       sum(f1 * CAST(support AS DOUBLE)) / sum(CAST(support AS DOUBLE)) AS f1_weighted,
       coalesce(max(CASE WHEN class = 1 THEN precision END), 0.0e0) AS precision_pos,
       coalesce(max(CASE WHEN class = 1 THEN recall END), 0.0e0) AS recall_pos,
       coalesce(max(CASE WHEN class = 1 THEN f1 END), 0.0e0) AS f1_pos
FROM m_pc {'GROUP BY ' + k if keys else ''}"""),
    ]


RULE = "CASE WHEN distance_km < (SELECT median_distance FROM s_median) THEN 1.0e0 ELSE 0.0e0 END AS prediction"
PRED_CTES = [("s_pred", f"SELECT *, difot AS label, {RULE} FROM s_enriched")]
FOLD_PRED_CTES = FOLD_CTES + [("s_fpred", f"SELECT *, {RULE} FROM s_folds")] + metric_ctes("s_fpred", ["fold"]) + [
    ("s_fscore", "SELECT fold, accuracy AS Accuracy, precision_pos AS Precision, recall_pos AS Recall, f1_pos AS F1 "
                 "FROM m_w"),
    ("s_flong", "SELECT fold, metric, value FROM (UNPIVOT s_fscore ON Accuracy, Precision, Recall, F1 "
                "INTO NAME metric VALUE value)"),
]

ORACLE.update({
    "sample_by_key": with_ctes(f"SELECT {KEY}, difot FROM s_sample", MF_CTES),
    "class_distribution_before": with_ctes(
        "SELECT difot, count(*) AS count, round(count(*) * 100.0e0 / (SELECT count(*) FROM s_enriched), 6) AS pct "
        "FROM s_enriched GROUP BY difot"),
    "rename_swap": with_ctes(f"SELECT {KEY}, channelname AS segmentation, segmentation AS channelname FROM s_enriched"),
    "audit_nulls": with_ctes(
        "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in NUMERIC + CATS + ["label"])
        + ", count(*) FILTER (WHERE " + " OR ".join(f"{c} IS NULL" for c in NUMERIC + CATS + ["label"])
        + ") AS rows_with_null, count(*) AS rows FROM s_mf0", MF_CTES),
    "fill_category_defaults": with_ctes(
        f"SELECT {', '.join(MF_KEYS)}, {', '.join(c for c, _ in DEFAULTS)} FROM s_mf", MF_CTES),
    "date_parts": with_ctes(
        f"SELECT {KEY}, order_date, CAST(month(order_date) AS INTEGER) AS month, CAST(year(order_date) AS INTEGER) "
        "AS year, strftime(order_date, '%Y-%m') AS month_year, CAST(date_trunc('month', order_date) AS DATE) "
        "AS month_start FROM s_enriched"),
    "model_frame": with_ctes(
        f"SELECT {', '.join(MF_KEYS)}, {r6(*NUMERIC)}, region, segmentation, channelname, brand, pack_type, "
        "pack_size, month, label FROM s_mf", MF_CTES),
    "one_hot_encode": with_ctes(ONE_HOT, MF_CTES),
    "feature_matrix": with_ctes(
        f"SELECT {', '.join(MF_KEYS)}, "
        f"{', '.join(_feature(f).replace(' AS ' + f, '') + ' AS ' + f if False else _feature(f) for f in FIXTURE_FEATURES)}"
        ", label FROM s_mf", MF_CTES),
    "train_test_split": with_ctes(
        f"SELECT {', '.join(MF_KEYS)}, label, CASE WHEN "
        f"{md5_hash(chr(39) + 'split-1505-' + chr(39) + ' || k_order_no')} % 100 < 20 THEN 1 ELSE 0 END AS is_test "
        "FROM s_mf", MF_CTES),
    "stratified_folds": with_ctes(f"SELECT {', '.join(MF_KEYS)}, label, fold FROM s_folds", FOLD_CTES),
    "correlation_matrix": with_ctes(CORR_LONG, CORR_CTES),
    "correlation_lower": with_ctes(f"SELECT * FROM ({CORR_LONG}) WHERE i > j", CORR_CTES),
    "normality_jarque_bera": with_ctes("""
SELECT n, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(jb, 6) AS jb,
       round(exp(-jb / 2.0e0), 6) AS p_value
FROM (SELECT n, skewness, kurtosis, n / 6.0e0 * (pow(skewness, 2) + pow(kurtosis, 2) / 4.0e0) AS jb
      FROM (SELECT n, m3 / pow(m2, 1.5) AS skewness, m4 / pow(m2, 2) - 3.0e0 AS kurtosis
            FROM (SELECT count(distance_km) AS n,
                         avg(pow(distance_km - (SELECT avg(distance_km) FROM s_filled), 2)) AS m2,
                         avg(pow(distance_km - (SELECT avg(distance_km) FROM s_filled), 3)) AS m3,
                         avg(pow(distance_km - (SELECT avg(distance_km) FROM s_filled), 4)) AS m4
                  FROM s_filled)))"""),
    "metrics_weighted": with_ctes(
        "SELECT " + r6("accuracy") + ", rows, " + r6("precision_weighted", "recall_weighted", "f1_weighted",
                                                      "precision_pos", "recall_pos", "f1_pos") + " FROM m_w",
        PRED_CTES + metric_ctes("s_pred", [])),
    "metrics_per_class": with_ctes(
        "SELECT class, " + r6("precision", "recall", "f1") + ", CAST(support AS BIGINT) AS support FROM m_pc",
        PRED_CTES + metric_ctes("s_pred", [])),
    "fit_verdict": with_ctes("""
SELECT round(train_accuracy, 6) AS train_accuracy, round(test_accuracy, 6) AS test_accuracy,
       CASE WHEN train_accuracy > test_accuracy + 0.05e0 THEN 'overfitting'
            WHEN train_accuracy < test_accuracy - 0.05e0 THEN 'underfitting' ELSE 'good' END AS verdict
FROM (SELECT sum(CASE WHEN is_test = 0 AND label = prediction THEN 1 ELSE 0 END)
             / sum(CASE WHEN is_test = 0 THEN 1 ELSE 0 END) AS train_accuracy,
             sum(CASE WHEN is_test = 1 AND label = prediction THEN 1 ELSE 0 END)
             / sum(CASE WHEN is_test = 1 THEN 1 ELSE 0 END) AS test_accuracy
      FROM (SELECT *, CASE WHEN """ + md5_hash("'split-1505-' || order_no") + """ % 100 < 20 THEN 1 ELSE 0 END
                   AS is_test FROM s_pred))""", PRED_CTES),
    "unpivot_metrics": with_ctes("SELECT fold, metric, round(value, 6) AS value FROM s_flong", FOLD_PRED_CTES),
    "cv_fold_summary": with_ctes(
        "SELECT metric, count(value) AS folds, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std "
        "FROM s_flong GROUP BY metric", FOLD_PRED_CTES),
    "box_summary": with_ctes(
        "SELECT metric, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for q, n in
                                      ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max")))
        + " FROM s_flong GROUP BY metric", FOLD_PRED_CTES),
})


CSV_FACT = ", ".join(FACT) + ", " + r6(*FACT_D)
ORACLE.update({
    "src_csv_header": with_ctes(f"SELECT {CSV_FACT} FROM f_fact"),
    "typed_dates": with_ctes(
        f"SELECT {KEY}, order_date, settlement_date, coalesce(d.listed, 0) AS listed FROM f_fact f "
        "LEFT JOIN (SELECT d_date, count(*) AS listed FROM f_day_off GROUP BY d_date) d ON f.order_date = d.d_date"),
    "typed_cast": with_ctes(f"SELECT {KEY}, {r6('totalec_sr', 'totalnsr_sr', 'totalnsr_so', 'diff_ec', 'diff_nsr')} "
                            "FROM f_fact"),
    "sink_csv_gzip_roundtrip": with_ctes(
        f"SELECT {KEY}, order_date, settlement_date, {r6('distance_km', 'days_off_count', 'difot')} FROM s_labelled"),
    "src_multi_gzip": with_ctes(
        "SELECT region, count(*) AS rows, round(sum(difot), 6) AS difot_rows, "
        "round(sum(isfreegood_order_no), 6) AS free_good_rows, round(sum(distance_km), 6) AS sum_distance_km "
        "FROM s_enriched GROUP BY region"),
})


NM_KEY_HASH = md5_hash("'nm-' || " + "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in MF_KEYS) + ")")
VEC = [f"coalesce({_feature(f).rsplit(' AS ', 1)[0]}, 0.0e0) AS v{i}" for i, f in enumerate(FIXTURE_FEATURES)]
VS = ", ".join(f"v{i}" for i in range(len(VEC)))
NM_DIST = "sqrt(" + " + ".join(f"(a.v{i} - b.v{i}) * (a.v{i} - b.v{i})" for i in range(len(VEC))) + ")"
NM_CTES = MF_CTES + [
    ("nm_f", f"SELECT *, {', '.join(VEC)} FROM s_mf"),
    ("nm_cnt", "SELECT label, count(*) AS c FROM nm_f GROUP BY label"),
    ("nm_cls", "SELECT (SELECT label FROM nm_cnt ORDER BY c ASC, label ASC LIMIT 1) AS mino, "
               "(SELECT min(c) FROM nm_cnt) AS n_min"),
    ("nm_min", "SELECT * FROM nm_f WHERE label = (SELECT mino FROM nm_cls)"),
    ("nm_maj", "SELECT * FROM nm_f WHERE label <> (SELECT mino FROM nm_cls)"),
    ("nm_a", f"SELECT row_number() OVER () AS id, {VS} FROM (SELECT DISTINCT {VS} FROM nm_maj)"),
    ("nm_near", f"SELECT a.id, list_avg(min({NM_DIST}, 3)) AS knn_mean FROM nm_a a, nm_min b GROUP BY a.id"),
    ("nm_mean", f"SELECT {VS}, round(knn_mean, 6) AS knn_mean FROM nm_a JOIN nm_near USING (id)"),
    ("nm_rank", f"""
SELECT m.*, row_number() OVER (PARTITION BY m.label ORDER BY s.knn_mean, {NM_KEY_HASH}, {', '.join('m.' + k for k in MF_KEYS)})
              AS nth
FROM nm_maj m JOIN nm_mean s USING ({VS})"""),
    ("nm_out", "SELECT * FROM nm_min UNION ALL SELECT * EXCLUDE (nth) FROM nm_rank WHERE nth <= (SELECT n_min FROM nm_cls)"),
]
ORACLE.update({
    "nearmiss_undersample": with_ctes(f"SELECT {', '.join(MF_KEYS)}, label FROM nm_out", NM_CTES),
    # every class is left with as many rows as the smallest has
    "class_distribution_after": with_ctes(
        "SELECT label, (SELECT min(c) FROM nm_cnt) AS count, round(100.0e0 / (SELECT count(*) FROM nm_cnt), 6) AS pct "
        "FROM nm_cnt", NM_CTES),
})


def _centre_values() -> str:
    from shipshape.sources.literals import CITY_CENTRES_TEXT
    rows = []
    for i, line in enumerate(CITY_CENTRES_TEXT.strip().splitlines()):
        name, lat, lon = line.rsplit(",", 2)
        rows.append(f"({i}, '{name}', {float(lat)!r}e0, {float(lon)!r}e0)")
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") t(seq, city, latitude, longitude))"


ORACLE["src_centres"] = with_ctes(by_centre_sql(_centre_values()))


KNN_CTES = NM_CTES + [
    ("kn_s", "SELECT *, CASE WHEN " + md5_hash("'split-1505-' || k_order_no") + " % 100 < 20 THEN 1 ELSE 0 END "
             "AS is_test FROM nm_out"),
    ("kn_a", f"SELECT row_number() OVER () AS id, {VS} FROM (SELECT DISTINCT {VS} FROM kn_s WHERE is_test = 1)"),
    ("kn_near", "SELECT a.id, min({'d': CAST(CAST(" + NM_DIST + " AS DECIMAL(30, 9)) AS DOUBLE), 'y': b.label}, 5) AS top "
                "FROM kn_a a, (SELECT * FROM kn_s WHERE is_test = 0) b GROUP BY a.id"),
    ("kn_vote", f"SELECT {VS}, CASE WHEN list_sum(list_transform(top, lambda t: t.y)) * 2 > 5 THEN 1.0e0 ELSE 0.0e0 END "
                "AS prediction FROM kn_a JOIN kn_near USING (id)"),
    ("kn_pred", f"SELECT t.label, v.prediction FROM (SELECT * FROM kn_s WHERE is_test = 1) t JOIN kn_vote v USING ({VS})"),
] + metric_ctes("kn_pred", [])
ORACLE["knn_vote"] = with_ctes(
    "SELECT " + r6("accuracy") + ", rows, " + r6("precision_weighted", "recall_weighted", "f1_weighted",
                                                  "precision_pos", "recall_pos", "f1_pos") + " FROM m_w", KNN_CTES)


def _spark_rounding(sql: str) -> str:
    """Rewrite every ``round(x, d)`` into the decimal-text form of ``rnd``."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = _spark_rounding(sql[j + 6:comma])
        digits = sql[comma + 1:k - 1].strip()
        out.append(sql[i:j] + rnd(inner, int(digits)))
        i = k


ORACLE = {k: _spark_rounding(v) for k, v in ORACLE.items()}

# ---------------------------------------------------------------- ranks over the whole table

# fixed values: coefficients of Acklam's rational approximation to the normal quantile function
_A = ("-3.969683028665376e+01", "2.209460984245205e+02", "-2.759285104469687e+02", "1.383577518672690e+02",
      "-3.066479806614716e+01", "2.506628277459239e+00")
_B = ("-5.447609879822406e+01", "1.615858368580409e+02", "-1.556989798598866e+02", "6.680131188771972e+01",
      "-1.328068155288572e+01", "1.0e0")
_C = ("-7.784894002430293e-03", "-3.223964580411365e-01", "-2.400758277161838e+00", "-2.549732539343734e+00",
      "4.374664141464968e+00", "2.938163982698783e+00")
_D = ("7.784695709041462e-03", "3.224671290700398e-01", "2.445134137142996e+00", "3.754408661907416e+00", "1.0e0")


def _poly(coefficients, z):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = f"({out}) * {z} + {c}"
    return f"({out})"


def _score(p: str) -> str:
    low, high, q = f"sqrt(-2.0e0 * ln({p}))", f"sqrt(-2.0e0 * ln(1.0e0 - {p}))", f"({p} - 0.5e0)"
    return (f"CASE WHEN {p} < 0.02425e0 THEN {_poly(_C, low)} / {_poly(_D, low)} "
            f"WHEN {p} > 1 - 0.02425e0 THEN -{_poly(_C, high)} / {_poly(_D, high)} "
            f"ELSE {_poly(_A, f'({q} * {q})')} * {q} / {_poly(_B, f'({q} * {q})')} END")


ORACLE |= {
    "row_number_by_distance": with_ctes(
        f"SELECT {KEY}, distance_km, row_number() OVER (ORDER BY distance_km, {KEY}) AS row_number "
        f"FROM (SELECT {KEY}, {r6('distance_km')} FROM s_valid)"),
    "normality_shapiro_francia": with_ctes(f"""
SELECT n, {rnd('w')} AS w, {rnd('z')} AS z
FROM (SELECT n, w, (ln(1.0e0 - w) - (-1.2725e0 + 1.0521e0 * (ln(ln(n)) - ln(n)))) / (1.0308e0 - 0.26758e0 * (ln(ln(n)) + 2.0e0 / ln(n))) AS z
      FROM (SELECT count(*) AS n, pow(sum(d * m), 2) / (sum(d * d) * sum(m * m)) AS w
            FROM (SELECT x - avg(x) OVER () AS d, {_score('p')} AS m
                  FROM (SELECT distance_km AS x, (row_number() OVER (ORDER BY distance_km) - 0.375e0)
                                                 / (count(*) OVER () + 0.25e0) AS p
                        FROM s_filled WHERE distance_km IS NOT NULL))))"""),
    "box_distance_by_pack_type": with_ctes(
        "SELECT pack_type, count(distance_km) AS n, " + ", ".join(
            f"{rnd(f'quantile_cont(distance_km, {p})')} AS {n}" for p, n in
            ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max")))
        + " FROM s_enriched GROUP BY pack_type HAVING count(distance_km) > 0"),
}

# ---------------------------------------------------------------- second-order boosting, first tree's root

BOOST_CTES = MF_CTES + [
    ("b_long", " UNION ALL ".join(f"SELECT '{f}' AS feature, x, label FROM (SELECT {_feature(f).rsplit(' AS ', 1)[0]} AS x, "
                                  "label FROM s_mf)" for f in FIXTURE_FEATURES)),
    ("b_ranked", "SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS r, "
                 "count(*) OVER (PARTITION BY feature) AS n FROM b_long WHERE x IS NOT NULL"),
    ("b_edges", "SELECT DISTINCT feature, x AS threshold FROM b_ranked b "
                "WHERE EXISTS (SELECT 1 FROM range(1, 32) k WHERE (k.range * b.n + 31) // 32 = b.r) "
                "AND x < (SELECT max(x) FROM b_ranked m WHERE m.feature = b.feature)"),
    ("b_all", "SELECT feature, sum(0.5e0 - label) AS g, 0.25e0 * count(*) AS h, "
              "coalesce(sum(0.5e0 - label) FILTER (WHERE x IS NULL), 0.0e0) AS gm, "
              "0.25e0 * count(*) FILTER (WHERE x IS NULL) AS hm FROM b_long GROUP BY feature"),
    ("b_left", "SELECT e.feature, e.threshold, sum(0.5e0 - l.label) AS gl, 0.25e0 * count(*) AS hl "
               "FROM b_edges e JOIN b_long l ON l.feature = e.feature AND l.x <= e.threshold GROUP BY ALL"),
    ("b_split", "SELECT feature, threshold, side AS missing_left, g, h, gl + CASE WHEN side THEN gm ELSE 0 END AS left_g, "
                "hl + CASE WHEN side THEN hm ELSE 0 END AS left_h FROM b_left JOIN b_all USING (feature) "
                "JOIN (VALUES (TRUE), (FALSE)) v(side) ON side OR hm > 0"),
]

ORACLE |= {
    "boosting_split_gains": with_ctes(f"""
SELECT feature, {rnd('threshold')} AS threshold, missing_left, {rnd('gain')} AS gain, left_g, left_h
FROM (SELECT *, (left_g * left_g / (left_h + 1) + (g - left_g) * (g - left_g) / (h - left_h + 1) - g * g / (h + 1)) / 2 AS gain
      FROM b_split WHERE least(left_h, h - left_h) >= 1)""", BOOST_CTES),
}

_DISTRIBUTORS = ("(SELECT CAST(substr(customerid, 2) AS BIGINT) AS seq, customerid AS city, latitude, longitude "
                 "FROM f_gps_distributor WHERE latitude >= 1 AND longitude >= 1)")

ORACLE |= {
    "one_hot_fitted": ORACLE["one_hot_encode"],
    "quartiles_sketched": with_ctes("SELECT count(distance_km) AS n, count(distance_km) AS sketched, TRUE AS q1_within, "
                                    "TRUE AS q2_within, TRUE AS q3_within FROM s_filled"),
    "nearest_distributor": with_ctes(
        "SELECT customer_code, gps_cus_latitude, gps_cus_longitude, nearest_city AS distributor, nearest_city_km AS distributor_km "
        f"FROM ({nearest_sql(_DISTRIBUTORS)})"),
}
