"""Inputs of the reference's shape, derived from the driver's TPC-H-like tables.

The reference's own inputs (order lines, GPS lists, day-off calendar, urbanisation,
free goods) are private. FIXTURES.md gives deterministic formulas that plant every
edge case (missing and zero coordinates, late / early / unknown settlement,
duplicate keys) into tables built from lineitem, orders, customer, supplier,
nation, region and part. Each function here is one lazy DataFrame; nothing is
collected.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipshape.sources.tables import table


def _code(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order of a known customer: what f_order_line has from the order, with the order's number key."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # customer -> nation -> region is a dimension chain; resolve it before the orders join
    geo = (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select("c_custkey", "c_mktsegment", "r_name"))
    return o.join(geo, o.o_custkey == geo.c_custkey).select(
        F.col("o_orderkey").alias(HEAD_KEY),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("r_name").alias("region"),
        _code("C", "o_custkey").alias("customer_code"),
        F.when(F.col("o_orderkey") % 67 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("segmentation"),
        F.col("c_mktsegment").alias("channelname"),
        _code("SO", "o_orderkey").alias("order_no"))


def lines_of(spark: SparkSession, sf_dir: str, heads: DataFrame) -> DataFrame:
    """The lines of ``heads``, the rows of ``order_heads``: f_order_line and what columns the heads have beyond it."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    extra = [c for c in heads.columns if c not in FACT_COLUMNS and c != HEAD_KEY]
    # the number is made of the line's key again, so that no text of it is shuffled
    j = li.join(p, li.l_partkey == p.p_partkey).join(heads.drop("order_no"), F.col("l_orderkey") == F.col(HEAD_KEY))
    m = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 20
    shift = (F.when(m < 17, m % 3).when(m == 17, -1).when(m == 18, 5).otherwise(9)).cast("int")
    pk, ok = F.col("l_partkey"), F.col("l_orderkey")
    diff_ec = (F.when(pk % 97 == 0, F.lit(None).cast("double"))
                .when((ok + pk) % 10 == 0, F.lit(1.0))
                .when((ok + pk) % 10 == 3, F.lit(0.05))
                .when((ok + pk) % 10 == 7, F.lit(-0.5))
                .otherwise(F.lit(0.0)))
    base = j.select(
        "order_date",
        F.when(ok % 101 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add("order_date", shift)).alias("settlement_date"),
        "region",
        _code("D", "l_suppkey").alias("distributor_code"),
        "customer_code",
        "segmentation",
        "channelname",
        _code("SO", "l_orderkey").alias("order_no"),
        _code("P", "l_partkey").alias("item_code"),
        F.col("p_brand").alias("brand"),
        F.when(pk % 71 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("pack_type"),
        F.concat(F.col("p_size").cast("string"), F.lit("ML")).alias("pack_size"),
        F.col("l_quantity").alias("totalec_so"),
        F.col("l_extendedprice").alias("totalnsr_so"),
        diff_ec.alias("diff_ec"),
        *extra,
    )
    sr = F.col("totalec_so") - F.coalesce(F.col("diff_ec"), F.lit(0.0))
    nsr_sr = F.try_divide(F.col("totalnsr_so") * F.col("totalec_sr"), F.col("totalec_so"))
    return (base
            .withColumn("key_so", F.concat_ws("-", "order_no", "item_code"))
            .withColumn("totalec_sr", sr)
            .withColumn("totalnsr_sr", nsr_sr)
            .withColumn("diff_nsr", F.col("totalnsr_so") - F.col("totalnsr_sr"))
            .select(*FACT_COLUMNS, *extra))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_order_line: one row per order line, the reference's fact table."""
    return lines_of(spark, sf_dir, order_heads(spark, sf_dir))


HEAD_KEY = "_order_key"
FACT_COLUMNS = [
    "order_date", "settlement_date", "region", "distributor_code", "customer_code",
    "segmentation", "channelname", "order_no", "item_code", "brand", "pack_type",
    "pack_size", "key_so", "totalec_sr", "totalnsr_sr", "totalnsr_so", "totalec_so",
    "diff_ec", "diff_nsr",
]


def gps_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_gps_customer: customerid, latitude, longitude with NULL, zero and far points."""
    k = F.col("c_custkey")
    lat = F.lit(10.70) + (k * 37 % 97) / 1000.0 + F.when(k % 50 == 0, 2.0).otherwise(0.0)
    lon = F.lit(106.60) + (k * 53 % 89) / 1000.0
    null = F.lit(None).cast("double")
    return (table(spark, sf_dir, "customer").select("c_custkey")
            .filter(k % 89 != 0)
            .select(_code("C", "c_custkey").alias("customerid"),
                    F.when(k % 83 == 0, null).when(k % 79 == 0, 0.0).otherwise(lat).alias("latitude"),
                    F.when(k % 83 == 0, null).when(k % 79 == 0, 0.0).otherwise(lon).alias("longitude")))


def gps_distributor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_gps_distributor: same shape as customer GPS, keyed by 'D' || s_suppkey."""
    k = F.col("s_suppkey")
    lat = F.lit(10.70) + (k * 31 % 97) / 1000.0
    lon = F.lit(106.60) + (k * 41 % 89) / 1000.0
    return (table(spark, sf_dir, "supplier").select("s_suppkey")
            .filter(k % 43 != 1)
            .select(_code("D", "s_suppkey").alias("customerid"),
                    F.when(k % 47 == 0, 0.0).otherwise(lat).alias("latitude"),
                    F.when(k % 47 == 0, 0.0).otherwise(lon).alias("longitude")))


def day_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_day_off: Sundays plus four fixed holidays, each listed once per reason.

    The span runs from 1 January of the first order year to 31 December of the year
    after the last order, so a holiday on a Sunday appears twice. The span is a
    few thousand days whatever the size of ``orders`` (one aggregate row feeds
    ``sequence``)."""
    o = table(spark, sf_dir, "orders").select("o_orderdate")
    span = o.agg(F.year(F.min("o_orderdate")).alias("y0"), F.year(F.max("o_orderdate")).alias("y1"))
    days = span.select(F.explode(F.sequence(F.make_date("y0", F.lit(1), F.lit(1)),
                                            F.make_date(F.col("y1") + 1, F.lit(12), F.lit(31)))).alias("d_date"))
    md = F.date_format("d_date", "MM-dd")
    sundays = days.filter(F.dayofweek("d_date") == 1)
    # fixed values: the planted holidays (1 Jan, 30 Apr, 1 May, 2 Sep)
    holidays = days.filter(md.isin("01-01", "04-30", "05-01", "09-02"))
    cal = sundays.unionByName(holidays)
    return cal.select("d_date", F.last_day("d_date").alias("eomonth_ko"),
                      F.year("d_date").cast("double").alias("year"))


def urbanization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_urban: customerid, city, province_standard, urban_rate (some rows missing or NULL)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (c.filter(F.col("c_custkey") % 61 != 0)
          .join(n, c.c_nationkey == n.n_nationkey)
          .join(r, n.n_regionkey == r.r_regionkey))
    rate = F.lit(20.5) + (F.col("n_nationkey") * 13 % 60)
    return j.select(_code("C", "c_custkey").alias("customerid"),
                    F.col("n_name").alias("city"),
                    F.col("r_name").alias("province_standard"),
                    F.when(F.col("c_custkey") % 59 == 0, F.lit(None).cast("double"))
                     .otherwise(rate.cast("double")).alias("urban_rate"))


def free_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_free_good: orders with a free good; every 25th order is listed twice (fan-out)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    row = [F.to_date("o_orderdate").alias("order_date"), _code("SO", "o_orderkey").alias("order_no"),
           _code("C", "o_custkey").alias("customer_code")]
    once = o.filter(F.col("o_orderkey") % 5 == 0).select(*row)
    again = o.filter(F.col("o_orderkey") % 25 == 0).select(*row)
    return once.unionByName(again)


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_centre: one reference point per nation (seq, city, latitude, longitude)."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.cast("int").alias("seq"), F.col("n_name").alias("city"),
        (F.lit(10.70) + (k * 29 % 97) / 1000.0).alias("latitude"),
        (F.lit(106.60) + (k * 23 % 89) / 1000.0).alias("longitude"))
