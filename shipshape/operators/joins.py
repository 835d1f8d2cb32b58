"""Dimension joins and the day-off range count.

Joins are written as plain equi-joins; Catalyst/AQE pick broadcast or
sort-merge from measured sizes (``spark.sql.autoBroadcastJoinThreshold``), and
AQE splits a skewed fact partition of a sort-merge join. Only tables whose size
is bounded by construction carry an explicit broadcast hint.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipshape.functions.columns import presence


def with_gps(fact: DataFrame, gps_customer: DataFrame, gps_distributor: DataFrame) -> DataFrame:
    """Left-join customer and distributor coordinates; a missing partner gives NULLs.

    Dimension rows are not de-duplicated, as in the reference: a repeated id fans
    out the order lines. The customers come last, so that a later join on the customer code finds
    the lines distributed by it.
    """
    located = with_customer_gps(with_distributor_gps(fact, gps_distributor), gps_customer)
    return located.select(*fact.columns, "gps_cus_latitude", "gps_cus_longitude", "gps_dist_latitude", "gps_dist_longitude")


def with_customer_gps(df: DataFrame, gps_customer: DataFrame) -> DataFrame:
    """The customers' half of ``with_gps``, for lines or for orders that have yet to meet their lines."""
    cus = gps_customer.select(F.col("customerid").alias("_cus_id"),
                              F.col("latitude").alias("gps_cus_latitude"),
                              F.col("longitude").alias("gps_cus_longitude"))
    return df.join(cus, F.col("customer_code") == cus._cus_id, "left").drop("_cus_id")


def with_distributor_gps(df: DataFrame, gps_distributor: DataFrame) -> DataFrame:
    """The distributors' half of ``with_gps``."""
    dist = gps_distributor.select(F.col("customerid").alias("_dist_id"),
                                  F.col("latitude").alias("gps_dist_latitude"),
                                  F.col("longitude").alias("gps_dist_longitude"))
    return df.join(dist, F.col("distributor_code") == dist._dist_id, "left").drop("_dist_id")


def with_urban(df: DataFrame, urban: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Attach city, province and urbanisation rate; rows without a rate are dropped.

    Left join + not-NULL filter is what the reference writes; Catalyst turns it
    into an inner join.
    """
    u = urban.select(F.col("customerid").alias("_urb_id"), "city", "province_standard", "urban_rate")
    j = df.join(u, df.customer_code == u._urb_id, "left").drop("_urb_id")
    return j if keep_unmatched else j.filter(F.col("urban_rate").isNotNull())


FREE_GOOD_KEYS = ("order_date", "order_no", "customer_code")


def with_free_good(df: DataFrame, free_goods: DataFrame, dedupe: bool = False) -> DataFrame:
    """Flag order lines whose (order date, order, customer) is on the free-good list.

    ``dedupe=False`` keeps the reference's fan-out (a key listed twice doubles its
    lines); ``dedupe=True`` de-duplicates the list first, so rows are never
    multiplied. A key with any NULL part never matches.
    """
    fg = free_goods.select(*[F.col(k).alias(f"_fg_{k}") for k in FREE_GOOD_KEYS])
    if dedupe:
        fg = fg.dropDuplicates()
    cond = [F.col(k) == F.col(f"_fg_{k}") for k in FREE_GOOD_KEYS]
    j = df.join(fg, cond, "left")
    return (j.withColumn("isfreegood_order_no", presence("_fg_order_no"))
             .drop(*[f"_fg_{k}" for k in FREE_GOOD_KEYS]))


#: Days up to which the spine is broadcast (12 bytes a day).
SPINE_BROADCAST_DAYS = 100_000


def off_day_spine(calendar: DataFrame, d_col: str = "d_date") -> DataFrame:
    """(day, cum): number of distinct off days <= day, for every day from the
    day before the first calendar date to the last one.

    Its length is the calendar's span in days (a few thousand; at most 3.65 M
    for years 1-9999), independent of the fact table. The running sum is one task over that bounded span.
    """
    off = calendar.select(F.col(d_col).alias("day")).filter(F.col("day").isNotNull()).distinct()
    span = off.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence(F.date_sub("lo", 1), F.col("hi"))).alias("day"))
    marked = days.join(off.withColumn("is_off", F.lit(1)), "day", "left")
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.select("day", F.sum(F.coalesce("is_off", F.lit(0))).over(w).alias("cum"))


def days_off(df: DataFrame, calendar: DataFrame, start: str = "order_date", end: str = "settlement_date",
             guards: tuple[str, ...] = ("order_no", "customer_code"), out: str = "days_off_count") -> DataFrame:
    """Distinct calendar days d with start <= d <= end (both ends included).

    Equal to the reference's non-equi left join + countDistinct + join back, but
    without a nested-loop join: off days in [s, e] = cum(e) - cum(s - 1), read from
    the broadcast running-count spine by two equi-joins. Dates outside the
    calendar are clamped to its ends (cum is flat there). 0 when a date or a
    guard column is NULL, or when end < start, exactly as the reference's text
    key (NULL never joins) and empty range behave.
    """
    spine = off_day_spine(calendar)
    ends = spine.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()  # the calendar's two ends
    if ends["lo"] is None:  # empty calendar: no day is off
        return df.withColumn(out, F.lit(0.0))
    lo, hi = F.lit(ends["lo"]), F.lit(ends["hi"])
    clamp = lambda c: F.least(F.greatest(c, lo), hi)
    # a short spine is broadcast (the second lookup reuses the exchange); a stray date far off the others
    # makes it long, and then the join strategy is left to Spark
    sp = F.broadcast(spine) if (ends["hi"] - ends["lo"]).days <= SPINE_BROADCAST_DAYS else spine
    j = (df.join(sp.alias("_a"), clamp(F.date_sub(F.col(start), 1)) == F.col("_a.day"), "left")
           .join(sp.alias("_b"), clamp(F.col(end)) == F.col("_b.day"), "left"))
    ok: Column = F.col(end) >= F.col(start)
    for g in guards:
        ok = ok & F.col(g).isNotNull()
    cnt = F.when(ok, F.col("_b.cum") - F.col("_a.cum")).otherwise(F.lit(0)).cast("double")
    j = j.select(*[df[c] for c in df.columns], cnt.alias(out))
    return j
