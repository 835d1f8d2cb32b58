"""DIFOT KPI summaries: distinct orders with a bad / good line per group.

The reference writes two ``countDistinct(when(label == v, order_no))`` per
group. Catalyst plans two distinct aggregates with different arguments as an
Expand that doubles every input row. Here each group is first reduced to one row
per (group, order) carrying two 0/1 flags (map-side combined, spread over
orders, so a hot group key does not land on one task), then summed per group.
Same counts: an order with good and bad lines counts in both columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kpi(df: DataFrame, *dims: str, label: str = "difot", order: str = "order_no") -> DataFrame:
    """dims..., order_non_difot, order_difot, difot_pct (NULL when both are 0)."""
    has = F.col(order).isNotNull()
    per_order = df.groupBy(*dims, order).agg(
        F.max(F.when(has & (F.col(label) == 0), 1).otherwise(0)).alias("_bad"),
        F.max(F.when(has & (F.col(label) == 1), 1).otherwise(0)).alias("_good"))
    out = per_order.groupBy(*dims).agg(F.sum("_bad").cast("long").alias("order_non_difot"),
                                       F.sum("_good").cast("long").alias("order_difot"))
    return out.withColumn("difot_pct", kpi_ratio("order_difot", "order_non_difot"))


def kpi_ratio(good: str, bad: str):
    """good / (good + bad) * 100; 0/0 gives NULL (``try_divide``; ANSI would raise)."""
    return F.try_divide(F.col(good).cast("double"), (F.col(good) + F.col(bad)).cast("double")) * 100.0


def kpi_monthly(daily: DataFrame, date_col: str = "order_date") -> DataFrame:
    """Monthly trend from the per-date KPI: sums of daily distinct counts, then the ratio.

    An order spanning several dates counts once per date, as in the reference."""
    m = daily.withColumn("month_year", F.date_format(date_col, "yyyy-MM"))
    out = m.groupBy("month_year").agg(F.sum("order_difot").cast("long").alias("total_difot"),
                                      F.sum("order_non_difot").cast("long").alias("total_non_difot"))
    return (out.withColumn("difot_pct", kpi_ratio("total_difot", "total_non_difot"))
               .withColumn("month_start", F.to_date("month_year", "yyyy-MM")))


# region codes of the test fixtures (region = r_name)
FIXTURE_REGION_CODES = {
    "AFRICA": "AFR",
    "AMERICA": "AME",
    "ASIA": "ASI",
    "EUROPE": "EUR",
    "MIDDLE EAST": "MEA",
}


#: Regions that a pivot may have, as many as Spark's own limit on pivot columns.
MAX_REGIONS = 10_000


def pivot_kpi(per_region_item: DataFrame, region_codes: dict[str, str] | None = None,
              item: str = "item_code", region: str = "region", value: str = "difot_pct") -> DataFrame:
    """item x region matrix of the ratio (mean per cell), of all regions in the data, in the order
    of their names; a missing region has no column. ``region_codes`` only renames columns: regions
    without a code keep their names, codes without a region give nothing."""
    found = per_region_item.where(F.col(region).isNotNull()).select(region).distinct().orderBy(region)
    regions = [r[0] for r in found.limit(MAX_REGIONS + 1).collect()]
    if len(regions) > MAX_REGIONS:
        raise ValueError(f"more than {MAX_REGIONS} regions don't make a pivot")
    codes = region_codes or {}
    p = per_region_item.groupBy(item).pivot(region, regions).agg(F.avg(value))
    return p.select(item, *[F.col(f"`{name}`").alias(codes.get(name, name)) for name in regions])


def top_items(pivoted: DataFrame, n: int = 20, item: str = "item_code") -> DataFrame:
    """Top n rows by the sum of their non-missing cells (ties by item); the sum is dropped.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its own
    top n, only n rows per task reach the final merge."""
    cells = [c for c in pivoted.columns if c != item]
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cells), F.lit(0.0))
    return (pivoted.withColumn("_total", total)
                   .orderBy(F.col("_total").desc(), F.col(item).asc())
                   .limit(n).drop("_total"))
