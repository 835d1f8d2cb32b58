"""Coordinate checks, median fill, IQR outlier removal and data audits.

The statistics that later steps need (median, quartile bounds) are single values, fetched by
distributed selection (``ranks``) and put into the next plan as literals.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUS_LAT, CUS_LON = "gps_cus_latitude", "gps_cus_longitude"
DIST_LAT, DIST_LON = "gps_dist_latitude", "gps_dist_longitude"


def valid_gps_condition(strict: bool = False) -> Column:
    """Median population test.

    The reference tests the customer point for NULL and the distributor point for
    zero, so a customer at (0, 0) enters the median; ``strict=True`` demands all
    four coordinates present and non-zero.
    """
    cus = F.col(CUS_LAT).isNotNull() & F.col(CUS_LON).isNotNull()
    dist = (F.col(DIST_LAT) != 0) & (F.col(DIST_LON) != 0)
    if strict:
        cus = cus & (F.col(CUS_LAT) != 0) & (F.col(CUS_LON) != 0)
        dist = dist & F.col(DIST_LAT).isNotNull() & F.col(DIST_LON).isNotNull()
    return cus & dist


def valid_gps(df: DataFrame, strict: bool = False) -> DataFrame:
    return df.filter(valid_gps_condition(strict))


def needs_fill(distance: str = "distance_km") -> Column:
    """Any zero coordinate, or no distance at all."""
    zero = reduce(lambda a, b: a | b, [F.col(c) == 0 for c in (CUS_LAT, CUS_LON, DIST_LAT, DIST_LON)])
    return zero | F.col(distance).isNull()


def fill_distance(df: DataFrame, median, distance: str = "distance_km") -> DataFrame:
    """Replace bad distances by ``median`` (a float or a scalar Column)."""
    m = median if isinstance(median, Column) else F.lit(float(median))
    return df.withColumn(distance, F.when(needs_fill(distance), m).otherwise(F.col(distance)))


def bounds(q1: float, q3: float, k: float = 2.0) -> tuple[float, float]:
    """Q1 - k IQR and Q3 + k IQR."""
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def approx_quartiles(df: DataFrame, x: str, rel_error: float) -> tuple[float, float]:
    """Q1 and Q3 within a relative rank error, in one pass."""
    return tuple(df.agg(F.percentile_approx(x, [0.25, 0.75], int(round(1.0 / rel_error)))).first()[0])


def between(df: DataFrame, x: str, lo: float, hi: float) -> DataFrame:
    """Keep lo <= x <= hi (both ends included); NULL is dropped."""
    return df.filter((F.col(x) >= F.lit(float(lo))) & (F.col(x) <= F.lit(float(hi))))


def retention(df: DataFrame, kept: Column) -> DataFrame:
    """Rows before, rows kept and share kept in percent, in one pass."""
    return (df.agg(F.count(F.lit(1)).alias("rows_before"),
                   F.count(F.when(kept, 1)).alias("rows_after"))
              .withColumn("pct_kept", F.round(F.try_divide(F.col("rows_after") * 100.0, F.col("rows_before")), 6)))


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: number of NULLs, plus the number of rows with any NULL; one pass."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    aggs = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in cols]
    return df.agg(*aggs, F.count(F.when(any_null, 1)).alias("rows_with_null"),
                  F.count(F.lit(1)).alias("rows"))


def clean_points(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Text or number coordinates -> double (bad -> NULL), keep lat >= 1 and lon >= 1."""
    return (df.dropna(subset=[lat, lon])
              .withColumn(lat, F.col(lat).cast("string").try_cast("double"))
              .withColumn(lon, F.col(lon).cast("string").try_cast("double"))
              .filter((F.col(lat) >= 1) & (F.col(lon) >= 1)))


# fixed values: the reference's per-column defaults for missing categories
CATEGORY_DEFAULTS = {
    "channelname": "DRINKING",
    "segmentation": "Bronze",
    "brand": "*******",
    "pack_type": "PET",
    "pack_size": "320ML",
}


def fill_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    return df.fillna(defaults or CATEGORY_DEFAULTS)
