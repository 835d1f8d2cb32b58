"""Nearest reference point (city centre) for each location.

A centre list of at most ``MAX_CENTRES`` rows, which is checked, is gathered once into an array by a
scalar subquery and each location folds over it with a higher-order ``aggregate``: no cross join, no
shuffle, no Python. A longer list goes through the exact k-NN join (``knn``): on the unit sphere in
three dimensions the order of chords is the order of great circles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipshape.functions.geo import EARTH_RADIUS_KM, haversine_km_asin
from shipshape.operators.knn import knn_mean

MAX_CENTRES = 10_000


def nearest_centre(points: DataFrame, centres: DataFrame, lat: str, lon: str,
                   out: str = "nearest_city", digits: int = 6) -> DataFrame:
    """Adds ``out`` (centre name) and ``<out>_km``. Distances are rounded to
    ``digits`` before comparison; equal distances go to the lowest ``seq``. Lists of more than
    ``MAX_CENTRES`` rows are joined (``nearest_centre_join``)."""
    if centres.limit(MAX_CENTRES + 1).count() > MAX_CENTRES:
        return nearest_centre_join(points, centres, lat, lon, out, digits)
    arr = centres.agg(F.sort_array(F.collect_list(
        F.struct(F.col("seq").cast("int").alias("seq"), F.col("city").alias("city"),
                 F.col("latitude").cast("double").alias("lat"),
                 F.col("longitude").cast("double").alias("lon"))))).scalar()
    init = F.struct(F.lit(float("inf")).alias("d"), F.lit(2**31 - 1).alias("seq"),
                    F.lit(None).cast("string").alias("city"))

    def step(acc: Column, c: Column) -> Column:
        d = F.round(haversine_km_asin(F.col(lat), F.col(lon), c["lat"], c["lon"]), digits)
        better = (d < acc["d"]) | ((d == acc["d"]) & (c["seq"] < acc["seq"]))
        return F.when(better, F.struct(d.alias("d"), c["seq"].alias("seq"), c["city"].alias("city"))).otherwise(acc)

    # the array is projected first: a subquery may not sit inside a lambda
    best = F.aggregate(F.col("_centres"), init, step)
    return (points.withColumn("_centres", arr).withColumn("_best", best).drop("_centres")
                  .withColumn(out, F.col("_best.city"))
                  .withColumn(f"{out}_km", F.col("_best.d"))
                  .drop("_best"))


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """The point in kilometres from the earth's centre."""
    a, b = F.radians(lat.cast("double")), F.radians(lon.cast("double"))
    r = F.lit(EARTH_RADIUS_KM)
    return [(r * F.cos(a) * F.cos(b)).alias("_v0"), (r * F.cos(a) * F.sin(b)).alias("_v1"), (r * F.sin(a)).alias("_v2")]


def nearest_centre_join(points: DataFrame, centres: DataFrame, lat: str, lon: str,
                        out: str = "nearest_city", digits: int = 6) -> DataFrame:
    """The same for lists of any size, by the pivot-partitioned join on the sphere.

    Chords that agree to a micrometre are ties and go to the lowest ``seq``, which is unique. Centres and
    points without coordinates, or with ones that are not finite, take no part: such points, and all where no centre is
    left, get null."""
    fine = lambda a, b: F.coalesce(F.abs(F.col(a).cast("double") + F.col(b).cast("double")) < float("inf"), F.lit(False))
    c = centres.where(fine("latitude", "longitude") & F.col("seq").isNotNull())
    targets = c.select(*_on_sphere(F.col("latitude"), F.col("longitude")), F.col("seq").cast("double").alias("_seq"),
                       F.lit(1).alias("_m"))
    at = points.withColumns({f"__p{i}": F.when(fine(lat, lon), v) for i, v in enumerate(_on_sphere(F.col(lat), F.col(lon)))})
    asked = at.where("__p0 IS NOT NULL").select(*[F.col(f"__p{i}").alias(f"_v{i}") for i in range(3)])
    found = knn_mean(asked, targets, 3, 1, value="_seq").select(*[F.col(f"_v{i}").alias(f"__q{i}") for i in range(3)],
                                                                F.col("knn_value").cast("long").alias("__seq"))
    named = c.select(F.col("seq").cast("long").alias("__c"), F.col("city").alias(out), F.col("latitude").alias("__lat"),
                     F.col("longitude").alias("__lon"))
    joined = at.join(found, [at[f"__p{i}"] == found[f"__q{i}"] for i in range(3)], "left").join(
        named, F.col("__seq") == F.col("__c"), "left")
    km = F.round(haversine_km_asin(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon")), digits)
    return joined.select(*points.columns, out, km.alias(f"{out}_km"))
