"""Great-circle distance as native Column expressions (no Python UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: mean Earth radius in km used by the reference
EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    # rounding can push a a hair above 1 for antipodal points; sqrt(1 - a) must stay
    # real. Not ``least``: it skips NULL and would turn a missing point into 1.0.
    return F.when(a > 1.0, F.lit(1.0)).otherwise(a)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """atan2 form: 2 r atan2(sqrt(a), sqrt(1 - a)). NULL in -> NULL out."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km_asin(lat1, lon1, lat2, lon2) -> Column:
    """arcsin form: 2 r asin(sqrt(a)); equal to the atan2 form up to rounding."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.asin(F.sqrt(a))
