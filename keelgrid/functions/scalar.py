"""Column expressions. A null input gives null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOT_MS, NAUTICAL_MILE_M = 0.514444, 1852.0
SPHERE_M, EQUATOR_M = 6_371_000.0, 6_378_137.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x cut to [low, high]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def null_least(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def finite_or_zero(x: Column) -> Column:
    """Null, NaN and infinite become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def is_false_or_null(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False))


def sanitise(x: Column) -> Column:
    """Every character that is not a letter, digit, underscore or hyphen becomes an underscore."""
    return F.regexp_replace(x, "[^A-Za-z0-9_-]", "_")


def tile_of(path: Column) -> Column:
    """The number in a file name like .../tile_0042.parquet; null where there is none."""
    digits = F.regexp_extract(path, r"tile_(\d+)\.[^/]*$", 1)
    return F.when(digits != "", digits.cast("int"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = SPHERE_M) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / F.lit(NAUTICAL_MILE_M)


def turn(before: Column, now: Column) -> Column:
    """Smallest angle between two courses, in degrees."""
    d = F.abs(now - before)
    return F.when(d > 180, 360 - d).otherwise(d)


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def days_in_year(year: Column) -> Column:
    return F.date_diff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))
