"""Coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rational(x: Column) -> Column:
    """(numerator, denominator) in millionths, cut towards zero."""
    return F.struct((x * 1_000_000).cast("long").alias("num"), F.lit(1_000_000).cast("long").alias("den"))


def degrees_minutes_seconds(x: Column) -> Column:
    """Struct of whole degrees, whole minutes and seconds as rationals, of the absolute value."""
    a = F.abs(x)
    d = F.floor(a).cast("double")
    m = F.floor((a - d) * 60).cast("double")
    s = (a - d - m / 60) * 3600
    return F.struct(rational(d).alias("deg"), rational(m).alias("min"), rational(s).alias("sec"))


def gps_tags(lat: Column, lon: Column, alt: Column) -> Column:
    """The values of a GPS directory; zero counts as N, E and above the sea."""
    return F.struct(
        F.when(lat >= 0, "N").otherwise("S").alias("lat_ref"),
        degrees_minutes_seconds(lat).alias("lat"),
        F.when(lon >= 0, "E").otherwise("W").alias("lon_ref"),
        degrees_minutes_seconds(lon).alias("lon"),
        F.when(alt >= 0, 0).otherwise(1).alias("alt_ref"),
        rational(F.abs(alt)).alias("alt"),
    )
