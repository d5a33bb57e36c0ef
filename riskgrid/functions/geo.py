"""Great-circle geometry as Catalyst expressions.

Longitudes are taken as they are: no wrap at 180 degrees. NULL in, NULL out.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Mean radius of the earth in km (fixed value).
EARTH_KM = 6371.0088

HAVERSINE_SQL = "2 * 6371.0088D * asin(least(1D, sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({y}) - radians({x})) / 2), 2))))"
_BEARING = "pmod(degrees(atan2(sin(radians({y}) - radians({x})) * cos(radians({b})), cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos(radians({y}) - radians({x})))) + 360D, 360D)"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course from the first point to the second, 0 to 360."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    x = F.sin(turn) * F.cos(b)
    y = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def heading_change(before: Column, after: Column) -> Column:
    """Smaller angle between two courses; 0 where there is no course before."""
    turn = F.pmod(after - before, F.lit(360.0))
    return F.coalesce(F.least(turn, 360 - turn), F.lit(0.0))


def edge_points(lat1: Column, lon1: Column, lat2: Column, lon2: Column, n: int = 3) -> Column:
    """Array of n points (i, fraction, lat, lon) on the straight line between two points, ends included."""
    if n < 2:
        raise ValueError("an edge has two points at least")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(i.alias("i"), (i / (n - 1)).alias("fraction"), (lat1 + (lat2 - lat1) * i / (n - 1)).alias("lat"), (lon1 + (lon2 - lon1) * i / (n - 1)).alias("lon")),
    )


def register(spark: SparkSession) -> None:
    """Make the functions usable from SQL text, as SQL expressions that Catalyst inlines."""
    args = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
    names = {"a": "lat1", "x": "lon1", "b": "lat2", "y": "lon2"}
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION haversine_km({args}) RETURNS DOUBLE RETURN {HAVERSINE_SQL.format(**names)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bearing_degrees({args}) RETURNS DOUBLE RETURN {_BEARING.format(**names)}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION heading_change(before DOUBLE, after DOUBLE) RETURNS DOUBLE RETURN coalesce(least(pmod(after - before, 360D), 360D - pmod(after - before, 360D)), 0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION risk_level(risk DOUBLE) RETURNS INT RETURN cast(least(5, greatest(1, floor(risk * 5) + 1)) as int)")
