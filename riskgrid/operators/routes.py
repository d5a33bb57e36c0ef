"""Totals and plans of routes given as ordered steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions.motion import KNOT_MS


def turns(steps: DataFrame, key: str = "search") -> DataFrame:
    """Courses that differ from the one before, by route."""
    w = Window.partitionBy(key).orderBy("step")
    seen = steps.where("heading is not null").withColumn("__rg_b", F.lag("heading").over(w))
    return seen.groupBy(key).agg(F.count_if(F.abs(F.col("heading") - F.col("__rg_b")) > 1e-9).alias("turns"))


def totals(steps: DataFrame, key: str = "search") -> DataFrame:
    """Distance, hours, mean and extreme risk, least confidence and cost of each route."""
    edge = F.col("step") > 0
    return steps.groupBy(key).agg(
        F.sum("km").alias("km"),
        F.sum("hours").alias("hours"),
        F.when(F.sum("hours") > 0, F.sum("risk_hours") / F.sum("hours")).otherwise(F.max("risk")).alias("average_risk"),
        F.coalesce(F.max(F.when(edge, F.col("max_risk"))), F.max("max_risk")).alias("max_risk"),
        F.coalesce(F.min(F.when(edge, F.col("confidence"))), F.min("confidence")).alias("confidence"),
        F.max("cost").alias("cost"),
        F.max("step").alias("edges"),
    )


def ordered_distinct(values: Column) -> Column:
    """Elements of arrays in an ordered array, each kept where it is first seen."""
    return F.array_distinct(F.flatten(values))


def source_ids(steps: DataFrame, key: str = "search", ids: str = "sources") -> DataFrame:
    """Ids of the frames a route used, in the order they were first used; a route's steps are bounded by its horizon."""
    ordered = F.sort_array(F.collect_list(F.struct("step", ids)))
    return steps.groupBy(key).agg(ordered_distinct(F.transform(ordered, lambda x: x[ids])).alias("source_ids"))


def plans(steps: DataFrame, cells: DataFrame, key: str = "search") -> DataFrame:
    """One row for each route: its totals, turns and waypoints (the start carries its first edge's speed)."""
    w = Window.partitionBy(key).orderBy("step")
    placed = steps.join(cells.select("row", "col", "lat", "lon"), ["row", "col"])
    speed = F.coalesce(F.col("knots"), F.lead("knots").over(w)) * KNOT_MS
    points = placed.withColumn("mps", speed).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("step", "lon", "lat", "eta_us", "mps"))).alias("waypoints"))
    return totals(steps, key).join(turns(steps, key), key, "left").join(points, key).withColumn("turns", F.coalesce("turns", F.lit(0)))


def geojson(plan: DataFrame, key: str = "search") -> DataFrame:
    """Each plan as a GeoJSON feature collection: the line, then a point for each waypoint."""
    line = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.transform("waypoints", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"),
        F.struct(F.col(key).alias("plan"), F.col("km"), F.col("hours")).alias("properties"),
    )

    def point(p):
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(p["lon"], p["lat"]).alias("coordinates")).alias("geometry"), F.struct(p["step"].alias("index"), p["eta_us"].alias("eta_us"), p["mps"].alias("recommended_speed_mps")).alias("properties")))

    features = F.concat(F.array(F.to_json(line)), F.transform("waypoints", point))
    return plan.select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}")).alias("geojson"))


GEOJSON = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def from_geojson(documents: DataFrame, key: str = "search") -> DataFrame:
    """Waypoints (step, lon, lat) of feature collections: the line, feature 0, alone decides."""
    line = F.from_json(F.get_json_object("geojson", "$.features[0].geometry.coordinates"), "array<array<double>>")
    return documents.select(key, F.posexplode(line).alias("step", "p")).select(key, "step", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
