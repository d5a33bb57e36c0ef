"""Layered plans and sets as GeoJSON, both ways, and what is wrong with a collection that was read.

A plan is a collection of its line and a point for each waypoint; a set is a
collection of its twelve lines, by layer and objective, and no points. The
line's feature carries all: coordinates, times and speeds are arrays of one
length, so plans are read from lines alone, and points are only compared with
them, one by one. Texts are made and read by expressions in one row; a set
gathers its twelve places and no more (``place`` is checked first).

Plans have set_id, layer, objective, plan_id, reference_plan_id and waypoints:
an array of structs (lon, lat, eta_us, mps) in order, mps NULL where unknown.

Defined cases: a set with a place missing or told twice gives no collection; a
text that is no collection is one problem of its own, and gives no plans;
points of another shape don't match; null and empty texts are no collections;
empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.motion import OBJECTIVES
from riskgrid.operators.layers import LAYERS
from riskgrid.operators.shared import dealt

PLACES = [(n, o) for n, _ in LAYERS for o in OBJECTIVES]
_KEEP = {"ignoreNullFields": "false"}
#: What is read of a feature; texts of numbers stay texts, so that a missing one is told from none.
_LINE = "struct<type:string,coordinates:array<array<double>>>"
_ROUTE = "struct<feature_role:string,set_id:string,layer:string,objective:string,plan_id:string,reference_plan_id:string,waypoint_etas:array<bigint>,recommended_speeds_mps:array<double>>"
_FEATURE = f"struct<type:string,id:string,geometry:{_LINE},properties:{_ROUTE}>"
_POINT = "struct<type:string,id:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<feature_role:string,plan_id:string,index:int,eta_us:bigint,recommended_speed_mps:double>>"
_FAULT = "__rg_fault"
PLAN_ROW = "set_id", "layer", "objective", "plan_id", "reference_plan_id", "waypoints"


def _line() -> Column:
    """The feature of a plan's line."""
    points = F.transform("waypoints", lambda p: F.array(p["lon"], p["lat"]))
    told = (F.lit("route").alias("feature_role"), *PLAN_ROW[:-1], F.col("waypoints.eta_us").alias("waypoint_etas"), F.col("waypoints.mps").alias("recommended_speeds_mps"))
    return F.struct(F.lit("Feature").alias("type"), F.col("plan_id").alias("id"), F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")).alias("geometry"), F.struct(*told).alias("properties"))


def _points(plan_id: Column, waypoints: Column) -> Column:
    """The features of a plan's waypoints."""

    def one(p: Column, i: Column) -> Column:
        told = F.struct(F.lit("waypoint").alias("feature_role"), plan_id.alias("plan_id"), i.cast("int").alias("index"), p["eta_us"].alias("eta_us"), p["mps"].alias("recommended_speed_mps"))
        where = F.struct(F.lit("Point").alias("type"), F.array(p["lon"], p["lat"]).alias("coordinates"))
        return F.struct(F.lit("Feature").alias("type"), F.concat(plan_id, F.lit(":waypoint:"), i.cast("string")).alias("id"), where.alias("geometry"), told.alias("properties"))

    return F.transform(waypoints, one)


def _collection(features: Column, told: Column) -> Column:
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit('],"properties":'), told, F.lit("}"))


def plan_collections(plans: DataFrame) -> DataFrame:
    """(plan_id, geojson): the line, then a point for each waypoint."""
    points = F.transform(_points(F.col("plan_id"), F.col("waypoints")), lambda x: F.to_json(x, _KEEP))
    return plans.select("plan_id", _collection(F.concat(F.array(F.to_json(_line(), _KEEP)), points), F.lit("{}")).alias("geojson"))


def _place() -> Column:
    """Rank of a plan's layer and objective in a set; NULL for any other."""
    rank = F.create_map(*(F.lit(x) for i, (n, o) in enumerate(PLACES) for x in (f"{n}/{o}", i)))
    return F.try_element_at(rank, F.concat_ws("/", "layer", "objective"))


def set_collections(plans: DataFrame) -> DataFrame:
    """(set_id, geojson) of every set that has each layer and objective once: its lines in their order."""
    rows = plans.select("set_id", _place().alias("place"), F.to_json(_line(), _KEEP).alias("line"))
    one = dealt(rows, "set_id").groupBy("set_id", "place").agg(F.count("*").alias("n"), F.first("line").alias("line"))
    whole = one.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"), F.max("n").alias("n"), F.count_if(F.col("place").isNull()).alias("other"))
    whole = whole.where((F.size("lines") == len(PLACES)) & (F.col("n") == 1) & (F.col("other") == 0))
    return whole.select("set_id", _collection(F.col("lines.line"), F.to_json(F.struct("set_id"), _KEEP)).alias("geojson"))


def _read(line: Column) -> Column:
    """A plan's row from its line."""
    p = line["properties"]
    waypoints = F.transform(
        line["geometry"]["coordinates"],
        lambda c, i: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat"), F.get(p["waypoint_etas"], i).alias("eta_us"), F.get(p["recommended_speeds_mps"], i).alias("mps")),
    )
    return F.struct(*(p[c].alias(c) for c in PLAN_ROW[:-1]), waypoints.alias("waypoints"))


def _line_rules(line: Column) -> dict[str, Column]:
    p, g = line["properties"], line["geometry"]
    n = F.size(g["coordinates"])
    return {
        "feature is no route": ~(line["type"].eqNullSafe(F.lit("Feature")) & p["feature_role"].eqNullSafe(F.lit("route"))),
        "geometry is no line": ~g["type"].eqNullSafe(F.lit("LineString")) | g["coordinates"].isNull() | F.exists(g["coordinates"], lambda c: c.isNull() | (F.size(c) != 2) | c[0].isNull() | c[1].isNull()),
        "arrays of different lengths": ~n.eqNullSafe(F.size(p["waypoint_etas"])) | ~n.eqNullSafe(F.size(p["recommended_speeds_mps"])),
        "id is not the plan's": ~line["id"].eqNullSafe(p["plan_id"]) | line["id"].isNull(),
    }


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are computed once for each: a generator is a boundary that keeps what is parsed out of the functions that use it."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select("*", F.explode(F.array(made)).alias("__rg_o")).select(*rows.columns, *(f"__rg_o.{n}" for n in columns))


def _featured(rows: DataFrame) -> DataFrame:
    """Rows with the features of their collection as texts instead of the collection, read in one pass; NULL for anything else, a text that ends early too."""
    read = _once(rows, read=F.from_json("geojson", f"struct<type:string,features:array<string>,{_FAULT}:string>", {"columnNameOfCorruptRecord": _FAULT})).drop("geojson")
    whole = F.col("read.type").eqNullSafe(F.lit("FeatureCollection")) & F.col(f"read.{_FAULT}").isNull()
    return read.withColumn("features", F.when(whole, F.col("read.features"))).drop("read")


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())))


def read_sets(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plans (PLAN_ROW) of set collections (set_id, geojson) that hold, and (set_id, problem) of the others."""
    rows = _featured(documents.select(F.col("set_id").alias("__rg_id"), "geojson"))
    lines = _once(rows, lines=F.transform("features", lambda t: F.from_json(t, _FEATURE))).drop("features")
    places = F.transform("lines", lambda x: F.concat_ws("/", x["properties"]["layer"], x["properties"]["objective"]))
    wanted = F.array(*(F.lit(f"{n}/{o}") for n, o in PLACES))
    whole = {
        "not twelve route features": F.size("lines") != len(PLACES),
        "not every layer and objective once": (F.size("lines") == len(PLACES)) & (F.array_sort(places) != F.array_sort(wanted)),
        "a plan of another set": F.exists("lines", lambda x: ~x["properties"]["set_id"].eqNullSafe(F.col("__rg_id"))),
    }
    every = F.array_distinct(F.concat(_broken(whole), F.flatten(F.transform("lines", lambda x: _broken(_line_rules(x))))))
    told = lines.withColumn("problems", F.when(F.col("lines").isNull(), F.array(F.lit("not a feature collection"))).otherwise(every))
    plans = told.where(F.size("problems") == 0).select(F.explode("lines").alias("line")).select(_read(F.col("line")).alias("p")).select("p.*")
    return plans, told.select(F.col("__rg_id").alias("set_id"), F.explode("problems").alias("problem"))


def read_plans(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plans (PLAN_ROW) of plan collections (plan_id, geojson) whose points bear out their line, and (plan_id, problem) of the others."""
    rows = _featured(documents.select(F.col("plan_id").alias("__rg_id"), "geojson"))
    parsed = _once(rows, line=F.from_json(F.get("features", F.lit(0)), _FEATURE))
    parsed = _once(parsed, plan=_read(F.col("line")))
    texts = F.slice("features", 2, F.greatest(F.size("features") - 1, F.lit(0)))
    want = _points(F.col("plan.plan_id"), F.col("plan.waypoints"))
    told = _once(parsed, texts=texts, want=want)
    # a text that is the wanted one is read as the wanted point; only others are parsed to compare what they say
    equal = F.coalesce(F.col("texts") == F.transform("want", lambda x: F.to_json(x, _KEEP)), F.lit(False))
    differs = F.exists(F.arrays_zip(F.transform("texts", lambda t: F.from_json(t, _POINT)).alias("points"), "want"), lambda x: ~F.to_json(x["points"], _KEEP).eqNullSafe(F.to_json(x["want"], _KEEP)))
    whole = {
        **_line_rules(F.col("line")),
        "not the plan": ~F.col("line.properties.plan_id").eqNullSafe(F.col("__rg_id")),
        "another number of waypoints": ~F.size("texts").eqNullSafe(F.size("want")),
        "a waypoint does not match": F.when(F.size("texts") != F.size("want"), False).when(equal, False).otherwise(differs),
    }
    told = _once(told, problems=F.when(F.col("features").isNull(), F.array(F.lit("not a feature collection"))).otherwise(_broken(whole)))
    return told.where(F.size("problems") == 0).select("plan.*"), told.select(F.col("__rg_id").alias("plan_id"), F.explode("problems").alias("problem"))
