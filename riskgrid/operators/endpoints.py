"""End points of voyages on the grid: start in its region, what it reaches, goal in its region and reach.

Voyages have search, start_lat, start_lon, goal_lat, goal_lon and a region
around each (start_south, start_north, start_west, start_east, and the same
for goal), bounds included. Cells have row, col, lat, lon and open. All
voyages go through three steps at once: a snap, the root of the start's
component, a snap among the cells of that root.

Defined cases: a null coordinate or bound lies in no region; a voyage without
an open cell near its start never looks for a goal; voyages of one search id
are one voyage only if they agree in all columns; no voyages give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators.grid import rooted_cells, snap
from riskgrid.operators.shared import folder, written

#: What is told of an end point (fixed values).
CODES = {"no grid node": "allowed_region_has_no_grid_node", "no navigable node": "allowed_region_has_no_navigable_grid_node", "no reachable node": "allowed_region_has_no_reachable_grid_node"}
#: A move by less is none, in km.
STILL_KM = 1e-9


def _ends(voyages: DataFrame, role: str) -> DataFrame:
    box = ("south", "north", "west", "east")
    return voyages.select(F.col("search").alias("point_id"), F.col(f"{role}_lat").alias("lat"), F.col(f"{role}_lon").alias("lon"), *(F.col(f"{role}_{b}").alias(b) for b in box))


def _inside():
    return F.col("cell_lat").between(F.col("south"), F.col("north")) & F.col("cell_lon").between(F.col("west"), F.col("east"))


def map_endpoints(cells: DataFrame, voyages: DataFrame, max_km: float, connectivity: int = 8) -> DataFrame:
    """For each voyage: status (ok, or the role and code of what failed), both nodes, how far they were moved, and the number of cells the start reaches."""
    spark = cells.sparkSession
    base = folder(spark, "endpoints")
    voyages = voyages.distinct()
    start = written(snap(_ends(voyages, "start"), cells, max_km, _inside()), f"{base}/start")
    rooted = rooted_cells(cells.where("open"), connectivity)
    begun = written(start.where("status = 'ok'").select(F.col("point_id").alias("search"), "row", "col").join(rooted, ["row", "col"]).select("search", F.col("root").alias("from_root")), f"{base}/begun")
    size = begun.join(rooted.groupBy(F.col("root").alias("from_root")).agg(F.count("*").alias("component_size")), "from_root").select("search", "component_size")
    goals = _ends(voyages, "goal").join(begun.withColumnRenamed("search", "point_id"), "point_id")
    goal = written(snap(goals, cells.join(rooted, ["row", "col"], "left"), max_km, _inside()), f"{base}/goal")
    both = voyages.select("search").join(start.withColumnRenamed("point_id", "search"), "search", "left")
    g = goal.select(F.col("point_id").alias("search"), F.col("status").alias("goal_status"), F.col("row").alias("goal_row"), F.col("col").alias("goal_col"), F.col("km").alias("goal_km"))
    code = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    out = both.join(g, "search", "left").join(size, "search", "left")
    one = (F.col("row") == F.col("goal_row")) & (F.col("col") == F.col("goal_col"))
    status = (
        F.when(F.col("status") != "ok", F.concat(F.lit("start: "), code[F.col("status")]))
        .when(F.col("goal_status") != "ok", F.concat(F.lit("goal: "), code[F.col("goal_status")]))
        .when(one, "start and goal are one node")
        .otherwise("ok")
    )
    return out.select("search", status.alias("status"), F.col("row").alias("start_row"), F.col("col").alias("start_col"), F.col("km").alias("start_km"), "goal_row", "goal_col", "goal_km", F.coalesce("component_size", F.lit(0)).alias("component_size"))


def audit(mapped: DataFrame, voyages: DataFrame, cells: DataFrame, max_km: float) -> DataFrame:
    """(search, document): what was asked for and what was taken, as JSON, of every mapped voyage."""
    at = cells.select("row", "col", "lat", "lon")
    out = mapped.where("status = 'ok'").join(voyages, "search")
    for role in ("start", "goal"):
        out = out.join(at.select(F.col("row").alias(f"{role}_row"), F.col("col").alias(f"{role}_col"), F.col("lat").alias(f"{role}_node_lat"), F.col("lon").alias(f"{role}_node_lon")), [f"{role}_row", f"{role}_col"])

    def end(role: str):
        return F.struct(
            F.struct(F.col(f"{role}_lon").alias("longitude"), F.col(f"{role}_lat").alias("latitude")).alias("requested"),
            F.struct(F.col(f"{role}_node_lon").alias("longitude"), F.col(f"{role}_node_lat").alias("latitude")).alias("resolved"),
            F.struct(F.col(f"{role}_row").alias("row"), F.col(f"{role}_col").alias("column")).alias("node"),
            F.col(f"{role}_km").alias("adjustment_km"),
            F.lit(max_km).alias("max_adjustment_km"),
            (F.col(f"{role}_km") > STILL_KM).alias("snapped"),
        )

    return out.select("search", F.to_json(F.struct(end("start").alias("start"), end("goal").alias("goal"), F.col("component_size").alias("connected_component_size"))).alias("document"))
