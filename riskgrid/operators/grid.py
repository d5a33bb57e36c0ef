"""The planning grid: nodes, edges, components, and snapping of end points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.geo import bearing_degrees, haversine_km
from riskgrid.operators.components import components
from riskgrid.operators.sample import axis_literal, line_below, step_of
from riskgrid.operators.shared import folder, written

#: Neighbour offsets (fixed order).
OFFSETS8 = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
OFFSETS4 = ((-1, 0), (0, -1), (0, 1), (1, 0))


#: Kilometres in a degree of latitude, at least.
KM_DEGREE = 110.5


def nodes(cube: DataFrame) -> DataFrame:
    """(row, col, lat, lon) of every cell."""
    return cube.groupBy("row", "col").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))


def edges(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """Directed edges between neighbouring cells, with distance and course; one equi-join."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    moves = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in (OFFSETS8 if connectivity == 8 else OFFSETS4)))
    step = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), "lat", "lon", F.explode(moves).alias("m"))
    step = step.select("r", "c", "lat", "lon", "m.dr", "m.dc", (F.col("r") + F.col("m.dr")).alias("row"), (F.col("c") + F.col("m.dc")).alias("col"))
    to = cells.select("row", "col", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    out = step.join(to, ["row", "col"])
    ends = (F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return out.select("r", "c", "dr", "dc", F.col("row").alias("r2"), F.col("col").alias("c2"), *ends, haversine_km(*ends).alias("km"), bearing_degrees(*ends).alias("heading"))


def nearest_node(points: DataFrame, lats: list[float], lons: list[float]) -> DataFrame:
    """For each point (point_id, lat, lon) the nearest line of each axis; the first of equally near ones."""

    def nearest(x: Column, axis: list[float]) -> Column:
        if step_of(axis):
            # the line below, and those beside it: the nearest is one of them
            values, low = axis_literal(axis), line_below(x, axis)
            each = F.transform(F.array(low - 1, low, low + 1, low + 2), lambda i: F.when((i >= 0) & (i < len(axis)), F.struct(F.round(F.abs(x - F.get(values, i)), 9).alias("d"), i.alias("i"))))
            return F.array_min(F.array_compact(each))["i"]
        each = F.array(*(F.struct(F.round(F.abs(x - v), 9).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(axis)))
        return F.array_min(each)["i"]

    return points.select("point_id", nearest(F.col("lat"), lats).alias("row"), nearest(F.col("lon"), lons).alias("col"))


def _square(lat: Column, lon: Column, max_km: float, near: bool) -> Column:
    """The square (band of latitude, sector of longitude) of a place; with ``near`` all squares that hold places within the distance, as an array.

    Bands are as high as the distance. A band has as many sectors, all equally
    wide, as are wider than the distance at the end of the band nearer to a
    pole; sectors go round the globe.
    """
    height = max(max_km / KM_DEGREE, 0.25) * 1.0001

    def sector(band: Column, side: int) -> Column:
        far = F.greatest(F.abs(band * height), F.abs((band + 1) * height))
        room = F.when(far < 89.9, F.cos(F.radians(far))).otherwise(0.0)
        n = F.greatest(F.lit(1.0), F.floor(360.0 * room * KM_DEGREE / (max_km * 1.01 + 1e-9)))
        n = F.least(n, F.lit(float(1 << 20))).cast("long")
        return F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("long") + side, n)

    own = F.floor(lat / height)
    if not near:
        return F.struct(own.alias("y"), sector(own, 0).alias("x"))
    return F.array_distinct(F.array(*(F.struct((own + k).alias("y"), sector(own + k, side).alias("x")) for k in (-1, 0, 1) for side in (-1, 0, 1))))


def snap(points: DataFrame, cells: DataFrame, max_km: float, within: Column | None = None) -> DataFrame:
    """For each point (point_id, lat, lon, and any box columns) its nearest open cell within a distance.

    ``cells`` has row, col, lat, lon and ``open``, and may have ``root``, the
    name of its component; points with a ``from_root`` take only cells of that
    component. ``within`` may use the columns of both (cell coordinates as
    cell_lat, cell_lon). Returns the node, its distance, and a status that
    tells what was missing.

    Points and cells meet in an equi-join on squares of a two-dimensional
    index, each point looking into its own and the eight around it; what lies
    in a point's region beyond them only tells the status, and is counted from
    the region's squares alone.
    """
    rooted = "from_root" in points.columns
    c = cells.select("row", "col", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), "open", *(["root"] if rooted else []), _square(F.col("lat"), F.col("lon"), max_km, False).alias("__rg_s"))
    near = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("__rg_s", F.explode(_square(F.col("lat"), F.col("lon"), max_km, True)))
    within = within if within is not None else F.lit(True)
    # only open cells can be taken
    met = c.where("open").join(near, "__rg_s").where(within)
    far = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")), 6)
    met = met.withColumn("km", far).where(F.col("km") <= max_km)
    if rooted:
        met = met.where("root = from_root")
    best = met.groupBy("point_id").agg(F.min(F.struct("km", "row", "col")).alias("best"))
    counts = _in_region(points, cells, within)
    out = points.select("point_id").join(counts, "point_id", "left").join(best, "point_id", "left")
    n_cells, n_open = F.coalesce("n_cells", F.lit(0)), F.coalesce("n_open", F.lit(0))
    status = F.when(n_cells == 0, "no grid node").when(n_open == 0, "no navigable node").when(F.col("best").isNull(), "no reachable node").otherwise("ok")
    return out.select("point_id", status.alias("status"), F.col("best.row").alias("row"), F.col("best.col").alias("col"), F.col("best.km").alias("km"), n_cells.alias("n_cells"), n_open.alias("n_open"))


def _in_region(points: DataFrame, cells: DataFrame, within: Column) -> DataFrame:
    """Cells and open cells in the region of each point. Points without a box share one count of the whole grid; boxes meet the cells of the whole degrees they reach over."""
    if "south" not in points.columns:
        whole = cells.agg(F.count("*").alias("n_cells"), F.count_if("open").alias("n_open")).first()
        return points.select("point_id", F.lit(whole.n_cells).alias("n_cells"), F.lit(whole.n_open).alias("n_open"))
    c = cells.select(F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), "open", F.floor("lat").alias("__rg_y"), F.floor("lon").alias("__rg_x"))

    def degrees(low: str, high: str, most: float) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(F.col(low), F.lit(-most))), F.floor(F.least(F.col(high), F.lit(most)))))

    boxes = points.where("south <= north and north >= -90 and south <= 90").withColumn("__rg_y", degrees("south", "north", 90.0))
    keys = ["__rg_y"]
    if "west" in points.columns:  # else the region is a band
        boxes = boxes.where("west <= east and east >= -180 and west <= 180").withColumn("__rg_x", degrees("west", "east", 180.0))
        keys.append("__rg_x")
    return c.join(boxes, keys).where(within).groupBy("point_id").agg(F.count("*").alias("n_cells"), F.count_if("open").alias("n_open"))


def rooted_cells(open_cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """(row, col, root): open cells with the name of their component, written once.

    The grid is parted into its components once, in rounds that grow with the
    logarithm of a component's size.
    """
    half = [m for m in (OFFSETS8 if connectivity == 8 else OFFSETS4) if m > (0, 0)]
    moves = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in half))

    def name(row, col) -> Column:
        return (F.col(row) if isinstance(row, str) else row).cast("long") * (1 << 32) + (F.col(col) if isinstance(col, str) else col)

    cells = open_cells.select("row", "col").distinct()
    step = cells.select(name("row", "col").alias("u"), "row", "col", F.explode(moves).alias("m"))
    step = step.select("u", name(F.col("row") + F.col("m.dr"), F.col("col") + F.col("m.dc")).alias("v"))
    named = cells.select(name("row", "col").alias("v"), "row", "col")
    roots = components(step.join(named.select("v"), "v"), "component")
    rooted = named.join(roots.select(F.col("node").alias("v"), "root"), "v", "left").select("row", "col", F.coalesce("root", "v").alias("root"))
    return written(rooted, folder(open_cells.sparkSession, "component-cells"))


def component(open_cells: DataFrame, starts: DataFrame, connectivity: int = 8) -> DataFrame:
    """Cells (search, row, col) connected with each start over open cells; none if the start is not open.

    As large as starts times cells, since all are asked for; who only wants to
    know whether a cell is reached compares roots (``rooted_cells``).
    """
    rooted = rooted_cells(open_cells, connectivity)
    begun = starts.select("search", "row", "col").distinct().join(rooted, ["row", "col"]).select("search", "root").distinct()
    return begun.join(rooted, "root").select("search", "row", "col")
