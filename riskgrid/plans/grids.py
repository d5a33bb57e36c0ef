"""Queries on geometry, the planning grid, speed and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.functions.geo import EARTH_KM, bearing_degrees, edge_points as points_between, haversine_km, heading_change as turn_between
from riskgrid.functions.motion import OBJECTIVES, Vessel, edge_cost as cost_parts, lower_bound as least_cost, speed_status, vessel_speed as knots
from riskgrid.operators import endpoints, grid
from riskgrid.operators.edges import cross, edge_series, reject_counts as rejects
from riskgrid.operators.sample import axis_of
from riskgrid.plans.cubes import event_points
from riskgrid.plans.registry import CUBE, EDGES, ORACLE_SQL, T0, query
from riskgrid.sources.cube import FRAMES, table, table_cube


def sql_km(a: str, x: str, b: str, y: str) -> str:
    return f"2 * {EARTH_KM}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({y}) - radians({x})) / 2), 2))))"


def sql_course(a: str, x: str, b: str, y: str) -> str:
    turned = f"degrees(atan2(sin(radians({y}) - radians({x})) * cos(radians({b})), cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos(radians({y}) - radians({x}))))"
    return f"CASE WHEN {turned} < 0 THEN {turned} + 360 ELSE {turned} END"


#: Legs between an event's place and the one before it of the same user.
LEGS = """p AS (SELECT event_id, user_id, 70.0::DOUBLE + 0.05::DOUBLE * ((event_id * 7 % 46) / 4.0::DOUBLE) AS lat, 18.0::DOUBLE + 0.1::DOUBLE * ((event_id * 11 % 38) / 4.0::DOUBLE) AS lon FROM events),
legs AS (SELECT * FROM (SELECT *, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE lat1 IS NOT NULL)"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = event_points(spark, sf_dir).select(F.col("point_id").alias("event_id"), "lat", "lon")
    owned = at.join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return owned.withColumns({"lat1": F.lag("lat").over(w), "lon1": F.lag("lon").over(w)}).where("lat1 is not null")


def _ends():
    return (F.col(c) for c in ("lat1", "lon1", "lat", "lon"))


@query(f"WITH {LEGS} SELECT event_id, round({sql_km('lat1', 'lon1', 'lat', 'lon')}, 6) AS km FROM legs")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs(spark, sf_dir).select("event_id", F.round(haversine_km(*_ends()), 6).alias("km"))


@query(f"WITH {LEGS} SELECT event_id, round({sql_course('lat1', 'lon1', 'lat', 'lon')}, 6) AS course FROM legs")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs(spark, sf_dir).select("event_id", F.round(bearing_degrees(*_ends()), 6).alias("course"))


@query(f"""WITH {LEGS}, c AS (SELECT event_id, user_id, {sql_course("lat1", "lon1", "lat", "lon")} AS course FROM legs),
d AS (SELECT event_id, abs(course - lag(course) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM c)
SELECT event_id, round(coalesce(least(d, 360 - d), 0), 6) AS turn FROM d""")
def heading_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    course = legs(spark, sf_dir).withColumn("course", bearing_degrees(*_ends()))
    return course.select("event_id", F.round(turn_between(F.lag("course").over(w), F.col("course")), 6).alias("turn"))


@query(f"""WITH {LEGS} SELECT event_id, i::INT AS i, round(lat1 + (lat - lat1) * i / 2.0::DOUBLE, 6) AS lat, round(lon1 + (lon - lon1) * i / 2.0::DOUBLE, 6) AS lon FROM legs, (VALUES (0), (1), (2)) AS t(i)""")
def edge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = legs(spark, sf_dir).select("event_id", F.explode(points_between(*_ends())).alias("p"))
    return out.select("event_id", "p.i", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


def _edges_sql(where: str) -> str:
    return f"""WITH {CUBE}, n AS (SELECT "row", col, min(lat) AS lat, min(lon) AS lon FROM cube GROUP BY 1, 2),
e AS (SELECT a."row" AS r, a.col AS c, (b."row" - a."row")::INT AS dr, (b.col - a.col)::INT AS dc, b."row" AS r2, b.col AS c2, a.lat AS lat, a.lon AS lon, b.lat AS lat2, b.lon AS lon2
FROM n a JOIN n b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND {where})
SELECT r, c, dr, dc, r2, c2, round({sql_km("lat", "lon", "lat2", "lon2")}, 6) AS km, round({sql_course("lat", "lon", "lat2", "lon2")}, 6) AS heading FROM e"""


def _edges(spark: SparkSession, sf_dir: str, connectivity: int) -> DataFrame:
    out = grid.edges(grid.nodes(table_cube(spark, sf_dir)), connectivity)
    return out.select("r", "c", "dr", "dc", "r2", "c2", F.round("km", 6).alias("km"), F.round("heading", 6).alias("heading"))


@query(_edges_sql("""abs(a."row" - b."row") + abs(a.col - b.col) > 0"""))
def edges8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, 8)


@query(_edges_sql("""abs(a."row" - b."row") + abs(a.col - b.col) = 1"""))
def edges4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, 4)


@query("""WITH p AS (SELECT event_id AS point_id, event_id * 7 % 46 AS yq, event_id * 11 % 38 AS xq FROM events)
SELECT point_id, least(11, (yq + 1) // 4)::INT AS "row", least(9, (xq + 1) // 4)::INT AS col FROM p""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = table_cube(spark, sf_dir)
    return grid.nearest_node(event_points(spark, sf_dir), axis_of(cube, "row", "lat"), axis_of(cube, "col", "lon"))


def open_cells(spark: SparkSession, sf_dir: str, frame: int = 0) -> DataFrame:
    return table_cube(spark, sf_dir).where(F.col("frame") == frame).select("row", "col", "lat", "lon", (~F.col("hard")).alias("open"))


#: An end point for every nation, some beside the grid.
PORTS = """ports AS (SELECT n_nationkey AS point_id, 70.0::DOUBLE + 0.013::DOUBLE * (n_nationkey * 5 % 49) AS plat, 18.0::DOUBLE + 0.017::DOUBLE * (n_nationkey * 7 % 61) AS plon FROM nation)"""


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("point_id"), (70.0 + 0.013 * F.pmod(k * 5, F.lit(49))).alias("lat"), (18.0 + 0.017 * F.pmod(k * 7, F.lit(61))).alias("lon"))


def _snap_sql(where: str) -> str:
    return f"""WITH {CUBE}, {PORTS}, m AS (SELECT point_id, NOT hard AS open, "row", col, round({sql_km("plat", "plon", "lat", "lon")}, 6) AS km FROM cube JOIN ports ON frame = 0 AND {where}),
g AS (SELECT point_id, count(*) AS n_cells, count_if(open)::BIGINT AS n_open FROM m GROUP BY 1),
b AS (SELECT * FROM m WHERE open AND km <= 5 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY km, "row", col) = 1)
SELECT point_id, CASE WHEN coalesce(n_cells, 0) = 0 THEN 'no grid node' WHEN n_open = 0 THEN 'no navigable node' WHEN km IS NULL THEN 'no reachable node' ELSE 'ok' END AS status,
"row", col, km, coalesce(n_cells, 0) AS n_cells, coalesce(n_open, 0) AS n_open FROM ports LEFT JOIN g USING (point_id) LEFT JOIN b USING (point_id)"""


@query(_snap_sql("true"))
def snap_navigable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.snap(ports(spark, sf_dir), open_cells(spark, sf_dir), 5.0)


@query(_snap_sql("abs(lat - plat) <= 0.031::DOUBLE AND abs(lon - plon) <= 0.043::DOUBLE"))
def snap_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest open cell inside a region around each end point."""
    boxed = ports(spark, sf_dir).withColumns({"south": F.col("lat") - 0.031, "north": F.col("lat") + 0.031})
    box = (F.abs(F.col("cell_lat") - F.col("lat")) <= 0.031) & (F.abs(F.col("cell_lon") - F.col("lon")) <= 0.043)
    return grid.snap(boxed, open_cells(spark, sf_dir), 5.0, box)


@query(f"""WITH RECURSIVE {CUBE}, o AS (SELECT "row", col FROM cube WHERE frame = 0 AND NOT hard), st AS (SELECT 'search-' || n_nationkey AS search, (n_nationkey * 5 % 12)::INT AS "row", (n_nationkey * 3 % 10)::INT AS col FROM nation),
w AS (SELECT search, "row", col FROM st JOIN o USING ("row", col) UNION SELECT w.search, o."row", o.col FROM w JOIN o ON abs(o."row" - w."row") + abs(o.col - w.col) = 1) SELECT * FROM w""")
def component(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    starts = table(spark, sf_dir, "nation").select(F.concat(F.lit("search-"), k.cast("string")).alias("search"), F.pmod(k * 5, F.lit(12)).cast("int").alias("row"), F.pmod(k * 3, F.lit(10)).cast("int").alias("col"))
    return grid.component(open_cells(spark, sf_dir).where("open"), starts, 4)


#: A voyage for every supplier between two boxes; some boxes hold no node, some only closed ones.
VOYAGES = """voyages AS (SELECT s_suppkey AS id, 70.0::DOUBLE + 0.011::DOUBLE * (s_suppkey * 5 % 57) AS slat, 18.0::DOUBLE + 0.013::DOUBLE * (s_suppkey * 7 % 80) AS slon,
    70.0::DOUBLE + 0.011::DOUBLE * (s_suppkey * 11 % 57) AS glat, 18.0::DOUBLE + 0.013::DOUBLE * (s_suppkey * 3 % 80) AS glon FROM supplier)"""
#: Half height and width of the boxes in degrees, and the farthest a point may be moved.
BOX, MAX_KM = (0.041, 0.057), 4.0


def voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    out = table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("search"),
        *((70.0 + 0.011 * F.pmod(k * m, F.lit(57))).alias(f"{role}_lat") for role, m in (("start", 5), ("goal", 11))),
        *((18.0 + 0.013 * F.pmod(k * m, F.lit(80))).alias(f"{role}_lon") for role, m in (("start", 7), ("goal", 3))),
    )
    sides = {f"{role}_{side}": F.col(f"{role}_{axis}") + sign * BOX[axis == "lon"] for role in ("start", "goal") for side, axis, sign in (("south", "lat", -1), ("north", "lat", 1), ("west", "lon", -1), ("east", "lon", 1))}
    return out.withColumns(sides)


def _end_sql(role: str, p: str, source: str, also: str = "") -> str:
    """Cells in a voyage's box at one end: counts, and the nearest open one that may be taken."""
    return f"""{role}_m AS (SELECT id, NOT hard AS open, cube."row", cube.col, round({sql_km(f"{p}lat", f"{p}lon", "lat", "lon")}, 6) AS km FROM cube JOIN {source} ON frame = 0 AND lat >= {p}lat - {BOX[0]}::DOUBLE AND lat <= {p}lat + {BOX[0]}::DOUBLE AND lon >= {p}lon - {BOX[1]}::DOUBLE AND lon <= {p}lon + {BOX[1]}::DOUBLE),
{role}_b AS (SELECT id, "row", col, km FROM {role}_m WHERE open AND km <= {MAX_KM} {also} QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, "row", col) = 1),
{role}_s AS (SELECT v.id, CASE WHEN count(m.id) = 0 THEN 'allowed_region_has_no_grid_node' WHEN count(*) FILTER (m.open) = 0 THEN 'allowed_region_has_no_navigable_grid_node' WHEN any_value(b.id) IS NULL THEN 'allowed_region_has_no_reachable_grid_node' END AS code,
    any_value(b."row") AS "row", any_value(b.col) AS col, any_value(b.km) AS km FROM {source} v LEFT JOIN {role}_m m ON m.id = v.id LEFT JOIN {role}_b b ON b.id = v.id GROUP BY 1)"""


@query(f"""WITH RECURSIVE {CUBE}, {VOYAGES}, {_end_sql("s", "s", "voyages")},
o AS (SELECT "row", col FROM cube WHERE frame = 0 AND NOT hard),
w AS (SELECT id, "row", col FROM s_s WHERE code IS NULL UNION SELECT w.id, o."row", o.col FROM w JOIN o ON abs(o."row" - w."row") <= 1 AND abs(o.col - w.col) <= 1),
begun AS (SELECT * FROM voyages WHERE id IN (SELECT id FROM s_s WHERE code IS NULL)), {_end_sql("g", "g", "begun", 'AND (id, "row", col) IN (SELECT (id, "row", col) FROM w)')},
n AS (SELECT id, count(*) AS n FROM w GROUP BY 1)
SELECT s.id::VARCHAR AS search, CASE WHEN s.code IS NOT NULL THEN 'start: ' || s.code WHEN g.code IS NOT NULL THEN 'goal: ' || g.code WHEN s."row" = g."row" AND s.col = g.col THEN 'start and goal are one node' ELSE 'ok' END AS status,
    s."row" AS start_row, s.col AS start_col, s.km AS start_km, g."row" AS goal_row, g.col AS goal_col, g.km AS goal_km, coalesce(n, 0) AS component_size FROM s_s s LEFT JOIN g_s g ON g.id = s.id LEFT JOIN n ON n.id = s.id""")
def endpoint_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.map_endpoints(open_cells(spark, sf_dir), voyages(spark, sf_dir), MAX_KM)


def _audit_sql(role: str, p: str) -> str:
    return f"""round({p}lon, 6) AS {role}_lon, round({p}lat, 6) AS {role}_lat, round(18.0::DOUBLE + 0.1::DOUBLE * {role}_col, 6) AS {role}_node_lon, round(70.0::DOUBLE + 0.05::DOUBLE * {role}_row, 6) AS {role}_node_lat,
    {role}_row AS {role}_node_row, {role}_col AS {role}_node_col, round({role}_km, 6) AS {role}_km, {role}_km > 1e-9 AS {role}_snapped"""


@query(f"""WITH {VOYAGES} SELECT search, {_audit_sql("start", "s")}, {_audit_sql("goal", "g")}, component_size::BIGINT AS component_size FROM ({ORACLE_SQL["endpoint_map"]}) m JOIN voyages v ON v.id::VARCHAR = m.search WHERE status = 'ok'""")
def endpoint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every mapped voyage asked for and got, read back from its audit document."""
    cells, asked = open_cells(spark, sf_dir), voyages(spark, sf_dir)
    made = endpoints.audit(endpoints.map_endpoints(cells, asked, MAX_KM), asked, cells, MAX_KM)
    end = "struct<requested:struct<longitude:double,latitude:double>,resolved:struct<longitude:double,latitude:double>,node:struct<row:int,column:int>,adjustment_km:double,max_adjustment_km:double,snapped:boolean>"
    d = made.select("search", F.from_json("document", f"start {end}, goal {end}, connected_component_size bigint", {"mode": "FAILFAST"}).alias("d"))
    shown = {"lon": "requested.longitude", "lat": "requested.latitude", "node_lon": "resolved.longitude", "node_lat": "resolved.latitude", "km": "adjustment_km"}
    out = [F.round(f"d.{role}.{path}", 6).alias(f"{role}_{name}") for role in ("start", "goal") for name, path in shown.items()]
    out += [F.col(f"d.{role}.{path}").alias(f"{role}_{name}") for role in ("start", "goal") for name, path in (("node_row", "node.row"), ("node_col", "node.column"), ("snapped", "snapped"))]
    return d.select("search", *out, F.col("d.connected_component_size").alias("component_size"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, (l_partkey % 111) / 100.0::DOUBLE AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN f <= 0 OR f > 1 THEN 'invalid' WHEN f < 0.2::DOUBLE THEN 'factor' WHEN f * 10 < 3 THEN 'steerage' ELSE 'ok' END AS status,
CASE WHEN f >= 0.2::DOUBLE AND f <= 1 AND f * 10 >= 3 THEN round(least(15.7, f * 10), 6) END AS knots FROM f""")
def vessel_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.pmod("l_partkey", F.lit(111)) / 100.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", speed_status(f, Vessel()).alias("status"), F.round(knots(f, Vessel()), 6).alias("knots"))


_W = OBJECTIVES["recommended"]
_VMAX = Vessel().maximum_kmh


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS d, l_quantity::DOUBLE / 10 AS h, (l_partkey % 101) / 100.0::DOUBLE AS r, (l_suppkey % 101) / 100.0::DOUBLE AS c, ((l_partkey * 7) % 181)::DOUBLE AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round(h * r, 6) AS risk_hours, round(d / {_VMAX}::DOUBLE, 6) AS distance_hours, round(t / 180 * 0.25::DOUBLE, 6) AS turn_hours, round(h * (1 - c), 6) AS uncertain_hours,
round({_W.time}::DOUBLE * h + {_W.risk}::DOUBLE * (h * r) + {_W.distance}::DOUBLE * (d / {_VMAX}::DOUBLE) + {_W.turn}::DOUBLE * (t / 180 * 0.25::DOUBLE) + {_W.uncertainty}::DOUBLE * (h * (1 - c)), 6) AS total_hours,
round({_W.time + _W.distance}::DOUBLE * (d / {_VMAX}::DOUBLE), 6) AS lower_bound FROM x""")
def edge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_quantity").cast("double")
    parts = cost_parts(d, d / 10, F.pmod("l_partkey", F.lit(101)) / 100.0, F.pmod("l_suppkey", F.lit(101)) / 100.0, F.pmod(F.col("l_partkey") * 7, F.lit(181)).cast("double"), _W, _VMAX)
    shown = [F.round(parts[k], 6).alias(k) for k in ("risk_hours", "distance_hours", "turn_hours", "uncertain_hours", "total_hours")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *shown, F.round(least_cost(d, _W, _VMAX), 6).alias("lower_bound"))


HOUR = 3_600_000_000
#: Frames of the table cube, and departures of the crossings: a half hour before every frame but the first, and every frame.
LAST = T0 + (FRAMES - 1) * HOUR
DEPARTURES = tuple(T0 + k * HOUR // 2 for k in range(2 * FRAMES - 1))


def _pass_sql(k: int) -> str:
    """One refinement of the crossing times: samples of the three points, then the edge's reason, speed and hours."""
    return f"""t{k} AS (SELECT d.r, d.c, d.dr, d.dc, d.km, d.depart_us, d.x, i, d.depart_us + round_even(h * (i / 2.0::DOUBLE) * {HOUR}, 0)::BIGINT AS t FROM d{k} d, (VALUES (0), (1), (2)) AS p(i)),
v{k} AS (SELECT t.*, CASE WHEN t < {T0} OR t > {LAST} THEN 'coverage' WHEN a.risk IS NULL OR ((t - {T0}) % {HOUR} <> 0 AND b.risk IS NULL) THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN (t - {T0}) % {HOUR} = 0 THEN a.risk ELSE a.risk + ((t - {T0}) % {HOUR})::DOUBLE / {HOUR} * (b.risk - a.risk) END AS risk,
    CASE WHEN (t - {T0}) % {HOUR} = 0 THEN a.hard ELSE a.hard OR b.hard END AS hard,
    CASE WHEN (t - {T0}) % {HOUR} = 0 THEN a.confidence ELSE least(a.confidence, b.confidence) END AS confidence,
    CASE WHEN (t - {T0}) % {HOUR} = 0 THEN a.factor ELSE least(a.factor, b.factor) END AS factor
    FROM t{k} t LEFT JOIN ser a ON a.r = t.r AND a.c = t.c AND a.dr = t.dr AND a.dc = t.dc AND a.i = t.i AND a.frame = (t.t - {T0}) // {HOUR}
    LEFT JOIN ser b ON b.r = t.r AND b.c = t.c AND b.dr = t.dr AND b.dc = t.dc AND b.i = t.i AND b.frame = (t.t - {T0}) // {HOUR} + 1),
g{k} AS (SELECT r, c, dr, dc, km, depart_us, any_value(x) AS x0, arg_min(status, i) FILTER (status <> 'ok') AS failed, bool_or(hard) AS hard, min(confidence) AS confidence, min(factor) AS factor,
    max(risk) AS max_risk, (sum(CASE WHEN i = 1 THEN risk ELSE risk / 2 END)) / 2 AS risk, count(*) FILTER (status = 'ok') AS n_ok FROM v{k} GROUP BY 1, 2, 3, 4, 5, 6),
d{k + 1} AS (SELECT r, c, dr, dc, km, depart_us, risk, max_risk, confidence, least(15.7::DOUBLE, 10 * factor) AS knots, km / (least(15.7::DOUBLE, 10 * factor) * 1.852::DOUBLE) AS h,
    coalesce(x0, failed, CASE WHEN hard THEN 'hard' WHEN confidence < 0.1::DOUBLE THEN 'risk' WHEN factor <= 0 OR factor > 1 OR factor < 0.2::DOUBLE OR 10 * factor < 3 THEN 'speed' END) AS x FROM g{k})"""


#: Values of the three points of every edge in every frame.
SERIES = f"""parts AS (SELECT e.*, i, a, b, CASE WHEN dr = 0 THEN 1.0::DOUBLE WHEN a = 1 THEN i / 2.0::DOUBLE ELSE 1 - i / 2.0::DOUBLE END * CASE WHEN dc = 0 THEN 1.0::DOUBLE WHEN b = 1 THEN i / 2.0::DOUBLE ELSE 1 - i / 2.0::DOUBLE END AS w
    FROM e, (VALUES (0), (1), (2)) AS p(i), (VALUES (0), (1)) AS q(a), (VALUES (0), (1)) AS u(b) WHERE (dr <> 0 OR a = 0) AND (dc <> 0 OR b = 0)),
ser AS (SELECT r, c, dr, dc, i, f AS frame, CASE WHEN count(*) = count(risk) THEN round(sum(w * risk), 9) WHEN bool_or(hard) THEN 1.0::DOUBLE END AS risk, coalesce(bool_or(hard), false) AS hard, min(confidence) AS confidence, min(coalesce(factor, 1.0::DOUBLE)) AS factor
    FROM (SELECT * FROM parts, range({FRAMES}) AS fr(f) WHERE w > 0) p LEFT JOIN cube ON frame = f AND "row" = r + dr * a AND col = c + dc * b GROUP BY 1, 2, 3, 4, 5, 6)"""

_CROSSED_SQL = f"""WITH {CUBE}, {EDGES}, {SERIES},
d1 AS (SELECT r, c, dr, dc, km, unnest({list(DEPARTURES)}) AS depart_us, km / {Vessel().calm_kmh}::DOUBLE AS h, NULL::VARCHAR AS x FROM e),
{_pass_sql(1)}, {_pass_sql(2)},
out AS (SELECT *, {_W.time}::DOUBLE * h + {_W.risk}::DOUBLE * (h * risk) + {_W.distance}::DOUBLE * (km / {_VMAX}::DOUBLE) + {_W.uncertainty}::DOUBLE * (h * (1 - confidence)) AS total FROM d3)"""


def crossed(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """Every edge of the table cube crossed at every whole and half hour."""
    cube = cube if cube is not None else table_cube(spark, sf_dir)
    times = axis_of(cube, "frame", "valid_us")
    series = edge_series(cube, grid.edges(grid.nodes(cube)), len(times))
    leaving = series.withColumn("depart_us", F.explode(F.array(*(F.lit(t).cast("long") for t in DEPARTURES)))).withColumn("heading_before", F.lit(None).cast("double"))
    return cross(leaving, times, Vessel(), vars(_W))


_SHOWN = {"hours": "h", "knots": "knots", "risk": "risk", "max_risk": "max_risk", "confidence": "confidence", "total_hours": "total"}


@query(f"{_CROSSED_SQL} SELECT r, c, dr, dc, depart_us, x AS reject, {', '.join(f'CASE WHEN x IS NULL THEN round({v}, 6) END AS {k}' for k, v in _SHOWN.items())} FROM out")
def edge_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge crossed at every whole and half hour; a test holds it against the search's own arithmetic too."""
    return crossed(spark, sf_dir).select("r", "c", "dr", "dc", "depart_us", "reject", *(F.when(F.col("reject").isNull(), F.round(x, 6)).alias(x) for x in _SHOWN))


@query(f"{_CROSSED_SQL} SELECT depart_us, coalesce(x, 'none') AS reject, count(*) AS n FROM out GROUP BY 1, 2")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(crossed(spark, sf_dir), ["depart_us"])


#: Farthest that samples may lie apart, in km: edges of the table grid get 5, 7 and 8 or 9 points for it.
SPACING_KM = 0.95


@query(f"""WITH {CUBE}, {EDGES}, sp AS (SELECT e.*, greatest(3, ceil(km / {SPACING_KM}::DOUBLE)::INT + 1) AS n FROM e), pt AS (SELECT *, unnest(range(n))::INT AS i FROM sp),
pw AS (SELECT pt.*, a, b, CASE WHEN dr = 0 THEN 1.0::DOUBLE - a WHEN a = 1 THEN i / (n - 1)::DOUBLE ELSE 1 - i / (n - 1)::DOUBLE END * CASE WHEN dc = 0 THEN 1.0::DOUBLE - b WHEN b = 1 THEN i / (n - 1)::DOUBLE ELSE 1 - i / (n - 1)::DOUBLE END AS w FROM pt, (VALUES (0), (1)) AS q(a), (VALUES (0), (1)) AS u(b)),
v AS (SELECT r, c, dr, dc, n, i, f AS frame, CASE WHEN count(*) = count(risk) THEN round(sum(w * risk), 9) WHEN bool_or(hard) THEN 1.0::DOUBLE END AS risk, coalesce(bool_or(hard), false) AS hard, min(confidence) AS confidence
    FROM (SELECT * FROM pw, range({FRAMES}) AS fr(f) WHERE w > 0) p LEFT JOIN cube ON frame = f AND "row" = r + dr * a AND col = c + dc * b GROUP BY 1, 2, 3, 4, 5, 6, 7)
SELECT r, c, dr, dc, frame::INT AS frame, n AS points, CASE WHEN count(risk) = n THEN round(sum(CASE WHEN i = 0 OR i = n - 1 THEN risk / 2 ELSE risk END) / (n - 1), 9) END AS mean_risk, round(max(risk), 6) AS max_risk, bool_or(hard) AS hard, round(min(confidence), 6) AS confidence FROM v GROUP BY r, c, dr, dc, n, frame""")
def edge_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge in every frame, sampled as often as its length asks for: the trapezoid mean of its risk, and its extremes."""
    cube = table_cube(spark, sf_dir)
    series = edge_series(cube, grid.edges(grid.nodes(cube)), FRAMES, max_spacing_km=SPACING_KM)
    at = series.select("r", "c", "dr", "dc", F.size("points").alias("points"), F.posexplode(F.expr(f"transform(sequence(0, {FRAMES - 1}), k -> transform(points, p -> named_struct('risk', p.risk[k], 'hard', p.hard[k], 'confidence', p.confidence[k])))")).alias("frame", "s"))
    known = ~F.exists("s", lambda p: p["risk"].isNull())
    mean = F.expr("(aggregate(s.risk, 0D, (a, x) -> a + x) - 0.5D * s[0].risk - 0.5D * element_at(s, -1).risk) / (size(s) - 1)")
    return at.select("r", "c", "dr", "dc", "frame", "points", F.when(known, F.round(mean, 9)).alias("mean_risk"), F.round(F.array_max("s.risk"), 6).alias("max_risk"), F.array_contains("s.hard", True).alias("hard"), F.round(F.array_min("s.confidence"), 6).alias("confidence"))
