"""Queries on routes, their totals and layered plan sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.functions.motion import KNOT_MS, OBJECTIVES, Vessel, Weights
from riskgrid.operators import documents, grid, layers, routes, search
from riskgrid.operators.shared import folder, written
from riskgrid.plans.grids import SERIES, sql_km
from riskgrid.plans.registry import CUBE, EDGES, T0, query
from riskgrid.sources.cube import COLS, LAT0, LAT_STEP, LON0, LON_STEP, ROWS, analytic_cube, table, table_cube

HOUR = 3_600_000_000
#: Horizon of the layered sets; the last voyage starts an hour and a half after the first frame.
SET_HOURS = 96


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voyage across the grid for every supplier, under all three objectives."""
    k = F.col("s_suppkey")
    one = table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("id"),
        F.pmod(k * 5, F.lit(12)).cast("int").alias("r0"),
        F.pmod(k, F.lit(3)).cast("int").alias("c0"),
        F.pmod(k * 7, F.lit(12)).cast("int").alias("r1"),
        (F.pmod(k, F.lit(2)) + 5).cast("int").alias("c1"),
        (F.lit(T0) + F.pmod(k, F.lit(4)) * F.lit(HOUR // 2)).alias("depart_us"),
        F.lit(6 * HOUR).cast("long").alias("horizon_us"),
        F.lit(HOUR).cast("long").alias("bucket_us"),
    )
    each = one.withColumn("objective", F.explode(F.array(*(F.lit(o) for o in OBJECTIVES))))
    return each.withColumn("search", F.concat_ws("/", "id", "objective")).drop("id")


#: Policy of the searches over a cube that stands still: no turns, so a recursive query over nodes can find them.
STILL = Weights(0.85, 1.3, 0.08, 0.0, 0.45)
#: Frames three hours apart, enough for any voyage of this grid; a search that finds none goes round until they end.
STILL_FRAMES = 9


def still_cube(spark: SparkSession, sf_dir: str, frames: int) -> DataFrame:
    """The first frame of the table cube, repeated every three hours."""
    cube = table_cube(spark, sf_dir).where("frame = 0").drop("frame", "valid_us").withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return cube.withColumn("valid_us", F.lit(T0) + F.col("frame") * F.lit(3 * HOUR))


def still_requests(spark: SparkSession, sf_dir: str, bucket_us: int) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("search-"), k.cast("string")).alias("search"),
        F.lit("still").alias("objective"),
        *(F.pmod(k * m, F.lit(n)).cast("int").alias(c) for c, m, n in (("r0", 5, 12), ("c0", 1, 10), ("r1", 7, 12), ("c1", 3, 10))),
        F.lit(T0).cast("long").alias("depart_us"),
        F.lit(None).cast("long").alias("horizon_us"),
        F.lit(bucket_us).cast("long").alias("bucket_us"),
    )


@query(f"""WITH RECURSIVE {CUBE}, {EDGES}, {SERIES},
still AS (SELECT r, c, dr, dc, bool_or(hard) AS hard, min(confidence) AS confidence, min(factor) AS factor, sum(CASE WHEN i = 1 THEN risk ELSE risk / 2 END) / 2 AS risk FROM ser WHERE frame = 0 GROUP BY 1, 2, 3, 4),
open AS (SELECT r, c, r2, c2, km / (least(15.7::DOUBLE, 10 * factor) * 1.852::DOUBLE) AS h, risk, confidence, km FROM still JOIN e USING (r, c, dr, dc) WHERE NOT hard AND confidence >= 0.1::DOUBLE AND factor >= 0.3::DOUBLE),
cost AS (SELECT r, c, r2, c2, {STILL.time}::DOUBLE * h + {STILL.risk}::DOUBLE * (h * risk) + {STILL.distance}::DOUBLE * (km / {Vessel().maximum_kmh}::DOUBLE) + {STILL.uncertainty}::DOUBLE * (h * (1 - confidence)) AS cost FROM open),
q AS (SELECT n_nationkey AS id, (n_nationkey * 5 % 12)::INT AS r0, (n_nationkey % 10)::INT AS c0, (n_nationkey * 7 % 12)::INT AS r1, (n_nationkey * 3 % 10)::INT AS c1 FROM nation),
s AS (SELECT q.*, hard FROM q JOIN cube ON frame = 0 AND "row" = r0 AND col = c0),
w AS (SELECT 0 AS step, id, r0 AS r, c0 AS c, 0.0::DOUBLE AS cost FROM s WHERE NOT hard
    UNION ALL SELECT step + 1, id, r, c, min(cost) FROM (SELECT step, id, r, c, cost FROM w UNION ALL SELECT step, id, r2, c2, w.cost + x.cost FROM w JOIN cost x USING (r, c)) WHERE step < 60 GROUP BY 1, 2, 3, 4)
SELECT 'search-' || s.id AS search, CASE WHEN s.hard THEN 'start blocked' WHEN w.cost IS NOT NULL THEN 'ok' WHEN EXISTS (SELECT 1 FROM cost x WHERE x.r = r0 AND x.c = c0) THEN 'no coverage' ELSE 'no route' END AS status, round(w.cost, 6) AS cost FROM s LEFT JOIN (SELECT * FROM w WHERE step = 60) w ON w.id = s.id AND w.r = r1 AND w.c = c1""".replace("s AS (SELECT (l_linenumber", "sums AS (SELECT (l_linenumber").replace("FROM s),", "FROM sums),").replace("AS factor FROM s)", "AS factor FROM sums)"))
def route_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voyage for every nation over the first frame of the table cube, standing still: status and cost."""
    cube, wanted = still_cube(spark, sf_dir, STILL_FRAMES), still_requests(spark, sf_dir, HOUR)
    steps = search.routes(cube, wanted, objectives={"still": STILL})
    out = steps.groupBy("search").agg(F.first("status").alias("status"), F.max("cost").alias("cost"))
    return out.select("search", "status", F.round("cost", 6).alias("cost"))


#: Frames of a cube that stands still for longer than any route that visits no state twice.
COUNTED_FRAMES = 60


@query(f"""WITH RECURSIVE {CUBE}, {EDGES}, {SERIES},
still AS (SELECT r, c, dr, dc, bool_or(hard) AS hard, min(confidence) AS confidence, min(factor) AS factor, sum(CASE WHEN i = 1 THEN risk ELSE risk / 2 END) / 2 AS risk FROM ser WHERE frame = 0 GROUP BY 1, 2, 3, 4),
every AS (SELECT r, c, r2, c2, km, risk, confidence, CASE WHEN hard THEN 'hard' WHEN confidence < 0.1::DOUBLE THEN 'risk' WHEN factor < 0.3::DOUBLE THEN 'speed' END AS why, km / (least(15.7::DOUBLE, 10 * factor) * 1.852::DOUBLE) AS h FROM still JOIN e USING (r, c, dr, dc)),
cost AS (SELECT r, c, r2, c2, {STILL.time}::DOUBLE * h + {STILL.risk}::DOUBLE * (h * risk) + {STILL.distance}::DOUBLE * (km / {Vessel().maximum_kmh}::DOUBLE) + {STILL.uncertainty}::DOUBLE * (h * (1 - confidence)) AS cost FROM every WHERE why IS NULL),
q AS (SELECT n_nationkey AS id, (n_nationkey * 5 % 12)::INT AS r0, (n_nationkey % 10)::INT AS c0, (n_nationkey * 7 % 12)::INT AS r1, (n_nationkey * 3 % 10)::INT AS c1 FROM nation),
s AS (SELECT q.*, hard FROM q JOIN cube ON frame = 0 AND "row" = r0 AND col = c0),
w AS (SELECT 0 AS step, id, r0 AS r, c0 AS c, 0.0::DOUBLE AS cost FROM s WHERE NOT hard
    UNION ALL SELECT step + 1, id, r, c, min(cost) FROM (SELECT step, id, r, c, cost FROM w UNION ALL SELECT step, id, r2, c2, w.cost + x.cost FROM w JOIN cost x USING (r, c)) WHERE step < 60 GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM w WHERE step = 60), g AS (SELECT s.id, r1, c1, n.lat AS glat, n.lon AS glon, b.cost AS goal_cost FROM s JOIN n ON n."row" = r1 AND n.col = c1 LEFT JOIN best b ON b.id = s.id AND b.r = r1 AND b.c = c1),
l AS (SELECT id, r0 AS r, c0 AS c, 0.0::DOUBLE AS cost FROM s WHERE NOT hard UNION ALL SELECT id, r2, c2, b.cost + x.cost FROM best b JOIN cost x USING (r, c)),
m AS (SELECT l.id, l.r, l.c FROM l JOIN g ON g.id = l.id JOIN n ON n."row" = l.r AND n.col = l.c WHERE NOT (l.r = r1 AND l.c = c1) AND (goal_cost IS NULL
    OR l.cost + {(STILL.time + STILL.distance) / Vessel().maximum_kmh}::DOUBLE * {sql_km('n.lat', 'n.lon', 'glat', 'glon')} * 0.999999999::DOUBLE < goal_cost)),
k AS (SELECT m.id, m.r, m.c, count(*) AS labels FROM m GROUP BY 1, 2, 3),
t AS (SELECT id, sum(labels)::BIGINT AS crossings, sum(labels) FILTER (why IS NULL)::BIGINT AS accepted, sum(labels) FILTER (why = 'hard')::BIGINT AS hard, sum(labels) FILTER (why = 'risk')::BIGINT AS risk, sum(labels) FILTER (why = 'speed')::BIGINT AS speed FROM k JOIN every x ON x.r = k.r AND x.c = k.c GROUP BY 1),
x AS (SELECT id, sum(labels)::BIGINT AS expanded FROM k GROUP BY 1)
SELECT 'search-' || s.id AS search, CASE WHEN s.hard THEN 'start blocked' WHEN goal_cost IS NOT NULL THEN 'ok' ELSE 'no route' END AS status, coalesce(expanded, 0) AS expanded, coalesce(crossings, 0) AS crossings, coalesce(accepted, 0) AS accepted,
    coalesce(t.hard, 0) AS refused_hard, coalesce(t.risk, 0) AS refused_risk, coalesce(t.speed, 0) AS refused_speed, 0::BIGINT AS refused_coverage, 0::BIGINT AS refused_error FROM s JOIN g ON g.id = s.id LEFT JOIN t ON t.id = s.id LEFT JOIN x ON x.id = s.id""".replace("s AS (SELECT (l_linenumber", "sums AS (SELECT (l_linenumber").replace("FROM s),", "FROM sums),").replace("AS factor FROM s)", "AS factor FROM sums)"))
def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effort of a voyage for every nation over a cube that stands still, in one time bucket, so that a recursive query over nodes can count it."""
    found = search.run(still_cube(spark, sf_dir, COUNTED_FRAMES), still_requests(spark, sf_dir, 10_000 * HOUR), objectives={"still": STILL})
    return search.counters(found).select("search", "status", "expanded", "crossings", "accepted", *(f"refused_{x}" for x in search.REFUSED))


@query()
def route_3obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, cost, distance and hours of every search."""
    steps = search.routes(table_cube(spark, sf_dir), requests(spark, sf_dir))
    out = steps.groupBy("search").agg(F.first("status").alias("status"), F.max("cost").alias("cost"), F.sum("km").alias("km"), F.sum("hours").alias("hours"))
    return out.select("search", "status", *(F.round(c, 6).alias(c) for c in ("cost", "km", "hours")))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # both the search and what places its steps read the cube: counted from the table once
    cube = written(table_cube(spark, sf_dir), folder(spark, "routes") + "/cube")
    steps = written(search.routes(cube, requests(spark, sf_dir)).where("status = 'ok'"), folder(spark, "routes") + "/steps")
    return steps, cube


@query()
def route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every found route, with its turns."""
    steps, _ = _found(spark, sf_dir)
    out = routes.totals(steps).join(routes.turns(steps), "search", "left")
    return out.select("search", "edges", F.coalesce("turns", F.lit(0)).alias("turns"), *(F.round(c, 6).alias(c) for c in ("km", "hours", "average_risk", "max_risk", "confidence", "cost")))


@query()
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that each route used, in the order of first use."""
    steps, _ = _found(spark, sf_dir)
    named = steps.withColumn("sources", F.transform(F.sequence("frame_low", "frame_high"), lambda k: F.concat(F.lit("frame-"), k.cast("string"))))
    return routes.source_ids(named).select("search", F.array_join("source_ids", ",").alias("source_ids"))


@query()
def route_steps_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, cube = _found(spark, sf_dir)
    return routes.geojson(routes.plans(steps, grid.nodes(cube)))


@query()
def layer_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the found routes at the cut-offs of the layers."""
    steps, _ = _found(spark, sf_dir)
    return layers.anchors(steps, spark.createDataFrame([x for x in layers.LAYERS if x[1]], "layer string, hours_limit int"))


@query()
def layer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, _ = _found(spark, sf_dir)
    return layers.layer_windows(routes.totals(steps), 96.0).withColumn("ceiling_h", F.round("ceiling_h", 6))


@query()
def four_layer_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers of every voyage of ``requests`` over an analytic cube whose hourly frames span the horizon."""
    wanted = requests(spark, sf_dir).where("objective = 'recommended'").withColumn("search", F.substring_index("search", "/", 1)).drop("objective", "horizon_us")
    out = layers.layered_set(analytic_cube(spark, frames=SET_HOURS + 3), wanted, float(SET_HOURS))
    return out.select("set_id", "layer", "objective", "step", "row", "col", "eta_us", F.round("cost", 6).alias("cost"))


#: A made-up route for every customer, a step for every order: quarters of hours, eighths of cost, whole hundredths.
TABLE_ROUTES = f"""k AS (SELECT o_custkey, o_orderkey AS k, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS step FROM orders),
steps AS (SELECT 'route-' || o_custkey AS search, step, k, (k % 12)::INT AS "row", (k * 7 % 10)::INT AS col, CASE WHEN step = 0 THEN 0 ELSE k % 50 END / 4.0::DOUBLE AS km, CASE WHEN step = 0 THEN 0 ELSE 1 + k % 37 END / 4.0::DOUBLE AS hours,
    {T0} + sum(CASE WHEN step = 0 THEN 0 ELSE 1 + k % 37 END) OVER w::BIGINT * 900000000 AS eta_us, CASE WHEN step > 0 THEN 5.0::DOUBLE + k % 10 END AS knots, CASE WHEN step > 0 THEN k % 4 * 90.0::DOUBLE END AS heading,
    (k % 101) / 100.0::DOUBLE AS risk, least(100, k % 101 + 10) / 100.0::DOUBLE AS max_risk, (50 + k % 50) / 100.0::DOUBLE AS confidence, sum(CASE WHEN step = 0 THEN 0 ELSE k % 7 END) OVER w / 8.0::DOUBLE AS cost,
    step // 2 AS frame_low, step // 2 + k % 2 AS frame_high FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY step))"""


def table_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, step = F.col("o_orderkey"), F.col("step")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    moved = lambda x: F.when(step == 0, 0).otherwise(x)
    out = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("step", F.row_number().over(w) - 1)
    out = out.withColumns({"q": F.sum(moved(1 + k % 37)).over(w), "e": F.sum(moved(k % 7)).over(w)})
    risk = (k % 101) / 100.0
    return out.select(
        F.concat(F.lit("route-"), F.col("o_custkey").cast("string")).alias("search"),
        "step",
        (k % 12).cast("int").alias("row"),
        (k * 7 % 10).cast("int").alias("col"),
        (F.lit(T0) + F.col("q") * F.lit(900_000_000)).alias("eta_us"),
        (moved(k % 50) / 4.0).alias("km"),
        (moved(1 + k % 37) / 4.0).alias("hours"),
        F.when(step > 0, 5.0 + k % 10).alias("knots"),
        F.when(step > 0, k % 4 * 90.0).alias("heading"),
        risk.alias("risk"),
        (F.least(F.lit(100), k % 101 + 10) / 100.0).alias("max_risk"),
        ((50 + k % 50) / 100.0).alias("confidence"),
        (F.col("e") / 8.0).alias("cost"),
        (moved(1 + k % 37) / 4.0 * risk).alias("risk_hours"),
        F.expr("step div 2").cast("int").alias("frame_low"),
        F.expr("step div 2 + o_orderkey % 2").cast("int").alias("frame_high"),
    )


_TOTALS = """t AS (SELECT search, max(step) AS edges, sum(km) AS km, sum(hours) AS hours, CASE WHEN sum(hours) > 0 THEN sum(hours * risk) / sum(hours) ELSE max(risk) END AS average_risk,
    coalesce(max(max_risk) FILTER (step > 0), max(max_risk)) AS max_risk, coalesce(min(confidence) FILTER (step > 0), min(confidence)) AS confidence, max(cost) AS cost FROM steps GROUP BY 1),
h AS (SELECT search, abs(heading - lag(heading) OVER (PARTITION BY search ORDER BY step)) > 1e-9 AS turned FROM steps WHERE heading IS NOT NULL),
u AS (SELECT search, count(*) FILTER (turned) AS turns FROM h GROUP BY 1)"""
_FIGURES = ("km", "hours", "average_risk", "max_risk", "confidence", "cost")


@query(f"WITH {TABLE_ROUTES}, {_TOTALS} SELECT search, edges, coalesce(turns, 0) AS turns, {', '.join(f'round({c}, 6) AS {c}' for c in _FIGURES)} FROM t LEFT JOIN u USING (search)")
def table_route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and turns of the made-up routes."""
    steps = table_routes(spark, sf_dir)
    out = routes.totals(steps).join(routes.turns(steps), "search", "left")
    return out.select("search", "edges", F.coalesce("turns", F.lit(0)).alias("turns"), *(F.round(c, 6).alias(c) for c in _FIGURES))


_SOURCES = "fr AS (SELECT search, f, min(step) AS seen FROM (SELECT search, step, unnest(generate_series(frame_low, frame_high)) AS f FROM steps) GROUP BY 1, 2)"


@query(f"WITH {TABLE_ROUTES}, {_SOURCES} SELECT search, string_agg('frame-' || f, ',' ORDER BY seen, f) AS source_ids FROM fr GROUP BY 1")
def table_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the made-up routes, in the order of first use."""
    named = table_routes(spark, sf_dir).withColumn("sources", F.transform(F.sequence("frame_low", "frame_high"), lambda k: F.concat(F.lit("frame-"), k.cast("string"))))
    return routes.source_ids(named).select("search", F.array_join("source_ids", ",").alias("source_ids"))


_CUTS = [x for x in layers.LAYERS if x[1]]


@query(f"""WITH {TABLE_ROUTES}, cuts AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {h})" for n, h in _CUTS)}) AS c(layer, hours_limit)),
s AS (SELECT search, "row" AS r, col AS c, eta_us AS t FROM steps WHERE step = 0), e AS (SELECT search, max(step) AS step FROM steps GROUP BY 1),
m AS (SELECT steps.*, layer, hours_limit, step > 0 AND ("row" <> r OR col <> c) AS ok, t + hours_limit::BIGINT * {HOUR} AS cut FROM steps JOIN s USING (search), cuts),
a AS (SELECT search, layer, hours_limit, max(step) FILTER (ok AND eta_us <= cut) AS hit, bool_or(ok) AS moves, max(cut) AS cut FROM m GROUP BY 1, 2, 3),
p AS (SELECT a.*, CASE WHEN moves AND z.eta_us <= cut THEN e.step ELSE hit END AS step FROM a JOIN e USING (search) JOIN steps z ON z.search = a.search AND z.step = e.step)
SELECT p.search, layer, hours_limit, x."row", x.col, x.eta_us, p.step IS NOT NULL AS materialisable FROM p LEFT JOIN steps x ON x.search = p.search AND x.step = p.step""")
def table_layer_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the made-up routes at the cut-offs of the layers."""
    return layers.anchors(table_routes(spark, sf_dir), spark.createDataFrame(_CUTS, "layer string, hours_limit int"))


@query(f"""WITH {TABLE_ROUTES}, {_TOTALS} SELECT search, rank::INT AS rank, layer, 0.0::DOUBLE AS from_h, round(CASE WHEN cut IS NULL THEN 96 ELSE least(96, cut, hours) END, 6)::DOUBLE AS ceiling_h
FROM t, (VALUES {', '.join(f"({i}, '{n}', {h if h else 'NULL'})" for i, (n, h) in enumerate(layers.LAYERS))}) AS l(rank, layer, cut)""")
def table_layer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus windows of the made-up routes under a horizon of 96 hours."""
    return layers.layer_windows(routes.totals(table_routes(spark, sf_dir)), 96.0).withColumn("ceiling_h", F.round("ceiling_h", 6))


_POINTS = f"""pts AS (SELECT search, step, 18.0::DOUBLE + 0.1::DOUBLE * col AS lon, 70.0::DOUBLE + 0.05::DOUBLE * "row" AS lat, eta_us, coalesce(knots, lead(knots) OVER (PARTITION BY search ORDER BY step)) * {KNOT_MS}::DOUBLE AS mps FROM steps)"""


def _nodes(spark: SparkSession) -> DataFrame:
    """The nodes of the table grid."""
    row, col = F.expr(f"cast(id div {COLS} as int)"), (F.col("id") % COLS).cast("int")
    return spark.range(ROWS * COLS).select(row.alias("row"), col.alias("col"), (LAT0 + LAT_STEP * row).alias("lat"), (LON0 + LON_STEP * col).alias("lon"))


@query(f"WITH {TABLE_ROUTES}, {_POINTS} SELECT search, step::INT AS step, round(lon, 6) AS lon, round(lat, 6) AS lat FROM pts")
def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints of the made-up routes, read back from their GeoJSON."""
    made = routes.geojson(routes.plans(table_routes(spark, sf_dir), _nodes(spark)))
    return routes.from_geojson(made).select("search", "step", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def plan_headers(steps: DataFrame, late_us: int = 0) -> DataFrame:
    """What a request tells of each route's plan; those that begin in the first row say they start so much later."""
    text = {"run_id": "run-00000000-0000-4000-8000-000000000000", "scenario_id": "scenario-1", "corridor_id": "corridor-1", "vessel_profile_id": "vessel-1", "config_digest": "c" * 64, "model_config_digest": "d" * 64, "planner_config_digest": "e" * 64, "provenance": "development", "planning_request_id": "request-1", "plan_version": "1:0", "objective_mode": "recommended", "plan_kind": "initial", "planner_version": "1"}
    head = steps.where("step = 0").select("search", (F.col("eta_us") + F.when(F.col("row") == 0, late_us).otherwise(0)).alias("start_time"), F.concat(F.lit("plan-"), F.col("search")).alias("plan_id"))
    head = head.withColumns({c: F.lit(v) for c, v in text.items()} | {"generation_id": F.lit(0), "input_revision": F.lit(0), "generated_at": F.lit(T0), "as_of_time": F.lit(T0)})
    return head.select("search", *documents.HEADER)


_READ = ", ".join(f"round({c}, 6) AS {c}" for c in _FIGURES)


@query(f"""WITH {TABLE_ROUTES}, {_TOTALS}, {_SOURCES}, {_POINTS}, f AS (SELECT search, string_agg('frame-' || f, ',' ORDER BY seen, f) AS source_ids FROM fr GROUP BY 1),
n AS (SELECT search, count(*) AS waypoints, max(eta_us) AS last_us, round(sum(mps), 6) AS mps FROM pts GROUP BY 1)
SELECT search, 'plan-' || search AS plan_id, {T0} AS start_us, waypoints::INT AS waypoints, last_us, mps, coalesce(turns, 0) AS turns, source_ids, {_READ} FROM t JOIN f USING (search) JOIN n USING (search) LEFT JOIN u USING (search)""")
def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up routes as plan documents, read back."""
    steps = table_routes(spark, sf_dir)
    read = documents.read_plans(documents.plan_documents(steps, _nodes(spark), plan_headers(steps)))
    names = {v: k for k, v in documents.METRICS.items()}
    return read.select(
        "search",
        "plan_id",
        F.col("start_time").alias("start_us"),
        F.size("waypoints").alias("waypoints"),
        F.element_at("waypoints", -1)["eta_us"].alias("last_us"),
        # speeds that are missing count for nothing; the sum of none is none
        F.round(F.aggregate(F.col("waypoints.mps"), F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x, a, x)), 6).alias("mps"),
        F.col("metrics.turn_count").alias("turns"),
        F.array_join("source_risk_ids", ",").alias("source_ids"),
        *(F.round(F.col(f"metrics.{names[c]}"), 6).alias(c) for c in _FIGURES),
    )


@query(f"""WITH {TABLE_ROUTES}, {_TOTALS}, {_POINTS},
n AS (SELECT search, count(*) AS n, min(eta_us) AS first_us, max(eta_us) AS last_us, bool_or(mps IS NULL) AS missing FROM pts GROUP BY 1),
r AS (SELECT search, bool_or(eta_us <= before) AS falls FROM (SELECT search, eta_us, lag(eta_us) OVER (PARTITION BY search ORDER BY step) AS before FROM pts) GROUP BY 1),
x AS (SELECT n.*, falls, t.hours, t.average_risk, t.max_risk AS max_risk, first_us + CASE WHEN s."row" = 0 THEN 5000000 ELSE 0 END AS start_us FROM n JOIN r USING (search) JOIN t USING (search) JOIN steps s ON s.search = n.search AND s.step = 0)
SELECT search, rule FROM x, LATERAL (VALUES ('fewer than two waypoints', n < 2), ('a waypoint has a missing field', missing), ('the first ETA is not the start', first_us <> start_us), ('ETAs do not rise', falls),
    ('eta_hours is not the last ETA', abs(hours - (last_us - start_us) / 3.6e9::DOUBLE) > greatest(1 / 3600.0::DOUBLE, abs((last_us - start_us) / 3.6e9::DOUBLE) * 1e-6)), ('average over maximum', average_risk > max_risk)) AS v(rule, broken) WHERE broken""")
def plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of these documents where some tell a later start than their first waypoint."""
    steps = table_routes(spark, sf_dir)
    return documents.plan_violations(documents.read_plans(documents.plan_documents(steps, _nodes(spark), plan_headers(steps, 5_000_000))))


@query("""WITH p AS (SELECT o_custkey AS set_id, ['full_voyage', 'long_range', 'medium_range', 'short_range'][(o_orderkey % 4 + 1)::INT] AS layer, ['fastest', 'low_risk', 'recommended'][(o_orderkey % 3 + 1)::INT] AS objective, o_orderkey AS plan_id, o_orderstatus AS identity FROM orders),
f AS (SELECT set_id, min(plan_id) AS full_id FROM p WHERE layer = 'full_voyage' AND objective = 'recommended' GROUP BY 1),
m AS (SELECT p.*, full_id, CASE WHEN plan_id % 5 <> 0 AND layer <> 'full_voyage' THEN full_id END AS reference_plan_id FROM p LEFT JOIN f USING (set_id)),
b AS (SELECT set_id, count(*) AS n, count(DISTINCT layer || objective) AS d, min(identity) AS i0, max(identity) AS i1, count_if(layer <> 'full_voyage' AND reference_plan_id IS DISTINCT FROM full_id) AS loose FROM m GROUP BY 1)
SELECT set_id, 'not twelve plans' AS rule FROM b WHERE n <> 12 OR d <> 12 UNION ALL SELECT set_id, 'mixed identity' FROM b WHERE i0 <> i1 UNION ALL SELECT set_id, 'reference is not the full plan' FROM b WHERE loose > 0""")
def plan_set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    of = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), F.pmod(k, F.lit(n)).cast("int") + 1)
    plans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), of([n for n, _ in layers.LAYERS], 4).alias("layer"), of(sorted(OBJECTIVES), 3).alias("objective"), k.alias("plan_id"), F.col("o_orderstatus").alias("identity"))
    full = plans.where("layer = 'full_voyage' and objective = 'recommended'").groupBy("set_id").agg(F.min("plan_id").alias("full_id"))
    named = plans.join(full, "set_id", "left").withColumn("reference_plan_id", F.when((F.col("plan_id") % 5 != 0) & (F.col("layer") != "full_voyage"), F.col("full_id"))).drop("full_id")
    return layers.set_violations(named)
