"""Queries on the store of layered plan sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions.motion import OBJECTIVES
from riskgrid.operators import set_geojson, set_store
from riskgrid.operators.layers import LAYERS
from riskgrid.operators.plan_sets import PLAN_ID, SET_ID
from riskgrid.operators.publish import TOKEN
from riskgrid.operators.shared import dealt, folder
from riskgrid.plans.registry import query
from riskgrid.plans.routes import TABLE_ROUTES, _nodes, table_routes
from riskgrid.plans.windows import COMMANDS, commands
from riskgrid.sources.cube import table

_FULL, _BEST = set_store.FULL, "recommended"


def submitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The commands of all users, with a set of twelve plans for nearly every publication, some of them faulty by the number of their event."""
    log = commands(spark, sf_dir)
    k = F.col("seq")
    published = log.where((F.col("kind") == "publish") & (k % 29 != 0)).select(F.col("plan_id").alias("set_id"), "seq", *TOKEN)
    places = F.array(*(F.struct(F.lit(n).alias("layer"), F.lit(o).alias("objective")) for n, _ in LAYERS for o in OBJECTIVES))
    each = published.select("set_id", "seq", F.explode(places).alias("p")).select("set_id", "seq", "p.*")
    each = each.where((k % 7 != 0) | (F.col("layer") != "short_range") | (F.col("objective") != _BEST))
    text = lambda layer, objective: F.concat_ws("/", "set_id", layer, objective)
    ident = lambda content: F.concat(F.lit(PLAN_ID), F.sha2(content, 256))
    first = (F.col("layer") == _FULL) & (F.col("objective") == _BEST)
    full = ident(text(F.lit(_FULL), F.lit(_BEST)))
    plans = each.withColumn("content", text(F.col("layer"), F.col("objective")))
    plans = plans.select(
        "set_id",
        "layer",
        "objective",
        F.when((k % 11 == 0) & ~first & (F.col("layer") == _FULL), F.lit("another")).otherwise(ident(F.col("content"))).alias("plan_id"),
        F.when(F.col("layer") != _FULL, F.when((k % 13 == 0) & (F.col("objective") == _BEST), F.lit("another")).otherwise(full)).alias("reference_plan_id"),
        "content",
    )
    ids = set_store.set_ids(plans).select("set_id", "expected_id")
    sets = published.join(ids, "set_id").withColumn("layer_set_id", F.when(k % 17 == 0, F.lit("another")).otherwise(F.col("expected_id")))
    sets = sets.withColumn("revision", F.col("revision") + (k % 19 == 0).cast("long"))
    return log, sets.select(*set_store.SETS), plans


_PLACES = ", ".join(f"('{n}/{o}')" for n, _ in LAYERS for o in OBJECTIVES)


@query(f"""WITH {COMMANDS}, z AS (SELECT *, own IS NOT NULL AND request_id = 'request-' || own AS mine FROM c),
f AS (SELECT *, coalesce(bool_or(kind = 'cancel' AND mine) OVER (PARTITION BY log, own ORDER BY seq), false) AS gone FROM z),
o AS (SELECT log, seq, plan_id, CASE WHEN own IS NULL THEN 'rejected: nothing active' WHEN NOT mine THEN 'rejected: stale' WHEN gone THEN 'rejected: cancelled'
    WHEN seq % 29 = 0 THEN 'rejected: no such set' WHEN seq % 7 = 0 THEN 'rejected: not every layer and objective once' WHEN seq % 11 = 0 THEN 'rejected: a plan''s id does not match its content' WHEN seq % 13 = 0 THEN 'rejected: a plan names another reference'
    WHEN seq % 17 = 0 THEN 'rejected: the set''s id does not match its content' WHEN seq % 19 = 0 THEN 'rejected: set of another revision' ELSE 'ok' END AS outcome FROM f WHERE kind = 'publish'),
s AS (SELECT log, seq, plan_id, lag(plan_id) OVER (PARTITION BY log ORDER BY seq) AS before FROM o WHERE outcome = 'ok'),
d AS (SELECT set_id, '{SET_ID}' || sha256('{{"plans":["' || string_agg(h, '","' ORDER BY h) || '"],"set":"' || set_id || '"}}') AS layer_set_id FROM (SELECT plan_id AS set_id, sha256(plan_id || '/' || place) AS h FROM s, (VALUES {_PLACES}) AS p(place)) GROUP BY 1)
SELECT o.log, o.seq, o.outcome, s.plan_id AS current, s.before AS previous, d.layer_set_id FROM o ASOF LEFT JOIN s ON s.log = o.log AND s.seq <= o.seq LEFT JOIN d ON d.set_id = s.plan_id""")
def layer_set_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every publication of a layered set comes to, and the sets that stand after it, with the id of the current one from its plans' contents."""
    log, sets, plans = submitted(spark, sf_dir)
    said = set_store.replay_sets(log, sets, plans).where("kind = 'publish'")
    ids = set_store.set_ids(plans).select(F.col("set_id").alias("current"), F.col("expected_id").alias("layer_set_id"))
    return said.join(ids, "current", "left").select("log", "seq", "outcome", "current", "previous", "layer_set_id")


@query(f"""WITH {COMMANDS}, z AS (SELECT *, own IS NOT NULL AND request_id = 'request-' || own AS mine FROM c),
f AS (SELECT *, coalesce(bool_or(kind = 'cancel' AND mine) OVER (PARTITION BY log, own ORDER BY seq), false) AS gone FROM z),
s AS (SELECT log, arg_max(plan_id, seq) AS set_id FROM f WHERE kind = 'publish' AND mine AND NOT gone AND seq % 29 <> 0 AND seq % 7 <> 0 AND seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0 GROUP BY 1)
SELECT log, set_id, split_part(place, '/', 1) AS layer, split_part(place, '/', 2) AS objective, '{PLAN_ID}' || sha256(set_id || '/' || place) AS plan_id FROM s, (VALUES {_PLACES}) AS p(place)""")
def layer_set_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans that stand for every user after the commands came to a store in two commits."""
    log, sets, plans = submitted(spark, sf_dir)
    root = folder(spark, "layer-sets")
    own = log.where("kind = 'publish'").select(F.col("plan_id").alias("set_id"), "seq")
    cut = log.groupBy("log").agg(((F.min("seq") + F.max("seq")) / 2).alias("cut"))
    first = log.join(cut, "log").where("seq <= cut")
    held = own.join(first.select("seq"), "seq", "left_semi").select("set_id")
    plans = dealt(plans, "set_id")
    set_store.commit(root, first, sets.join(held, "set_id", "left_semi"), plans.join(held, "set_id", "left_semi"))
    set_store.commit(root, log.join(cut, "log").where("seq > cut"), sets.join(held, "set_id", "left_anti"), plans.join(held, "set_id", "left_anti"))
    return set_store.current_plans(spark, root).select("log", "set_id", "layer", "objective", "plan_id")


def drawn_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve plans for the made-up route of every customer, each an hour later than the one before."""
    # few bytes to exchange, but twelve texts are made of each: tasks by the number of rows, not by their bytes
    steps = dealt(table_routes(spark, sf_dir).join(_nodes(spark), ["row", "col"]), "search", rows=table(spark, sf_dir, "orders").count())
    points = steps.groupBy("search").agg(F.sort_array(F.collect_list(F.struct("step", "lon", "lat", "eta_us", (F.col("knots") / 2).alias("mps")))).alias("points"))
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("layer"), F.lit(o).alias("objective")) for i, (n, o) in enumerate(set_geojson.PLACES)))
    each = points.select(F.col("search").alias("set_id"), "points", F.explode(places).alias("p")).select("set_id", "points", "p.*")
    later = F.transform("points", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), (p["eta_us"] + F.col("i") * F.lit(3_600_000_000)).alias("eta_us"), p["mps"].alias("mps")))
    full = F.concat(F.col("set_id"), F.lit(f"/{_FULL}/{_BEST}"))
    return each.select("set_id", "layer", "objective", F.concat_ws("/", "set_id", "layer", "objective").alias("plan_id"), F.when(F.col("layer") != _FULL, full).alias("reference_plan_id"), later.alias("waypoints"))


def _number(key: str):
    """The customer's number in an id that begins with the route's name."""
    return F.regexp_extract(key, r"^route-(\d+)", 1).cast("long")


_DRAWN = f"pl AS (SELECT i, split_part(place, '/', 1) AS layer, split_part(place, '/', 2) AS objective, place FROM (VALUES {', '.join(f"({i}, '{n}/{o}')" for i, (n, o) in enumerate(set_geojson.PLACES))}) AS p(i, place))"


@query(f"""WITH {TABLE_ROUTES}, {_DRAWN}, t AS (SELECT search, split_part(search, '-', 2)::BIGINT AS c, count(*) AS waypoints, max_by(eta_us, step) AS last_us, round(sum(18.0::DOUBLE + 0.1::DOUBLE * col), 6) AS lon, round(sum(70.0::DOUBLE + 0.05::DOUBLE * "row"), 6) AS lat, round(sum(knots / 2), 6) AS mps FROM steps GROUP BY 1)
SELECT search AS set_id, layer, objective, search || '/' || place AS plan_id, CASE WHEN layer <> '{_FULL}' THEN search || '/{_FULL}/{_BEST}' END AS reference_plan_id, waypoints::INT AS waypoints, last_us + i::BIGINT * 3600000000 AS last_us, lon, lat, mps FROM t, pl WHERE c % 9 NOT IN (1, 2, 3, 4)""")
def layer_set_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn sets as GeoJSON, read back; those that were tampered with give nothing."""
    plans, _ = set_geojson.read_sets(tampered_sets(spark, sf_dir))
    total = lambda f: F.round(F.aggregate(F.col(f"waypoints.{f}"), F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x, a, x)), 6).alias(f)
    return plans.select("set_id", "layer", "objective", "plan_id", "reference_plan_id", F.size("waypoints").alias("n"), F.element_at("waypoints", -1)["eta_us"].alias("last_us"), *map(total, ("lon", "lat", "mps"))).withColumnRenamed("n", "waypoints")


def tampered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets as GeoJSON, some with a type, an id, a place or a list of times changed, by the number of their customer."""
    c, text = F.pmod(_number("set_id"), F.lit(9)), F.col("geojson")
    changed = (
        F.when(c == 1, F.regexp_replace(text, "FeatureCollection", "Features"))
        .when(c == 2, F.regexp_replace(text, '"id":"[^"]*/medium_range/fastest"', '"id":"another"'))
        .when(c == 3, F.regexp_replace(text, '"layer":"short_range","objective":"fastest"', '"layer":"short_range","objective":"recommended"'))
        .when(c == 4, F.regexp_replace(text, '"waypoint_etas":\\[', '"waypoint_etas":[0,'))
    )
    return set_geojson.set_collections(drawn_plans(spark, sf_dir)).select("set_id", F.coalesce(changed, text).alias("geojson"))


@query("""WITH s AS (SELECT DISTINCT 'route-' || o_custkey AS set_id, o_custkey % 9 AS c FROM orders)
SELECT set_id, ['not a feature collection', 'id is not the plan''s', 'not every layer and objective once', 'arrays of different lengths'][c::INT] AS problem FROM s WHERE c IN (1, 2, 3, 4)""")
def layer_set_geojson_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_geojson.read_sets(tampered_sets(spark, sf_dir))[1]


@query(f"""WITH p AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1), {_DRAWN}
SELECT 'route-' || c || '/' || place AS plan_id, CASE WHEN (c + i) % 7 = 1 THEN 'another number of waypoints' ELSE 'a waypoint does not match' END AS problem FROM p, pl WHERE (c + i) % 7 IN (1, 2)""")
def layer_plan_geojson_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as GeoJSON with their points, of which some lack the last, and some tell another time for the first."""
    made = set_geojson.plan_collections(drawn_plans(spark, sf_dir))
    rank = F.array_position(F.array(*(F.lit(f"{n}/{o}") for n, o in set_geojson.PLACES)), F.regexp_extract("plan_id", r"/(.*)$", 1)) - 1
    c, text = F.pmod(_number("plan_id") + rank, F.lit(7)), F.col("geojson")
    less = F.regexp_replace(text, r',\{"type":"Feature","id":"[^"]*","geometry":\{"type":"Point","coordinates":\[[^\]]*\]\},"properties":\{[^}]*\}\}\],"properties":\{\}\}$', '],"properties":{}}')
    other = F.regexp_replace(text, r'"index":0,"eta_us":\d+', '"index":0,"eta_us":7')
    return set_geojson.read_plans(made.select("plan_id", F.when(c == 1, less).when(c == 2, other).otherwise(text).alias("geojson")))[1]
