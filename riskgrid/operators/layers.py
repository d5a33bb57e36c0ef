"""Layered plan sets: a full voyage and three nearer layers towards its anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.motion import MICROS_PER_HOUR, OBJECTIVES
from riskgrid.operators.shared import folder, written

#: Layers and their cut-off hours after the start (fixed values); None: the whole voyage.
LAYERS = (("full_voyage", None), ("long_range", 72), ("medium_range", 24), ("short_range", 6))


def anchors(steps: DataFrame, cutoffs: DataFrame, key: str = "search") -> DataFrame:
    """For each route and layer (layer, hours): the node of its last step at or before the cut-off.

    The start's node is no anchor; a route that ends earlier is anchored at
    its end; a route without such a step has NULLs and ``materialisable`` false.
    """
    start = steps.where("step = 0").select(key, F.col("row").alias("__rg_r"), F.col("col").alias("__rg_c"), F.col("eta_us").alias("__rg_t"))
    end = steps.groupBy(key).agg(F.max_by(F.struct("row", "col", "eta_us"), "step").alias("__rg_e"))
    met = steps.join(start, key).join(F.broadcast(cutoffs))
    cut = F.col("__rg_t") + F.col("hours_limit") * F.lit(MICROS_PER_HOUR)
    eligible = (F.col("step") > 0) & ((F.col("row") != F.col("__rg_r")) | (F.col("col") != F.col("__rg_c")))
    best = met.groupBy(key, "layer", "hours_limit").agg(
        F.max_by(F.struct("row", "col", "eta_us"), F.when(eligible & (F.col("eta_us") <= cut), F.col("step"))).alias("a"),
        F.bool_or(eligible).alias("moves"),
        F.max(cut).alias("cut"),
    )
    out = best.join(end, key)
    early = F.col("moves") & (F.col("__rg_e.eta_us") <= F.col("cut"))
    node = F.when(early, F.col("__rg_e")).otherwise(F.col("a"))
    return out.select(key, "layer", "hours_limit", node["row"].alias("row"), node["col"].alias("col"), node["eta_us"].alias("eta_us"), node.isNotNull().alias("materialisable"))


def layer_windows(totals: DataFrame, horizon_h: float, key: str = "search") -> DataFrame:
    """Focus window and time ceiling (hours) of each layer: the nearest of horizon, cut-off and full duration."""
    layers = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(n).alias("layer"), F.lit(h).cast("double").alias("cut")) for i, (n, h) in enumerate(LAYERS)))
    out = totals.select(key, "hours", F.explode(layers).alias("l"))
    ceiling = F.when(F.col("l.cut").isNull(), F.lit(float(horizon_h))).otherwise(F.least(F.lit(float(horizon_h)), F.col("l.cut"), F.col("hours")))
    return out.select(key, F.col("l.rank").alias("rank"), F.col("l.layer").alias("layer"), F.lit(0.0).alias("from_h"), ceiling.alias("ceiling_h"))


def set_violations(plans: DataFrame) -> DataFrame:
    """Violations of plan sets given as (set_id, layer, objective, plan_id, reference_plan_id, identity).

    A set has every objective in every layer once and one identity, and its
    lower layers name the recommended full plan.
    """
    n_objectives, names = len(OBJECTIVES), [n for n, _ in LAYERS]
    full = plans.where((F.col("layer") == names[0]) & (F.col("objective") == "recommended")).groupBy("set_id").agg(F.min("plan_id").alias("full_id"))
    met = plans.join(full, "set_id", "left")
    by = met.groupBy("set_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("layer", "objective").alias("d"),
        F.min("identity").alias("i0"),
        F.max("identity").alias("i1"),
        F.count_if((F.col("layer") != names[0]) & ~F.col("reference_plan_id").eqNullSafe(F.col("full_id"))).alias("loose"),
        F.count_if((F.col("layer") == names[0]) & F.col("reference_plan_id").isNotNull()).alias("circular"),
    )
    rules = {
        "not twelve plans": (F.col("n") != n_objectives * len(names)) | (F.col("d") != n_objectives * len(names)),
        "mixed identity": F.col("i0") != F.col("i1"),
        "reference is not the full plan": F.col("loose") > 0,
        "full plan has a reference": F.col("circular") > 0,
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))
    return by.select("set_id", F.explode(broken).alias("rule"))


def layered_set(cube: DataFrame, requests: DataFrame, horizon_h: float, cutoffs: tuple = tuple(x for x in LAYERS if x[1]), **options) -> DataFrame:
    """Steps of all layers and objectives: the three full searches at once, then the nearer nine at once.

    A request (search, r0, c0, r1, c1, depart_us, bucket_us) whose
    recommended voyage has no anchor for some layer yields no rows at all.
    Requests that ask the same have one set made for all of them.
    """
    from riskgrid.operators.search import distinct, routes

    spark = cube.sparkSession
    base = folder(spark, "layers")
    each = F.array(*(F.lit(o) for o in OBJECTIVES))
    requests, same = distinct(requests, base, ("r0", "c0", "r1", "c1", "depart_us", "bucket_us"))
    full = requests.select("*", F.explode(each).alias("objective"), F.lit(LAYERS[0][0]).alias("layer"), F.lit(round(horizon_h * MICROS_PER_HOUR)).cast("long").alias("horizon_us"), F.col("search").alias("set_id"))
    full = full.withColumn("search", F.concat_ws("/", "set_id", "layer", "objective"))
    top = written(routes(cube, full, **options).withColumn("set_id", F.substring_index("search", "/", 1)), f"{base}/full")
    ok = top.groupBy("set_id").agg(F.bool_and(F.col("status") == "ok").alias("ok")).where("ok").select("set_id")
    best = top.where(F.col("search").endswith("/recommended")).join(ok, "set_id")
    cuts = spark.createDataFrame(list(cutoffs), "layer string, hours_limit int")
    found = anchors(best.withColumnRenamed("search", "s").withColumnRenamed("set_id", "search"), cuts).withColumnRenamed("search", "set_id")
    whole = found.groupBy("set_id").agg(F.bool_and("materialisable").alias("m")).where("m").select("set_id")
    hours = best.groupBy("set_id").agg(F.sum("hours").alias("h"))
    lower = found.join(whole, "set_id").join(hours, "set_id").join(requests.withColumnRenamed("search", "set_id").drop("r1", "c1"), "set_id")
    limit = F.least(F.lit(float(horizon_h)), F.col("hours_limit").cast("double"), F.col("h"))
    lower = lower.select("set_id", "layer", F.explode(each).alias("objective"), "r0", "c0", F.col("row").alias("r1"), F.col("col").alias("c1"), "depart_us", "bucket_us", F.ceil(limit * MICROS_PER_HOUR).alias("horizon_us"))
    lower = lower.withColumn("search", F.concat_ws("/", "set_id", "layer", "objective"))
    down = written(routes(cube, lower, **options).withColumn("set_id", F.substring_index("search", "/", 1)), f"{base}/lower")
    good = down.groupBy("set_id").agg(F.bool_and(F.col("status") == "ok").alias("ok"), F.count_distinct("search").alias("n")).where(F.col("ok") & (F.col("n") == len(OBJECTIVES) * len(cutoffs))).select("set_id")
    parts = F.split("search", "/")
    made = written(top.unionByName(down).join(good, "set_id"), f"{base}/sets").withColumnRenamed("set_id", "of")
    made = made.join(same.withColumnRenamed("search", "set_id"), "of")
    return made.select("set_id", parts[1].alias("layer"), parts[2].alias("objective"), *(c for c in top.columns if c not in ("set_id", "search")))
