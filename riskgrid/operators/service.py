"""Planning from request to publication, and the replanning tick, for many runs at once.

A request begins with the activation of its token, is searched under all
objectives, passes the switch gate against the plan that stands, and is
published if its token is still the active one when the log is read in order.
What a run has published is a table; nothing is kept between calls but tables.

Defined cases: a request one of whose searches fails publishes nothing and
tells the first failing status in the order of objectives; a run without a
standing plan takes any; requests of one run are taken in the order of their
seq, which must be even (the odd number after it is that of its publication);
no requests give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.motion import OBJECTIVES
from riskgrid.operators import publish, replan, routes, search
from riskgrid.operators.shared import folder, written
from riskgrid.operators.validate import violations

#: Longest horizon of a search in hours (fixed value).
MAX_HORIZON_H = 216


def request_violations(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Broken rules of requests (search, r0, c0, r1, c1, depart_us, as_of_us, horizon_us, bucket_us) on a grid of open and closed cells."""
    rows = requests
    for role in ("0", "1"):
        at = cells.select(F.col("row").alias(f"r{role}"), F.col("col").alias(f"c{role}"), F.col("open").alias(f"open{role}"))
        rows = rows.join(at, [f"r{role}", f"c{role}"], "left")
    rules = {
        "start is outside the grid": F.col("open0").isNull(),
        "goal is outside the grid": F.col("open1").isNull(),
        "start is closed": ~F.col("open0"),
        "goal is closed": ~F.col("open1"),
        "start and goal are one node": (F.col("r0") == F.col("r1")) & (F.col("c0") == F.col("c1")),
        "forecast is newer than the start": F.col("as_of_us") > F.col("depart_us"),
        "horizon is not positive or too long": F.col("horizon_us").isNotNull() & ((F.col("horizon_us") <= 0) | (F.col("horizon_us") > MAX_HORIZON_H * 3_600_000_000)),
        "time bucket is not positive": F.col("bucket_us").isNull() | (F.col("bucket_us") <= 0),
    }
    return violations(rows, rules, ["search"])


def risk_violations(frames: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """(search, rule): requests whose identity no frame has, or that some frame of it is newer than (as_of over as_of_us)."""
    newest = frames.groupBy(*keys).agg(F.max("as_of").alias("__rg_m"))
    rows = requests.join(newest, keys, "left")
    return violations(rows, {"no frame of this identity": F.col("__rg_m").isNull(), "a frame is newer than the request": F.col("__rg_m") > F.col("as_of_us")}, ["search"])


def execute(cube: DataFrame, requests: DataFrame, log: DataFrame, current: DataFrame, policy: replan.Policy | None = None, objective: str = "recommended", **options) -> tuple[DataFrame, DataFrame]:
    """Outcome of every request, and the log with what the requests add to it.

    requests: log, seq, the token, corridor_id, vessel_id, r0, c0, r1, c1,
    depart_us, horizon_us, bucket_us, reasons (array) and force. log: commands
    as in ``publish``. current: log, plan_id and struct ``plan`` (scenario,
    generation, corridor, vessel, cost, max_risk) of the plan that stands.

    The outcome has log, seq, request_id, status (published, kept, failed or
    superseded), why, plan_id, cost and max_risk.
    """
    base = folder(cube.sparkSession, "service")
    each = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(o).alias("objective")) for i, o in enumerate(OBJECTIVES)))
    wanted = requests.select("log", "seq", F.explode(each).alias("o"), "r0", "c0", "r1", "c1", "depart_us", "horizon_us", "bucket_us")
    wanted = wanted.select("*", F.col("o.objective").alias("objective"), F.concat_ws("/", "log", "seq", "o.rank").alias("search"))
    steps = written(search.routes(cube, wanted, **options), f"{base}/steps")
    names = wanted.select("search", "log", "seq", F.col("o.rank").alias("rank"), "objective")
    told = steps.groupBy("search").agg(F.first("status").alias("status")).join(names, "search")
    failed = told.groupBy("log", "seq").agg(F.min(F.when(F.col("status") != "ok", F.struct("rank", "status")))["status"].alias("failed"))
    best = routes.totals(steps.where("status = 'ok'").join(names.where(F.col("objective") == objective).select("search"), "search", "left_semi")).join(names, "search").select("log", "seq", "cost", "max_risk")
    rows = requests.join(failed, ["log", "seq"]).join(best, ["log", "seq"], "left").join(current.select("log", F.col("plan").alias("current")), "log", "left")
    plan = F.struct(F.col("scenario_id").alias("scenario"), "generation", F.col("corridor_id").alias("corridor"), F.col("vessel_id").alias("vessel"), "cost", "max_risk")
    gated = replan.switch_gate(rows.withColumn("candidate", plan), policy)
    gated = written(gated.withColumn("plan_id", F.concat_ws("-", F.lit("plan"), "log", "seq")), f"{base}/gated")
    begin = gated.select("log", "seq", F.lit("activate").alias("kind"), *publish.TOKEN, F.lit(None).cast("string").alias("plan_id"))
    end = gated.where("failed is null and accepted").select("log", (F.col("seq") + 1).alias("seq"), F.lit("publish").alias("kind"), *publish.TOKEN, "plan_id")
    whole = log.select(*begin.columns).unionByName(begin).unionByName(end)
    said = publish.replay(whole).select("log", F.col("seq").alias("__rg_q"), "kind", "outcome")
    began = said.where("kind = 'activate'").select("log", F.col("__rg_q").alias("seq"), F.col("outcome").alias("began"))
    ended = said.where("kind = 'publish'").select("log", (F.col("__rg_q") - 1).alias("seq"), F.col("outcome").alias("ended"))
    out = gated.join(began, ["log", "seq"]).join(ended, ["log", "seq"], "left")
    status = F.when(F.col("began") != "ok", "superseded").when(F.col("failed").isNotNull(), "failed").when(~F.col("accepted"), "kept").when(F.col("ended") == "ok", "published").otherwise("superseded")
    reason = F.when(status == "superseded", F.coalesce(F.when(F.col("began") != "ok", F.col("began")), F.col("ended"))).when(status == "failed", F.col("failed")).otherwise(F.col("why"))
    return out.select("log", "seq", "request_id", status.alias("status"), reason.alias("why"), F.when(status == "published", F.col("plan_id")).alias("plan_id"), "cost", "max_risk"), whole


def tick(baselines: DataFrame, observations: DataFrame, policy: replan.Policy | None = None) -> DataFrame:
    """Decision on one observation for each key against its baseline (see ``replan``); an expression in one row.

    baselines: key and the fields of an observation's baseline with a ``b_``
    before them; keys without one have none. Adds outcome, reasons, retry_us.
    """
    p = policy or replan.Policy()
    o = observations.join(baselines, "key", "left")
    known = F.col("b_at_us").isNotNull()
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) >= p.change
    on = {
        "time": known & (F.col("valid_us") > F.col("b_valid_us")),
        "data": known & ((F.col("data_revision") > F.col("b_data_revision")) | (F.col("risk_revision") != F.col("b_risk_revision"))),
        "risk": F.col("hard") | ((F.col("max_risk") >= p.high) & ~F.coalesce("b_latched", F.lit(False))) | (known & (near("max_risk", "b_max_risk") | near("avg_risk", "b_avg_risk"))),
        "deviation": F.col("deviation_km") >= p.deviation_km,
        "event": F.col("event").isNotNull() & ~F.col("event").eqNullSafe(F.col("b_event")),
        "manual": F.col("manual"),
    }
    reasons = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(on[r], F.lit(False)), r) for r in replan.REASONS))), ",")
    back: Column = known & ((F.col("data_revision") < F.col("b_data_revision")) | (F.col("valid_us") < F.col("b_valid_us")))
    urgent = (F.col("manual") | F.col("hard")) if p.urgent_bypasses else F.lit(False)
    early = known & (F.col("at_us") < F.col("b_at_us") + p.min_interval_us) & ~urgent
    out = o.withColumn("reasons", F.when(F.coalesce(back, F.lit(False)), "").otherwise(reasons))
    outcome = F.when(F.coalesce(back, F.lit(False)), "error").when(F.col("reasons") == "", "none").when(early, "wait").otherwise("fire")
    return out.withColumn("outcome", outcome).withColumn("retry_us", F.when(F.col("outcome") == "wait", F.col("b_at_us") + p.min_interval_us))


def moved_baselines(baselines: DataFrame, decided: DataFrame, published: DataFrame, policy: replan.Policy | None = None) -> DataFrame:
    """Baselines after a tick: those of keys in ``published`` (key) whose observation fired move to it, the others stay."""
    p = policy or replan.Policy()
    fields = ("at_us", "valid_us", "data_revision", "risk_revision", "avg_risk", "max_risk", "event")
    latched = F.when(F.col("max_risk") >= p.high, True).when(F.col("max_risk") <= p.clear, False).otherwise(F.coalesce("b_latched", F.lit(False)))
    new = decided.where("outcome = 'fire'").join(published.select("key").distinct(), "key", "left_semi").select("key", *(F.col(c).alias(f"b_{c}") for c in fields), latched.alias("b_latched"))
    return baselines.join(new, "key", "left_anti").select(*new.columns).unionByName(new)
