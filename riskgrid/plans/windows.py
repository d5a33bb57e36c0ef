"""Queries on frame revisions and windows, and on ordered observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.operators import publish, replan, service, validate, windows
from riskgrid.plans.registry import FRAMES, query
from riskgrid.sources.cube import table, table_frames


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table_frames(spark, sf_dir)
    return f.select("risk_id", "run_id", "scenario_id", "corridor_id", "generation", F.col("valid_h").alias("valid"), F.col("as_of_h").alias("as_of"), (F.col("as_of_h") + F.col("generated_h")).alias("generated"))


@query(f"""WITH {FRAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, corridor_id, valid ORDER BY as_of DESC, generated DESC, risk_id DESC) AS n FROM frames)
SELECT run_id, corridor_id, valid, risk_id, scenario_id, generation, as_of, generated FROM k WHERE n = 1""")
def asof_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_revisions(frames(spark, sf_dir), ["run_id", "corridor_id"])


@query(f"""WITH {FRAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY valid ORDER BY as_of DESC, generated DESC, risk_id DESC) AS n FROM frames
WHERE run_id = 'run-3' AND scenario_id = 'scenario-3' AND corridor_id = 'corridor-1' AND generation = 1 AND as_of <= 245000 AND valid BETWEEN 200000 AND 245000)
SELECT run_id, scenario_id, corridor_id, generation, valid, risk_id, as_of, generated FROM k WHERE n = 1""")
def risk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = {"run_id": "run-3", "scenario_id": "scenario-3", "corridor_id": "corridor-1", "generation": 1}
    return windows.window(frames(spark, sf_dir), 200_000, 245_000, 245_000, identity)


@query(f"""WITH {FRAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, valid ORDER BY as_of DESC, generated DESC, risk_id DESC) AS n FROM frames),
t AS (SELECT c_custkey, 'run-' || (c_custkey % 20) AS run_id, (8036 + (c_custkey * 37) % 3500) * 24 AS target FROM customer),
j AS (SELECT t.*, k.risk_id, k.valid, k.as_of, row_number() OVER (PARTITION BY c_custkey ORDER BY k.valid DESC NULLS LAST) AS m FROM t LEFT JOIN k ON k.n = 1 AND k.run_id = t.run_id AND k.valid <= t.target)
SELECT c_custkey, run_id, target, risk_id, valid, as_of FROM j WHERE m = 1""")
def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = windows.latest_revisions(frames(spark, sf_dir), ["run_id"]).select("run_id", "risk_id", "valid", "as_of")
    k = F.col("c_custkey")
    targets = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("run-"), F.pmod(k, F.lit(20)).cast("string")).alias("run_id"), ((8036 + F.pmod(k * 37, F.lit(3500))) * 24).alias("target"))
    return windows.latest_before(targets, best, "run_id")


@query(f"""WITH {FRAMES}, b AS (SELECT run_id, corridor_id, min(valid) AS a, max(valid) AS z FROM frames GROUP BY 1, 2),
w AS (SELECT run_id, corridor_id, unnest(range(a, z, 168)) AS missing FROM b)
SELECT w.run_id, w.corridor_id, w.missing FROM w LEFT JOIN (SELECT DISTINCT run_id, corridor_id, valid FROM frames) f ON f.run_id = w.run_id AND f.corridor_id = w.corridor_id AND f.valid = w.missing WHERE f.valid IS NULL""")
def window_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gaps(frames(spark, sf_dir), ["run_id", "corridor_id"], 168)


@query(f"""WITH {FRAMES} SELECT run_id, corridor_id, generation, valid, count(*) AS n FROM frames GROUP BY ALL HAVING count(*) > 1""")
def window_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.duplicates(frames(spark, sf_dir), ["run_id", "corridor_id", "generation", "valid"])


@query(f"""WITH {FRAMES}, w AS (SELECT unnest(range(219072, 260000, 168)) AS "at"), h AS (SELECT valid AS "at", count(*) AS n, max(as_of) AS as_of FROM frames WHERE run_id = 'run-5' GROUP BY 1),
j AS (SELECT coalesce(w."at", h."at") AS "at", CASE WHEN h.n IS NULL THEN 'missing' WHEN w."at" IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' WHEN as_of > 240000 THEN 'known too late' END AS reason FROM w FULL JOIN h ON w."at" = h."at")
SELECT "at", reason FROM j WHERE reason IS NOT NULL""")
def window_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_contract(frames(spark, sf_dir).where("run_id = 'run-5'"), 219_072, 219_072 + 168 * ((259_999 - 219_072) // 168), 168, 240_000)


@query(f"""WITH {FRAMES}, g AS (SELECT corridor_id, valid, CASE WHEN min(run_id) <> max(run_id) THEN 'run_id' END AS a, CASE WHEN min(scenario_id) <> max(scenario_id) THEN 'scenario_id' END AS b, CASE WHEN min(generation) <> max(generation) THEN 'generation' END AS c FROM frames GROUP BY 1, 2)
SELECT corridor_id, valid, concat_ws(',', a, b, c) AS mixed FROM g WHERE concat_ws(',', a, b, c) <> ''""")
def identity_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.identity_violations(frames(spark, sf_dir), ["corridor_id", "valid"], ["run_id", "scenario_id", "generation"])


@query(f"""WITH {FRAMES}, h AS (SELECT DISTINCT run_id, corridor_id, generation FROM frames),
w AS (SELECT c_custkey, 'run-' || (c_custkey % 25) AS run_id, 'corridor-' || (c_custkey % 4) AS corridor_id, (c_custkey % 3)::INT AS generation FROM customer)
SELECT w.*, h.run_id IS NOT NULL AS available FROM w LEFT JOIN h ON w.run_id = h.run_id AND w.corridor_id = h.corridor_id AND w.generation = h.generation""")
def context_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    named = lambda prefix, n: F.concat(F.lit(prefix), F.pmod(k, F.lit(n)).cast("string"))
    wanted = table(spark, sf_dir, "customer").select("c_custkey", named("run-", 25).alias("run_id"), named("corridor-", 4).alias("corridor_id"), F.pmod(k, F.lit(3)).cast("int").alias("generation"))
    return windows.exists(frames(spark, sf_dir), wanted, ["run_id", "corridor_id", "generation"])


@query(f"""WITH {FRAMES} SELECT run_id, count(*) AS n, min(valid) AS first_valid, max(valid) AS last_valid FROM frames WHERE generation = 1 GROUP BY 1""")
def generation_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.of_generation(frames(spark, sf_dir), 1).groupBy("run_id").agg(F.count("*").alias("n"), F.min("valid").alias("first_valid"), F.max("valid").alias("last_valid"))


@query("""WITH a AS (SELECT c_nationkey, c_custkey, c_acctbal, lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS before FROM customer) SELECT * FROM a WHERE before >= c_acctbal""")
def axis_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.not_ascending(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey")


OBSERVED = """o AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS at_us, (epoch_us(ts) // 3600000000) * 3600000000 AS valid_us, event_id // 500 AS data_revision, 'risk-' || (event_id // 250) AS risk_revision,
    (round(value * 100)::BIGINT % 80) / 200.0::DOUBLE AS avg_risk, (round(value * 100)::BIGINT % 80) / 100.0::DOUBLE AS max_risk, (event_id % 13)::DOUBLE AS deviation_km,
    CASE WHEN event_type = 'purchase' THEN 'event-' || (event_id // 40) END AS event, event_type = 'signup' AND event_id % 5 = 0 AS manual, event_type = 'error' AND event_id % 17 = 0 AS hard, event_id % 3 <> 0 AS published FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation for every event, one log for each user."""
    e = table(spark, sf_dir, "events")
    k, at = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    risk = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(80))
    whole = lambda n: F.floor(k / n).cast("long")
    return e.select(
        F.col("user_id").alias("key"),
        k.alias("seq"),
        at.alias("at_us"),
        (F.floor(at / 3_600_000_000).cast("long") * F.lit(3_600_000_000)).alias("valid_us"),
        whole(500).alias("data_revision"),
        F.concat(F.lit("risk-"), whole(250).cast("string")).alias("risk_revision"),
        (risk / 200.0).alias("avg_risk"),
        (risk / 100.0).alias("max_risk"),
        F.pmod(k, F.lit(13)).cast("double").alias("deviation_km"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("event-"), whole(40).cast("string"))).alias("event"),
        ((F.col("event_type") == "signup") & (k % 5 == 0)).alias("manual"),
        ((F.col("event_type") == "error") & (k % 17 == 0)).alias("hard"),
        (k % 3 != 0).alias("published"),
    )


POLICY = replan.Policy()

_ON = {
    "time": "b.at_us IS NOT NULL AND o.valid_us > b.valid_us",
    "data": "b.at_us IS NOT NULL AND (o.data_revision > b.data_revision OR o.risk_revision <> b.risk_revision)",
    "risk": "o.hard OR (o.max_risk >= 0.65 AND NOT b.latched) OR (b.at_us IS NOT NULL AND greatest(abs(o.max_risk - b.max_risk), abs(o.avg_risk - b.avg_risk)) >= 0.10::DOUBLE)",
    "deviation": "o.deviation_km >= 10",
    "event": "o.event IS NOT NULL AND (b.event IS NULL OR o.event <> b.event)",
    "manual": "o.manual",
}


@query(f"""WITH RECURSIVE {OBSERVED}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_us, seq) AS rn FROM o),
b AS (SELECT DISTINCT key, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reasons, NULL::BIGINT AS retry_us, NULL::BIGINT AS at_us, NULL::BIGINT AS valid_us, NULL::BIGINT AS data_revision, NULL::VARCHAR AS risk_revision, NULL::DOUBLE AS avg_risk, NULL::DOUBLE AS max_risk, NULL::VARCHAR AS event, false AS latched FROM n
UNION ALL
SELECT key, rn, seq, outcome, CASE WHEN outcome = 'error' THEN '' ELSE reasons END, CASE WHEN outcome = 'wait' THEN bat + 1800000000 END,
  CASE WHEN c THEN at_us ELSE bat END, CASE WHEN c THEN valid_us ELSE bvalid END, CASE WHEN c THEN data_revision ELSE brev END, CASE WHEN c THEN risk_revision ELSE brisk END, CASE WHEN c THEN avg_risk ELSE bavg END, CASE WHEN c THEN max_risk ELSE bmax END, CASE WHEN c THEN event ELSE bevent END,
  CASE WHEN c AND max_risk >= 0.65 THEN true WHEN c AND max_risk <= 0.55 THEN false ELSE latched END
FROM (SELECT *, outcome = 'fire' AND published AS c FROM (
  SELECT *, CASE WHEN bat IS NOT NULL AND (data_revision < brev OR valid_us < bvalid) THEN 'error' WHEN reasons = '' THEN 'none' WHEN bat IS NOT NULL AND at_us < bat + 1800000000 AND NOT (manual OR hard) THEN 'wait' ELSE 'fire' END AS outcome
  FROM (SELECT o.*, b.at_us AS bat, b.valid_us AS bvalid, b.data_revision AS brev, b.risk_revision AS brisk, b.avg_risk AS bavg, b.max_risk AS bmax, b.event AS bevent, b.latched,
    concat_ws(',', {", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _ON.items())}) AS reasons
    FROM b JOIN n o ON o.key = b.key AND o.rn = b.rn + 1))))
SELECT key, seq, outcome, reasons, retry_us FROM b WHERE rn > 0""")
def replan_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replan.triggers(observations(spark, sf_dir), POLICY)


_BASE = {"at_us": "BIGINT", "valid_us": "BIGINT", "data_revision": "BIGINT", "risk_revision": "VARCHAR", "avg_risk": "DOUBLE", "max_risk": "DOUBLE", "event": "VARCHAR"}
_LATER = {"seq": "BIGINT", "at_us": "BIGINT", "valid_us": "BIGINT", "data_revision": "BIGINT", "risk_revision": "VARCHAR", "avg_risk": "DOUBLE", "max_risk": "DOUBLE", "event": "VARCHAR", "published": "BOOLEAN", "reasons": "VARCHAR"}
_NO_HELD = f"NULL::STRUCT({', '.join(f'{k} {v}' for k, v in _LATER.items())})"
_NO_BASE = f"{{{', '.join(f"'{k}': NULL::{v}" for k, v in _BASE.items())}, 'latched': false}}"


def _based(on: str) -> str:
    latched = f"CASE WHEN {on}.max_risk >= 0.65 THEN true WHEN {on}.max_risk <= 0.55 THEN false ELSE b.latched END"
    return f"{{{', '.join(f"'{k}': {on}.{k}" for k in _BASE)}, 'latched': {latched}}}"


_TIMED = f"""WITH RECURSIVE {OBSERVED}, g AS (SELECT *, greatest(0, seq // 700 - CASE WHEN seq % 31 = 0 THEN 1 ELSE 0 END)::INT AS generation FROM o),
n AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY at_us, seq) AS rn, g AS o FROM g),
st AS (SELECT DISTINCT key, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS at_us, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reasons, NULL::BIGINT AS retry_us, {_NO_BASE} AS b, NULL::INT AS gen, {_NO_HELD} AS h FROM n
UNION ALL
SELECT key, CASE WHEN ring THEN rn ELSE rn + 1 END, CASE WHEN ring THEN h.seq ELSE o.seq END, CASE WHEN ring THEN h.at_us ELSE o.at_us END, outcome, CASE WHEN ring THEN h.reasons WHEN outcome IN ('error', 'stale') THEN '' ELSE reasons END, CASE WHEN outcome = 'wait' THEN b.at_us + 1800000000 END,
  CASE WHEN ring AND h.published THEN {_based('h')} WHEN NOT ring AND outcome = 'fire' AND o.published THEN {_based('o')} ELSE b END, CASE WHEN ring OR stale THEN gen ELSE o.generation END,
  CASE WHEN outcome = 'fire' THEN {_NO_HELD} WHEN outcome = 'wait' THEN {{'seq': o.seq, 'at_us': b.at_us + 1800000000, 'valid_us': o.valid_us, 'data_revision': o.data_revision, 'risk_revision': o.risk_revision, 'avg_risk': o.avg_risk, 'max_risk': o.max_risk, 'event': o.event, 'published': o.published, 'reasons': reasons}} WHEN fresh THEN {_NO_HELD} ELSE h END
FROM (SELECT *, CASE WHEN ring THEN 'fire' WHEN stale THEN 'stale' WHEN b.at_us IS NOT NULL AND (o.data_revision < b.data_revision OR o.valid_us < b.valid_us) THEN 'error' WHEN reasons = '' THEN 'none' WHEN b.at_us IS NOT NULL AND o.at_us < b.at_us + 1800000000 AND NOT (o.manual OR o.hard) THEN 'wait' ELSE 'fire' END AS outcome
  FROM (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _ON.items())}) AS reasons
    FROM (SELECT key, rn, o, gen, h, ring, stale, fresh, CASE WHEN fresh THEN {_NO_BASE} ELSE b END AS b
      FROM (SELECT *, NOT ring AND coalesce(o.generation < gen, false) AS stale, NOT ring AND (gen IS NULL OR o.generation > gen) AS fresh
        FROM (SELECT st.key, st.rn, n.o, st.b, st.gen, st.h, n.key IS NULL AS done, st.h IS NOT NULL AND (n.key IS NULL OR st.h.at_us <= n.o.at_us) AS ring FROM st LEFT JOIN n ON n.key = st.key AND n.rn = st.rn + 1) WHERE ring OR NOT done)))))
SELECT key, seq, at_us, outcome, reasons, retry_us FROM st WHERE seq IS NOT NULL"""


@query(_TIMED)
def replan_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over generations, where one that waits fires at its retry time."""
    return replan.timed(generations(spark, sf_dir), 1 << 62, POLICY)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations with a generation that rises; some come from the one before."""
    g = F.floor(F.col("seq") / 700) - (F.col("seq") % 31 == 0).cast("int")
    return observations(spark, sf_dir).withColumn("generation", F.greatest(F.lit(0), g).cast("int"))


@query(_TIMED)
def replan_timer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from a stream whose rows come up to two days out of order."""
    from riskgrid.streaming.timers import stream_timed

    return stream_timed(generations(spark, sf_dir), 2 * 24 * 3_600_000_000, POLICY)


_FIELDS = ("at_us", "valid_us", "data_revision", "risk_revision", "avg_risk", "max_risk", "event")


@query(f"""WITH {OBSERVED}, b AS (SELECT *, {', '.join(f'lag({c}) OVER w AS b_{c}' for c in _FIELDS)}, lag(max_risk) OVER w >= 0.65 AS b_latched FROM o WINDOW w AS (PARTITION BY key ORDER BY at_us, seq)),
r AS (SELECT *, concat_ws(',', CASE WHEN valid_us > b_valid_us THEN 'time' END, CASE WHEN data_revision > b_data_revision OR risk_revision <> b_risk_revision THEN 'data' END,
    CASE WHEN hard OR (max_risk >= 0.65 AND NOT coalesce(b_latched, false)) OR greatest(abs(max_risk - b_max_risk), abs(avg_risk - b_avg_risk)) >= 0.10::DOUBLE THEN 'risk' END, CASE WHEN deviation_km >= 10 THEN 'deviation' END, CASE WHEN event IS NOT NULL AND event IS DISTINCT FROM b_event THEN 'event' END, CASE WHEN manual THEN 'manual' END) AS reasons,
    coalesce(data_revision < b_data_revision OR valid_us < b_valid_us, false) AS back FROM b),
d AS (SELECT *, CASE WHEN back THEN 'error' WHEN reasons = '' THEN 'none' WHEN b_at_us IS NOT NULL AND at_us < b_at_us + 1800000000 AND NOT (manual OR hard) THEN 'wait' ELSE 'fire' END AS outcome FROM r)
SELECT seq, outcome, CASE WHEN back THEN '' ELSE reasons END AS reasons, CASE WHEN outcome = 'wait' THEN b_at_us + 1800000000 END AS retry_us FROM d""")
def replan_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision for every observation against the one before it, as a service that replans all its runs at once makes them."""
    o = observations(spark, sf_dir)
    w = Window.partitionBy("key").orderBy("at_us", "seq")
    before = o.select(F.col("seq").alias("key"), *(F.lag(c).over(w).alias(f"b_{c}") for c in _FIELDS), (F.lag("max_risk").over(w) >= POLICY.high).alias("b_latched"))
    return service.tick(before, o.withColumn("key", F.col("seq")), POLICY).select("seq", "outcome", "reasons", "retry_us")


@query()
def replan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from a stream of observations; equal to the batch fold by test."""
    from riskgrid.streaming.triggers import stream_triggers

    return stream_triggers(observations(spark, sf_dir), POLICY)


@query("""WITH p AS (SELECT o_custkey, o_orderkey, 'scenario-' || (o_orderkey % 2) AS sc, (o_orderkey % 11 = 0)::INT AS g, 'corridor-1' AS co, o_totalprice AS cost, (o_orderkey % 97) / 100.0::DOUBLE AS mr FROM orders),
l AS (SELECT *, lag(o_orderkey) OVER w AS before, lag(sc) OVER w AS bsc, lag(g) OVER w AS bg, lag(cost) OVER w AS bcost, lag(mr) OVER w AS bmr FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
x AS (SELECT *, (bcost - cost) / greatest(abs(bcost), 1e-12) AS gain0, o_orderkey % 5 = 0 AS risky, o_orderkey % 23 = 0 AS forced FROM l)
SELECT o_custkey, o_orderkey,
 CASE WHEN before IS NULL THEN true WHEN bsc <> sc OR bg <> g THEN false WHEN forced THEN true WHEN risky AND mr <= bmr - 0.02::DOUBLE THEN true WHEN mr > bmr + 0.02::DOUBLE THEN false WHEN gain0 < 0.03 THEN false ELSE true END AS accepted,
 CASE WHEN before IS NULL THEN 'no current route' WHEN bsc <> sc THEN 'scenario mismatch' WHEN bg <> g THEN 'generation mismatch' WHEN forced THEN 'forced' WHEN risky AND mr <= bmr - 0.02::DOUBLE THEN 'less risk' WHEN mr > bmr + 0.02::DOUBLE THEN 'more risk' WHEN gain0 < 0.03 THEN 'too little gain' ELSE 'enough gain' END AS why,
 round(CASE WHEN before IS NULL THEN 1.0 WHEN bsc <> sc OR bg <> g THEN 0.0 ELSE gain0 END, 6) AS gain FROM x""")
def switch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    plan = F.struct(F.concat(F.lit("scenario-"), F.pmod(k, F.lit(2)).cast("string")).alias("scenario"), (k % 11 == 0).cast("int").alias("generation"), F.lit("corridor-1").alias("corridor"), F.lit("vessel-1").alias("vessel"), F.col("o_totalprice").alias("cost"), (F.pmod(k, F.lit(97)) / 100.0).alias("max_risk"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", plan.alias("candidate")).withColumn("current", F.lag("candidate").over(w))
    pairs = pairs.withColumns({"reasons": F.when(k % 5 == 0, F.array(F.lit("risk"))).otherwise(F.array().cast("array<string>")), "force": k % 23 == 0})
    return replan.switch_gate(pairs, POLICY).withColumn("gain", F.round("gain", 6))


COMMANDS = """k AS (SELECT user_id::VARCHAR AS log, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'publish' WHEN 'error' THEN 'cancel' ELSE 'activate' END AS kind, event_id FROM events),
l AS (SELECT *, max(CASE WHEN kind = 'activate' THEN event_id END) OVER (PARTITION BY log ORDER BY seq) AS own FROM k),
c AS (SELECT log, seq, kind, CASE WHEN kind <> 'activate' AND event_id % 4 = 0 THEN 'request-0' ELSE 'request-' || coalesce(own, 0) END AS request_id, own, 'plan-' || event_id AS plan_id FROM l)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publication command for every event, one log for each user; some carry a stale request."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "publish").when(F.col("event_type") == "error", "cancel").otherwise("activate")
    own = F.max(F.when(F.col("kind") == "activate", F.col("seq"))).over(Window.partitionBy("log").orderBy("seq"))
    c = e.select(F.col("user_id").cast("string").alias("log"), k.alias("seq"), kind.alias("kind")).withColumn("own", own)
    stale = (F.col("kind") != "activate") & (F.col("seq") % 4 == 0)
    request = F.when(stale, "request-0").otherwise(F.concat(F.lit("request-"), F.coalesce("own", F.lit(0)).cast("string")))
    return c.select(
        "log", "seq", "kind", F.lit("run-1").alias("run_id"), F.lit("scenario-1").alias("scenario_id"), F.lit(0).alias("generation"),
        *(F.lit("0" * 64).alias(d) for d in ("config_digest", "model_digest", "planner_digest")), request.alias("request_id"),
        F.when(stale, F.lit(0)).otherwise(F.coalesce("own", F.lit(0))).cast("long").alias("revision"), F.concat(F.lit("plan-"), F.col("seq").cast("string")).alias("plan_id"),
    )


_FENCE = f"""WITH {COMMANDS}, a AS (SELECT *, own IS NOT NULL AND request_id = 'request-' || own AS mine FROM c),
z AS (SELECT *, bool_or(kind = 'cancel' AND mine) OVER (PARTITION BY log, own ORDER BY seq) AS gone FROM a),
p AS (SELECT log, seq, plan_id, mine AND NOT gone AS accepted FROM z WHERE kind = 'publish')"""


@query(f"{_FENCE} SELECT * FROM p")
def publish_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.fence(commands(spark, sf_dir))


@query(f"{_FENCE} SELECT * FROM p")
def publish_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same publications, decided from whole tokens."""
    c = commands(spark, sf_dir)
    said = publish.replay(c).where("kind = 'publish'").join(c.select("log", "seq", "plan_id"), ["log", "seq"])
    return said.select("log", "seq", "plan_id", (F.col("outcome") == "ok").alias("accepted"))


@query(f"{_FENCE} SELECT log, arg_max(plan_id, seq) AS plan_id FROM p WHERE accepted GROUP BY log")
def latest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stands = publish.fence(commands(spark, sf_dir)).withColumns({"generation": F.lit(0), "revision": F.lit(0)})
    return publish.latest_plan(stands)
