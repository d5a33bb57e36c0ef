"""Queries on what formal requests are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.operators import admission
from riskgrid.plans.registry import FRAMES, T0, query
from riskgrid.plans.windows import frames
from riskgrid.sources.cube import table

HOUR = 3_600_000_000


def named(prefix: str, key, n: int | None = None):
    return F.concat(F.lit(prefix), (key if n is None else F.pmod(key, F.lit(n))).cast("string"))


def definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A scenario for every nation, a corridor for every region, a vessel for every supplier."""
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    start = F.when(n % 11 != 0, F.lit(T0) + n * F.lit(HOUR))
    scenarios = table(spark, sf_dir, "nation").select(
        named("scenario-", n).alias("scenario_id"),
        named("v", n, 3).alias("version"),
        F.when(n % 2 == 0, "historical").otherwise("live").alias("mode"),
        named("corridor-", F.col("n_regionkey")).alias("corridor_id"),
        named("vessel-", n, 5).alias("vessel_profile_id"),
        (n % 13 == 0).alias("is_template"),
        start.cast("long").alias("simulation_start"),
        (start + F.lit(96 * HOUR)).cast("long").alias("simulation_end"),
        F.col("n_name").alias("title"),
    )
    corridors = table(spark, sf_dir, "region").select(named("corridor-", F.col("r_regionkey")).alias("corridor_id"), F.lit("v1").alias("version"), F.col("r_name").alias("title"))
    vessels = table(spark, sf_dir, "supplier").select(named("vessel-", s).alias("vessel_profile_id"), named("v", s, 2).alias("version"), F.pmod(s, F.lit(7)).cast("int").alias("ice_class"))
    return scenarios, corridors, vessels


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every order: mostly a scenario with its own corridor and vessel."""
    k = F.col("o_orderkey")
    n = F.pmod(k, F.lit(26))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_regionkey")
    out = table(spark, sf_dir, "orders").select(k.alias("k"), n.cast("long").alias("n")).join(F.broadcast(nation), "n", "left")
    return out.select(
        "k",
        named("run-", F.col("k")).alias("run_id"),
        named("scenario-", F.col("n")).alias("scenario"),
        named("corridor-", F.when(F.col("k") % 19 == 0, F.lit(9)).when(F.col("k") % 17 == 0, F.lit(0)).otherwise(F.coalesce("n_regionkey", F.lit(0)))).alias("corridor"),
        named("vessel-", F.when(F.col("k") % 23 == 0, F.lit(0)).otherwise(F.pmod("n", F.lit(5)))).alias("vessel"),
        named("bundle-", F.col("k"), 4).alias("dataset_bundle_id"),
        F.lit("b" * 64).alias("dataset_bundle_digest"),
    )


#: Thirteen of 29 orders tell one field wrongly, that of their number modulo 29.
_EXPECTED = f"""sc AS (SELECT 'scenario-' || n_nationkey AS scenario_id, 'v' || (n_nationkey % 3) AS version, CASE WHEN n_nationkey % 2 = 0 THEN 'historical' ELSE 'live' END AS mode, 'corridor-' || n_regionkey AS corridor_id, 'vessel-' || (n_nationkey % 5) AS vessel_profile_id,
    n_nationkey % 13 = 0 AS is_template, CASE WHEN n_nationkey % 11 <> 0 THEN {T0} + n_nationkey::BIGINT * {HOUR} END AS simulation_start, CASE WHEN n_nationkey % 11 <> 0 THEN {T0} + n_nationkey::BIGINT * {HOUR} + {96 * HOUR} END AS simulation_end, n_name AS title FROM nation),
sd AS (SELECT *, sha256('{{"corridor_id":"' || corridor_id || '","is_template":' || is_template || ',"mode":"' || mode || '","scenario_id":"' || scenario_id || '","simulation_end":' || coalesce(simulation_end::VARCHAR, 'null') || ',"simulation_start":' || coalesce(simulation_start::VARCHAR, 'null') || ',"title":"' || title || '","version":"' || version || '","vessel_profile_id":"' || vessel_profile_id || '"}}') AS digest FROM sc),
cd AS (SELECT 'corridor-' || r_regionkey AS corridor_id, sha256('{{"corridor_id":"corridor-' || r_regionkey || '","title":"' || r_name || '","version":"v1"}}') AS digest FROM region),
vd AS (SELECT 'vessel-' || s_suppkey AS vessel_profile_id, 'v' || (s_suppkey % 2) AS version, sha256('{{"ice_class":' || (s_suppkey % 7) || ',"version":"v' || (s_suppkey % 2) || '","vessel_profile_id":"vessel-' || s_suppkey || '"}}') AS digest FROM supplier),
r AS (SELECT o_orderkey AS k, 'run-' || o_orderkey AS run_id, 'scenario-' || (o_orderkey % 26) AS scenario, 'corridor-' || CASE WHEN o_orderkey % 19 = 0 THEN 9 WHEN o_orderkey % 17 = 0 THEN 0 ELSE coalesce(n_regionkey, 0) END AS corridor, 'vessel-' || CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE o_orderkey % 26 % 5 END AS vessel, 'bundle-' || (o_orderkey % 4) AS bundle FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 26),
x AS (SELECT r.*, s, c, v, s.scenario_id IS NOT NULL AS has_s, c.corridor_id IS NOT NULL AS has_c, v.vessel_profile_id IS NOT NULL AS has_v FROM r LEFT JOIN sd s ON s.scenario_id = r.scenario LEFT JOIN cd c ON c.corridor_id = r.corridor LEFT JOIN vd v ON v.vessel_profile_id = r.vessel)"""


@query(f"""WITH {_EXPECTED}
SELECT run_id, problem FROM x, LATERAL (VALUES ('no such scenario', NOT has_s), ('no such corridor', NOT has_c), ('no such vessel', NOT has_v), ('scenario is not materialised', has_s AND (s.is_template OR s.simulation_start IS NULL)),
    ('scenario is for another corridor', has_s AND has_c AND has_v AND s.corridor_id <> c.corridor_id), ('scenario is for another vessel', has_s AND has_c AND has_v AND s.vessel_profile_id <> v.vessel_profile_id)) AS p(problem, broken) WHERE broken
UNION ALL SELECT run_id, ['{"', '".join(admission.BOUND)}'][(k % 29 + 1)::INT] || ' does not match' FROM x WHERE k % 29 < 13 AND has_s AND has_c AND has_v""")
def run_context_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose contexts tell one field wrongly, or whose definitions don't fit."""
    made = runs(spark, sf_dir)
    expected = admission.expected_contexts(made, *definitions(spark, sf_dir))
    told = made.select("k", "run_id").join(expected.select("run_id", "bound"), "run_id")
    wrong = lambda n: F.when(F.col("k") % 29 == n, F.lit(True)).otherwise(F.lit(False))
    fields = []
    for i, name in enumerate(admission.BOUND):
        value = F.col(f"bound.{name}")
        other = F.coalesce(value + 1, F.lit(0)) if name in ("simulation_start", "simulation_end") else F.concat(F.lit("not "), value)
        fields.append(F.when(wrong(i), other).otherwise(value).alias(name))
    return admission.context_problems(told.select("run_id", *fields), expected)


@query(f"""WITH {_EXPECTED} SELECT run_id, simulation_start, simulation_end, scenario_digest, config_digest FROM (SELECT run_id, s.simulation_start AS simulation_start, s.simulation_end AS simulation_end, s.digest AS scenario_digest,
    sha256('{{"corridor":"' || c.digest || '","dataset_bundle_digest":"{"b" * 64}","dataset_bundle_id":"' || bundle || '","scenario":"' || s.digest || '","vessel":"' || v.digest || '"}}') AS config_digest FROM x WHERE has_s AND has_c AND has_v)""")
def run_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and digests that the definitions fix for every run."""
    out = admission.expected_contexts(runs(spark, sf_dir), *definitions(spark, sf_dir)).where("bound is not null")
    return out.select("run_id", *(f"bound.{n}" for n in ("simulation_start", "simulation_end", "scenario_digest", "config_digest")))


#: Weeks that requests ask for after their first, and hours of a week.
WEEKS, WEEK = 2, 168
FIRST = 219_072


@query(f"""WITH {FRAMES}, p AS (SELECT *, CASE WHEN generated % 41 = 0 THEN 'development' ELSE 'formal' END AS provenance FROM frames),
q AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS request, 'run-' || (o_custkey % 20) AS run_id, 'corridor-' || (o_orderkey % 3) AS corridor_id, (o_orderkey % 2)::INT AS generation, {FIRST} + (o_orderkey % 200)::BIGINT * {WEEK} AS start, CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN -1 ELSE o_orderkey % {WEEKS + 1} END AS steps, {FIRST} + (o_orderkey % 200 + 3)::BIGINT * {WEEK} AS as_of FROM orders),
a AS (SELECT run_id, corridor_id, generation, valid, min(as_of) AS known, min(as_of) FILTER (provenance <> 'formal') AS loose FROM p GROUP BY 1, 2, 3, 4),
w AS (SELECT request, count(*) FILTER (known <= q.as_of) AS n, coalesce(bool_or(loose <= q.as_of), false) AS mixed FROM (SELECT *, unnest(generate_series(0, steps)) AS j FROM q WHERE steps >= 0) q LEFT JOIN a ON a.run_id = q.run_id AND a.corridor_id = q.corridor_id AND a.generation = q.generation AND a.valid = q.start + j * {WEEK} GROUP BY 1)
SELECT q.request, rule FROM q LEFT JOIN w USING (request), LATERAL (VALUES ('not formal', k % 43 = 0), ('no such entry', k % 8 = 7), {", ".join(f"('{n} differs from the entry''s', k % 8 <> 7 AND k % 47 = {i})" for i, n in enumerate(admission.SHARED))},
    ('no window', coalesce(steps < 0, true)), ('window is not complete', steps >= 0 AND n < steps + 1), ('a frame is not formal', mixed)) AS v(rule, broken) WHERE broken""")
def admission_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every order against its entry's configuration and the frames of its identity."""
    k = F.col("o_orderkey")
    entry = F.pmod(k, F.lit(8))
    digests = lambda key: [F.sha2(F.concat(F.lit(f"{n}-"), key.cast("string")), 256).alias(n) for n in admission.SHARED]
    shared = [F.when(k % 47 == i, F.lit("another")).otherwise(d).alias(n) for i, (n, d) in enumerate(zip(admission.SHARED, digests(entry), strict=True))]
    start = F.lit(FIRST) + F.pmod(k, F.lit(200)).cast("long") * F.lit(WEEK)
    asked = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("request"),
        entry.cast("long").alias("entry"),
        F.when(k % 43 == 0, "development").otherwise("formal").alias("provenance"),
        *shared,
        named("run-", F.col("o_custkey"), 20).alias("run_id"),
        named("corridor-", k, 3).alias("corridor_id"),
        F.pmod(k, F.lit(2)).cast("int").alias("generation"),
        start.alias("start"),
        F.when(k % 37 == 0, F.lit(None)).when(k % 31 == 0, F.lit(-1)).otherwise(F.pmod(k, F.lit(WEEKS + 1))).cast("long").alias("steps"),
        (start + 3 * WEEK).alias("as_of"),
    )
    entries = spark.range(7).select(F.col("id").alias("entry"), *digests(F.col("id")))
    known = frames(spark, sf_dir).withColumn("provenance", F.when(F.col("generated") % 41 == 0, "development").otherwise("formal"))
    return admission.admission_problems(asked, entries, known, ["run_id", "corridor_id", "generation"], WEEK)
