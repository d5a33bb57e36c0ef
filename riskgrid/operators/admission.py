"""What a formal request must agree with before it is planned, as violation tables.

A run's context repeats ids, versions, times and content digests of the
scenario, corridor and vessel it was made for; a request repeats the digests
of the configuration of its entry, and asks for a window of frames at every
step of an interval. All comparisons are joins on ids and expressions in one
row; frames are aggregated by identity and time before they meet a request, so
a row of a window meets one row at most, whatever the number of revisions.

Defined cases: a null in a bound field differs from anything but null; a
definition or configuration that isn't there is one problem of its own, and no
field is compared with it; definitions must be unique by id; empty tables give
no rows; extra columns of definitions count for their digests, other ones are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.operators.validate import violations

#: The thirteen fields of a run's context that its definitions fix (fixed set).
BOUND = ("scenario_id", "scenario_version", "scenario_mode", "simulation_start", "simulation_end", "scenario_digest", "corridor_id", "corridor_version", "corridor_digest", "vessel_profile_id", "vessel_profile_version", "vessel_profile_digest", "config_digest")
#: Digests that a request shares with the configuration of its entry.
SHARED = ("planner_digest", "scenario_digest", "corridor_digest", "vessel_digest", "model_digest")


def content_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical text: JSON with sorted names and nulls."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def config_digest(scenario: Column, corridor: Column, vessel: Column, bundle_id: Column, bundle_digest: Column) -> Column:
    """Digest of all that a run is configured by; the definitions by their digests."""
    names = ("corridor", "dataset_bundle_digest", "dataset_bundle_id", "scenario", "vessel")
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in zip(names, (corridor, bundle_digest, bundle_id, scenario, vessel), strict=True))), {"ignoreNullFields": "false"}), 256)


def expected_contexts(runs: DataFrame, scenarios: DataFrame, corridors: DataFrame, vessels: DataFrame) -> DataFrame:
    """Every run (run_id, scenario, corridor, vessel: ids of definitions; dataset_bundle_id, dataset_bundle_digest) with the fields that its definitions fix in a struct ``bound``, NULL if one is missing, and what is wrong with the definitions in an array ``unfit``.

    scenarios: scenario_id, version, mode, corridor_id, vessel_profile_id,
    is_template, simulation_start, simulation_end; corridors: corridor_id,
    version; vessels: vessel_profile_id, version; and whatever else they say.
    """
    out = runs.select("run_id", "scenario", "corridor", "vessel", "dataset_bundle_id", "dataset_bundle_digest")
    for role, table, key in (("scenario", scenarios, "scenario_id"), ("corridor", corridors, "corridor_id"), ("vessel", vessels, "vessel_profile_id")):
        told = table.select(F.col(key).alias(role), F.struct(F.struct(*table.columns).alias("is"), content_digest(table.columns).alias("digest")).alias(f"__rg_{role}"))
        out = out.join(told, role, "left")
    s, c, v = (F.col(f"__rg_{role}") for role in ("scenario", "corridor", "vessel"))
    fixed = (
        (s["is"]["scenario_id"], s["is"]["version"], s["is"]["mode"], s["is"]["simulation_start"], s["is"]["simulation_end"], s["digest"])
        + (c["is"]["corridor_id"], c["is"]["version"], c["digest"], v["is"]["vessel_profile_id"], v["is"]["version"], v["digest"])
        + (config_digest(s["digest"], c["digest"], v["digest"], F.col("dataset_bundle_id"), F.col("dataset_bundle_digest")),)
    )
    there = s.isNotNull() & c.isNotNull() & v.isNotNull()
    unfit = {
        "no such scenario": s.isNull(),
        "no such corridor": c.isNull(),
        "no such vessel": v.isNull(),
        "scenario is not materialised": s.isNotNull() & (F.coalesce(s["is"]["is_template"], F.lit(True)) | s["is"]["simulation_start"].isNull() | s["is"]["simulation_end"].isNull()),
        "scenario is for another corridor": there & ~s["is"]["corridor_id"].eqNullSafe(c["is"]["corridor_id"]),
        "scenario is for another vessel": there & ~s["is"]["vessel_profile_id"].eqNullSafe(v["is"]["vessel_profile_id"]),
    }
    bound = F.when(there, F.struct(*(x.alias(n) for n, x in zip(BOUND, fixed, strict=True))))
    return out.select("run_id", bound.alias("bound"), F.array_compact(F.array(*(F.when(x, F.lit(n)) for n, x in unfit.items()))).alias("unfit"))


def context_problems(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, problem) of contexts (run_id and BOUND) that their definitions don't bear out."""
    met = contexts.select("run_id", F.struct(*BOUND).alias("__rg_own")).join(expected, "run_id", "left")
    own, bound = F.col("__rg_own"), F.col("bound")
    differs = [F.when(bound.isNotNull() & ~own[n].eqNullSafe(bound[n]), F.lit(f"{n} does not match")) for n in BOUND]
    unknown = F.when(F.col("unfit").isNull(), F.lit("no such run"))
    every = F.concat(F.array_compact(F.array(unknown, *differs)), F.coalesce("unfit", F.array().cast("array<string>")))
    return met.select("run_id", F.explode(every).alias("problem"))


def admission_problems(requests: DataFrame, configurations: DataFrame, frames: DataFrame, identity: list[str], interval: int) -> DataFrame:
    """(request, rule) of requests that a formal entry doesn't admit.

    requests: request, entry, provenance, SHARED, the identity's columns,
    start, steps (frames after the first; NULL like a negative number is no
    window) and as_of, in one unit of time with ``interval``. configurations:
    entry and SHARED. frames: identity, valid, as_of, provenance. The window
    has a frame at start, start + interval and so on, of which one revision
    at least was known at the request's as_of; all known ones must be formal.
    """
    at = frames.groupBy(*identity, "valid").agg(F.min("as_of").alias("__rg_known"), F.min(F.when(~F.col("provenance").eqNullSafe("formal"), F.col("as_of"))).alias("__rg_loose"))
    asked = requests.where("steps >= 0").select("request", *identity, "start", "as_of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps").cast("long"))).alias("__rg_k"))
    met = asked.withColumn("valid", F.col("start") + F.col("__rg_k") * F.lit(interval)).join(at, [*identity, "valid"], "left")
    window = met.groupBy("request").agg(F.count_if(F.coalesce(F.col("__rg_known") <= F.col("as_of"), F.lit(False))).alias("__rg_n"), F.bool_or(F.coalesce(F.col("__rg_loose") <= F.col("as_of"), F.lit(False))).alias("__rg_mixed"))
    known = configurations.select("entry", F.struct(*SHARED).alias("__rg_c"))
    rows = requests.join(known, "entry", "left").join(window, "request", "left")
    rules = {
        "not formal": ~F.col("provenance").eqNullSafe("formal"),
        "no such entry": F.col("__rg_c").isNull(),
        **{f"{n} differs from the entry's": F.col("__rg_c").isNotNull() & ~F.col(n).eqNullSafe(F.col("__rg_c")[n]) for n in SHARED},
        "no window": F.coalesce(F.col("steps") < 0, F.lit(True)),
        "window is not complete": (F.col("steps") >= 0) & (F.coalesce("__rg_n", F.lit(0)) < F.col("steps") + 1),
        "a frame is not formal": F.col("__rg_mixed"),
    }
    return violations(rows, rules, ["request"])
