"""Route plans as documents: canonical JSON out of routes, rows out of JSON, and what is wrong with a document.

A document is made of column expressions; only its canonical text (sorted
keys, no blanks, numbers as Python prints them) and its digest are made in
Python, row by row of an Arrow batch. A route's steps are bounded by its
horizon, so a document fits in a row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.values import canonical_bytes, utc_micros, utc_text
from riskgrid.operators import routes
from riskgrid.operators.codec import plan_digest
from riskgrid.operators.validate import violations

VERSION = "cd.route-plan.v2"
#: Fields that come with the request (fixed names), and of them those that are times.
HEADER = ("run_id", "scenario_id", "corridor_id", "vessel_profile_id", "config_digest", "model_config_digest", "planner_config_digest", "provenance", "generation_id", "planning_request_id", "input_revision", "plan_id", "plan_version", "generated_at", "as_of_time", "start_time", "objective_mode", "plan_kind", "planner_version")
TIMES = ("generated_at", "as_of_time", "start_time")
WHOLE = ("generation_id", "input_revision")
#: Totals of a route in a document (fixed names), by the names they have in ``routes.totals``.
METRICS = {"distance_km": "km", "eta_hours": "hours", "avg_risk": "average_risk", "max_risk": "max_risk", "integrated_risk_hours": "integrated", "minimum_confidence": "confidence", "hard_constraint_violations": "violations", "turn_count": "turns", "expanded_nodes": "expanded", "compute_ms": "compute_ms", "objective_cost": "cost"}
COUNTS = ("hard_constraint_violations", "turn_count", "expanded_nodes")


def plan_texts(steps: DataFrame, cells: DataFrame, headers: DataFrame, key: str = "search", more: tuple[str, ...] = (), version: str = VERSION) -> DataFrame:
    """(key, text): a JSON object of every route in ``steps`` that has a header; ``more`` names further columns of the headers to put in."""
    plans = routes.plans(steps, cells, key).join(routes.source_ids(_named(steps), key), key).join(headers, key)
    have = set(plans.columns)
    plans = plans.withColumns(
        {
            "integrated": F.col("average_risk") * F.col("hours"),
            "violations": F.lit(0),
            "expanded": F.col("expanded") if "expanded" in have else F.lit(0),
            "compute_ms": F.col("compute_ms") if "compute_ms" in have else F.lit(0.0),
            "replan_reasons": F.col("replan_reasons") if "replan_reasons" in have else F.array().cast("array<string>"),
        }
    )
    point = F.transform("waypoints", lambda p: F.struct(p["lon"].alias("longitude"), p["lat"].alias("latitude"), utc_text(p["eta_us"]).alias("eta"), p["mps"].alias("recommended_speed_mps")))
    fields = [F.lit(version).alias("schema_version"), *(utc_text(F.col(c)).alias(c) if c in TIMES else F.col(c) for c in HEADER), *more, point.alias("waypoints")]
    fields += [F.struct(*(F.col(v).alias(k) for k, v in METRICS.items())).alias("metrics"), "replan_reasons", F.col("source_ids").alias("source_risk_ids"), F.lit(True).alias("destination_reached")]
    return plans.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("text"))


def _canonical(text: str) -> Column:
    @F.pandas_udf("struct<document:string,content_digest:string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        # one document at a time: read, it takes many times its text
        rows = ((canonical_bytes(d).decode(), plan_digest(d)) for d in map(json.loads, texts))
        return pd.DataFrame(rows, columns=["document", "content_digest"])

    return of(F.col(text))


def plan_documents(steps: DataFrame, cells: DataFrame, headers: DataFrame, key: str = "search") -> DataFrame:
    """(search, document, content_digest) of every route in ``steps`` that has a header.

    ``headers`` has the columns of HEADER (times in epoch microseconds), and
    may have expanded, compute_ms and replan_reasons (0 and none where missing).
    The digest leaves out ids, request, clock and computing time.
    """
    made = plan_texts(steps, cells, headers, key).select(key, _canonical("text").alias("d"))
    return made.select(key, "d.document", "d.content_digest")


def _named(steps: DataFrame) -> DataFrame:
    """Steps with the ids of the frames they used; a cube without frame ids has its frame numbers for ids."""
    if "sources" in steps.columns:
        return steps
    return steps.withColumn("sources", F.transform(F.sequence("frame_low", "frame_high"), lambda k: F.concat(F.lit("frame-"), k.cast("string"))))


_SCHEMA = (
    "schema_version string, "
    + ", ".join(f"{c} {'bigint' if c in WHOLE else 'string'}" for c in HEADER)
    + ", waypoints array<struct<longitude:double,latitude:double,eta:string,recommended_speed_mps:double>>, metrics struct<"
    + ",".join(f"{k}:{'bigint' if k in COUNTS else 'double'}" for k in METRICS)
    + ">, replan_reasons array<string>, source_risk_ids array<string>, destination_reached boolean"
)


def read_plans(documents: DataFrame, key: str = "search") -> DataFrame:
    """One row for each document (key, document): its fields, times in epoch microseconds; unknown fields are passed over, a missing version or destination_reached has its default."""
    d = documents.select(key, F.from_json("document", _SCHEMA).alias("d")).select(key, "d.*")
    point = F.transform("waypoints", lambda p: F.struct(p["longitude"].alias("lon"), p["latitude"].alias("lat"), utc_micros(p["eta"]).alias("eta_us"), p["recommended_speed_mps"].alias("mps")))
    return d.withColumns({c: utc_micros(F.col(c)) for c in TIMES} | {"waypoints": point, "schema_version": F.coalesce("schema_version", F.lit(VERSION)), "destination_reached": F.coalesce("destination_reached", F.lit(True)), "replan_reasons": F.coalesce("replan_reasons", F.array().cast("array<string>"))})


def plan_violations(plans: DataFrame, key: str = "search") -> DataFrame:
    """Broken rules of plans as ``read_plans`` gives them: missing fields, and what a plan must hold."""
    p, m = F.col("waypoints"), F.col("metrics")
    last = F.element_at(p, -1)["eta_us"]
    hours = (last - F.col("start_time")) / 3.6e9
    rises = F.forall(F.arrays_zip(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("a"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("b")), lambda x: x["a"]["eta_us"] < x["b"]["eta_us"])
    rules: dict[str, Column] = {f"{c} is missing": F.col(c).isNull() for c in (*HEADER, "waypoints", "metrics", "source_risk_ids")}
    rules |= {f"{c} is missing": m.isNotNull() & m[c].isNull() for c in METRICS}
    rules |= {
        "fewer than two waypoints": F.size(p) < 2,
        "a waypoint has a missing field": F.exists(p, lambda x: x["lon"].isNull() | x["lat"].isNull() | x["eta_us"].isNull() | x["mps"].isNull()),
        "the first ETA is not the start": p[0]["eta_us"] != F.col("start_time"),
        "ETAs do not rise": ~rises,
        "eta_hours is not the last ETA": F.abs(m["eta_hours"] - hours) > F.greatest(F.lit(1 / 3600), F.abs(hours) * 1e-6),
        "average over maximum": m["avg_risk"] > m["max_risk"],
        "crosses a hard cell": m["hard_constraint_violations"] != 0,
    }
    return violations(plans, rules, [key])
