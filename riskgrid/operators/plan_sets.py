"""Complete sets of layered plans as documents: content ids, references, and what is wrong with a set.

A set has a plan for each layer and objective. A plan's id is the digest of
what it says; plans of the nearer layers name the full recommended plan, so
the full layer is made first and the others with its ids. A set's id is the
digest of its plans' digests. A set comes out whole or not at all. Twelve
plans are all that a group ever holds.

Defined cases: a set that lacks a plan, or a header, gives no document; a
document that isn't JSON is reported as such; no steps give no rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.motion import OBJECTIVES
from riskgrid.functions.values import canonical_bytes
from riskgrid.operators import documents
from riskgrid.operators.codec import plan_digest, set_digest, strict_fields
from riskgrid.operators.layers import LAYERS
from riskgrid.operators.shared import folder, written

#: Versions of layered plans and sets, and how their ids begin (fixed values).
PLAN_VERSION, SET_VERSION = "cd.route-plan.v3", "cd.layer-set.v3"
PLAN_ID, SET_ID = "route-v3-sha256-", "layer-set-sha256-"
MORE = ("layer", "reference_plan_id", "focus_from_h", "focus_to_h")
PLAN_FIELDS = frozenset({"schema_version", *documents.HEADER, *MORE, "waypoints", "metrics", "replan_reasons", "source_risk_ids", "destination_reached"})
SET_FIELDS = frozenset({"schema_version", "layer_set_id", "set", "plans"})


def _identified(text: str) -> Column:
    """The plan with the id that follows from its content."""

    @F.pandas_udf("struct<document:string,plan_id:string,digest:string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            plan = json.loads(text)
            digest = plan_digest(plan)
            plan["plan_id"] = PLAN_ID + digest
            rows.append((canonical_bytes(plan).decode(), plan["plan_id"], digest))
        return pd.DataFrame(rows, columns=["document", "plan_id", "digest"])

    return of(F.col(text))


def layered_plans(steps: DataFrame, cells: DataFrame, headers: DataFrame, windows: DataFrame) -> DataFrame:
    """(set_id, layer, objective, plan_id, reference_plan_id, digest, document) of every route.

    steps: as ``layers.layered_set`` gives them. headers: set_id and the
    columns of a plan's header but plan_id and objective_mode. windows: set_id,
    layer, focus_from_h, focus_to_h.
    """
    base = folder(steps.sparkSession, "plan-set")
    keyed = steps.withColumn("search", F.concat_ws("/", "set_id", "layer", "objective"))
    names = keyed.select("search", "set_id", "layer", "objective").distinct()
    head = names.join(headers, "set_id").join(windows, ["set_id", "layer"])
    head = head.withColumns({"plan_id": F.lit(None).cast("string"), "objective_mode": F.col("objective")})
    keyed = keyed.drop("set_id", "layer", "objective")

    def made(rows: DataFrame, path: str) -> DataFrame:
        text = documents.plan_texts(keyed, cells, rows.select("search", *documents.HEADER, *MORE), more=MORE, version=PLAN_VERSION)
        out = text.select("search", _identified("text").alias("d")).join(rows.select("search", "set_id", "layer", "objective", "reference_plan_id"), "search")
        return written(out.select("set_id", "layer", "objective", "d.plan_id", "reference_plan_id", "d.digest", "d.document"), path)

    top = made(head.where(F.col("layer") == LAYERS[0][0]).withColumn("reference_plan_id", F.lit(None).cast("string")), f"{base}/full")
    named = top.where("objective = 'recommended'").select("set_id", F.col("plan_id").alias("reference_plan_id"))
    return top.unionByName(made(head.where(F.col("layer") != LAYERS[0][0]).join(named, "set_id"), f"{base}/lower"))


def set_documents(plans: DataFrame) -> DataFrame:
    """(set_id, layer_set_id, document) of every complete set of ``layered_plans``."""

    @F.pandas_udf("struct<layer_set_id:string,document:string>")
    def whole(names: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = []
        for name, docs in zip(names, parts, strict=True):
            own = [json.loads(d) for d in docs]
            found = SET_ID + set_digest(own, set=name)
            rows.append((found, canonical_bytes({"schema_version": SET_VERSION, "layer_set_id": found, "set": name, "plans": own}).decode()))
        return pd.DataFrame(rows, columns=["layer_set_id", "document"])

    rank = F.create_map(*(F.lit(x) for i, (n, _) in enumerate(LAYERS) for x in (n, i)))
    one = plans.dropDuplicates(["set_id", "layer", "objective"]).withColumn("p", F.struct(rank[F.col("layer")].alias("rank"), "objective", "document"))
    sets = one.groupBy("set_id").agg(F.sort_array(F.collect_list("p")).alias("ps")).where(F.size("ps") == len(LAYERS) * len(OBJECTIVES))
    out = sets.select("set_id", whole("set_id", F.transform("ps", lambda p: p["document"])).alias("d"))
    return out.select("set_id", "d.layer_set_id", "d.document")


def set_problems(sets: DataFrame) -> DataFrame:
    """(set_id, problem) of set documents that don't hold: fields missing or unknown, ids that don't follow from the content, plans missing, twice or with another reference."""

    @F.pandas_udf("array<string>")
    def problems(texts: pd.Series) -> pd.Series:
        return pd.Series([_problems(t) for t in texts])

    return sets.select("set_id", F.explode(problems("document")).alias("problem"))


def _problems(text: str | None) -> list[str]:
    try:
        d = json.loads(text)
    except (TypeError, ValueError):
        return ["not JSON"]
    wrong = strict_fields(d, SET_FIELDS, "set")
    if wrong:
        return wrong
    for p in d["plans"]:
        wrong += strict_fields(p, PLAN_FIELDS, "plan")
    if wrong:
        return sorted(set(wrong))
    wrong += [f"{p['layer']}/{p['objective_mode']}: id does not match content" for p in d["plans"] if p["plan_id"] != PLAN_ID + plan_digest(p)]
    if sorted((p["layer"], p["objective_mode"]) for p in d["plans"]) != sorted((n, o) for n, _ in LAYERS for o in OBJECTIVES):
        wrong.append("not every layer and objective once")
    full = [p["plan_id"] for p in d["plans"] if p["layer"] == LAYERS[0][0] and p["objective_mode"] == "recommended"]
    wrong += [f"{p['layer']}/{p['objective_mode']}: another reference" for p in d["plans"] if p["reference_plan_id"] != (None if p["layer"] == LAYERS[0][0] else (full or [None])[0])]
    if d["layer_set_id"] != SET_ID + set_digest(d["plans"], set=d["set"]):
        wrong.append("set id does not match content")
    return wrong


def plan_of(plans: DataFrame, layer: str, objective: str = "recommended") -> DataFrame:
    """The plan of a layer and objective of each set."""
    return plans.where((F.col("layer") == layer) & (F.col("objective") == objective))
