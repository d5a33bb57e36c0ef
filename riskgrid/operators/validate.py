"""Data contracts as violation tables: one row for each broken rule, none if all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import values
from riskgrid.functions.motion import risk_level


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) for every rule whose column is true; one pass over the rows."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def _outside(x: Column, low: float, high: float) -> Column:
    return x.isNull() | F.isnan(x.cast("double")) | (x < low) | (x > high)


def payload_rules(level: str | None = None) -> dict[str, Column]:
    """Rules for the cells of a cube: unknown risk only where hard or without confidence."""
    risk, confidence = F.col("risk"), F.col("confidence")
    known = risk.isNotNull() & ~F.isnan(risk)
    out = {
        "risk outside [0, 1]": known & ((risk < 0) | (risk > 1)),
        "unknown risk at a navigable cell": ~known & ~(F.coalesce(F.col("hard"), F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) == 0)),
        "confidence outside [0, 1]": _outside(confidence, 0, 1),
        "factor outside (0, 1]": F.col("factor").isNotNull() & ((F.col("factor") <= 0) | (F.col("factor") > 1)),
        "hard is missing": F.col("hard").isNull(),
        "latitude outside [-90, 90]": _outside(F.col("lat"), -90, 90),
        "longitude outside [-180, 180]": _outside(F.col("lon"), -180, 180),
    }
    if level:
        out["level does not follow risk"] = F.when(known, F.col(level) != risk_level(risk)).otherwise(F.col(level) != 5)
    return out


def frame_rules() -> dict[str, Column]:
    """Rules for frame headers."""
    return {
        "risk_id": ~values.is_id(F.col("risk_id")),
        "config_digest": ~values.is_sha256(F.col("config_digest")),
        "model_digest": ~values.is_sha256(F.col("model_digest")),
        "generation is negative": F.col("generation").isNull() | (F.col("generation") < 0),
        "known after it was made": F.col("as_of") > F.col("generated"),
    }


def source_rules(sources: str = "sources", as_of: str = "as_of") -> dict[str, Column]:
    """Rules for the array of a formal frame's sources."""
    s = F.col(sources)
    return {
        "no source": F.coalesce(F.size(s), F.lit(0)) < 1,
        "blank source field": F.exists(s, lambda x: (F.trim(x["source_id"]) == "") | (F.trim(x["data_id"]) == "") | ~values.is_sha256(x["checksum"])),
        "issued after it was known": F.exists(s, lambda x: x["issue_time"] > F.col(as_of)),
    }


def not_ascending(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Positions at which an axis does not rise strictly."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select(*keys, order, value, F.lag(value).over(w).alias("before")).where(F.col("before") >= F.col(value))


def axis_mismatch(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Axis values that only one of two grids has; empty if they are the same."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("only", F.lit("left")).unionByName(b.join(a, column, "left_anti").withColumn("only", F.lit("right")))


def observation_rules() -> dict[str, Column]:
    a, m, d = F.col("avg_risk"), F.col("max_risk"), F.col("deviation_km")
    return {
        "avg_risk outside [0, 1]": _outside(a, 0, 1),
        "max_risk outside [0, 1]": _outside(m, 0, 1),
        "avg_risk over max_risk": a > m,
        "deviation is negative": d.isNull() | (d < 0),
        "data_revision is negative": F.col("data_revision").isNull() | (F.col("data_revision") < 0),
        "risk_revision is blank": F.coalesce(F.trim("risk_revision"), F.lit("")) == "",
    }


def plan_rules(steps: DataFrame, key: str = "route") -> DataFrame:
    """Violations of route plans given as ordered steps (route, step, eta_us, risk, max_risk, hard)."""
    w = Window.partitionBy(key).orderBy("step")
    seen = steps.withColumn("__rg_b", F.lag("eta_us").over(w))
    by = seen.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("__rg_b") >= F.col("eta_us")).alias("late"),
        F.count_if(F.col("risk") > F.col("max_risk")).alias("over"),
        F.count_if(F.col("hard")).alias("hard"),
    )
    rules = {"fewer than two waypoints": F.col("n") < 2, "ETAs do not rise": F.col("late") > 0, "average over maximum": F.col("over") > 0, "crosses a hard cell": F.col("hard") > 0}
    return violations(by, rules, [key])


def policy_rules() -> dict[str, Column]:
    """Rules for replanning thresholds."""
    names = ("change", "high", "clear", "gain", "hysteresis")
    out = {f"{c} outside [0, 1]": _outside(F.col(c), 0, 1) for c in names}
    return out | {"clear over high": F.col("clear") > F.col("high"), "deviation_km is negative": F.col("deviation_km") < 0, "interval is negative": F.col("min_interval_us") < 0}

