"""Planner, replanning and vessel settings from TOML files, as options of the operators.

Files are read by Spark, so any store it knows will do. What a file may hold
is a table of fields: kind, default and condition; everything wrong with a
file is told at once. Settings of a run are a few numbers: they go into the
plans as literals.
"""

from __future__ import annotations

import math
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from riskgrid.functions.motion import OBJECTIVES, Vessel, Weights
from riskgrid.functions.values import digest
from riskgrid.operators.replan import Policy

#: Names that may become part of a path.
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,127}")
REQUIRED = object()

Field = tuple[type, Any, Callable[[Any], bool], str]
_SHARE: tuple[Callable[[Any], bool], str] = (lambda v: 0 <= v <= 1, "must lie in [0, 1]")
_POSITIVE: tuple[Callable[[Any], bool], str] = (lambda v: v > 0, "must be positive")
_TEXT: tuple[Callable[[Any], bool], str] = (lambda v: bool(v.strip()), "must not be blank")

PLANNER: dict[str, Field] = {
    "schema_version": (str, "planner-config.v1", lambda v: v == "planner-config.v1", "must be planner-config.v1"),
    "time_bucket_minutes": (int, 60, *_POSITIVE),
    "connectivity": (int, 8, lambda v: v in (4, 8), "must be 4 or 8"),
    "edge_sample_count": (int, 3, lambda v: v >= 3 and v % 2 == 1, "must be odd and 3 at least"),
    "max_search_hours": (int, 216, lambda v: 0 < v <= 216, "must be positive and 216 at most"),
    "max_risk_frame_gap_minutes": (int, 180, *_POSITIVE),
    "minimum_confidence": (float, 0.10, *_SHARE),
    "allow_waiting": (bool, False, lambda v: not v, "must be false: a vessel can't wait"),
}
REPLANNING: dict[str, Field] = {
    "schema_version": (str, "replanning-config.v1", lambda v: v == "replanning-config.v1", "must be replanning-config.v1"),
    "minimum_interval_minutes": (int, 60, lambda v: v >= 0, "must not be negative"),
    "route_switch_gain_threshold": (float, 0.05, *_SHARE),
    "risk_trigger_threshold": (float, 0.65, *_SHARE),
    "deviation_trigger_km": (float, 10.0, *_POSITIVE),
    "hysteresis": (float, 0.03, *_SHARE),
}
VESSEL: dict[str, Field] = {
    "schema_version": (str, REQUIRED, lambda v: v == "c.vessel-model-config.v1", "must be c.vessel-model-config.v1"),
    "vessel_profile_id": (str, REQUIRED, *_TEXT),
    "vessel_profile_version": (str, REQUIRED, *_TEXT),
    "economic_speed_knots": (float, REQUIRED, *_POSITIVE),
    "minimum_steerage_speed_knots": (float, REQUIRED, *_POSITIVE),
    "maximum_speed_knots": (float, REQUIRED, *_POSITIVE),
    "minimum_speed_factor": (float, REQUIRED, lambda v: 0 < v <= 1, "must lie in (0, 1]"),
    "turn_radius_m": (float, REQUIRED, *_POSITIVE),
    "under_keel_clearance_m": (float, REQUIRED, *_POSITIVE),
    "bathymetry_hard_constraint_enabled": (bool, REQUIRED, lambda v: not v, "must be false: depths are no constraint"),
    "calibration_status": (str, REQUIRED, *_TEXT),
    "source_notes": (str, REQUIRED, *_TEXT),
}
#: Weights of an objective, by their names in ``Weights``.
WEIGHTS = {"travel_time": "time", "risk": "risk", "distance": "distance", "turn": "turn", "uncertainty": "uncertainty"}


class ConfigError(ValueError):
    """A file that is missing, isn't TOML, or holds what it must not."""


@dataclass(frozen=True)
class Settings:
    vessel: Vessel
    objectives: dict[str, Weights]
    policy: Policy
    planner: dict[str, Any]
    digest: str

    def search_options(self) -> dict[str, Any]:
        """Options of ``search.routes`` and what is built on it."""
        p = self.planner
        return {"vessel": self.vessel, "objectives": self.objectives, "min_confidence": p["minimum_confidence"], "max_gap_us": p["max_risk_frame_gap_minutes"] * 60_000_000, "connectivity": p["connectivity"], "n": p["edge_sample_count"]}

    @property
    def bucket_us(self) -> int:
        return self.planner["time_bucket_minutes"] * 60_000_000


def checked(found: dict[str, Any], fields: dict[str, Field], name: str) -> dict[str, Any]:
    """The fields of a file with defaults filled in; raises with all that is wrong."""
    wrong = [f"{k} is unknown" for k in sorted(set(found) - set(fields))]
    out = {}
    for k, (kind, default, holds, says) in fields.items():
        v = found.get(k, default)
        if kind is float and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if v is REQUIRED:
            wrong.append(f"{k} is missing")
        elif type(v) is not kind or (kind is float and not math.isfinite(v)):
            wrong.append(f"{k} must be of type {kind.__name__}")
        elif not holds(v):
            wrong.append(f"{k} {says}")
        out[k] = v
    if wrong:
        raise ConfigError(f"{name}: {'; '.join(wrong)}")
    return out


def read_toml(spark: SparkSession, root: str, section: str, name: str) -> dict[str, Any]:
    if not NAME.fullmatch(name):
        raise ConfigError(f"not a name: {name!r}")
    path = f"{root}/{section}/{name}.toml"
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
        return tomllib.loads(rows[0].value) if rows else {}
    except AnalysisException as e:
        raise ConfigError(f"no such file: {path}") from e
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path} is not TOML: {e}") from e


def load(spark: SparkSession, root: str, vessel: str, planner: str = "default", replanning: str = "default") -> Settings:
    """Settings of planner/, replanning/ and vessel_models/ below ``root``."""
    p = read_toml(spark, root, "planner", planner)
    given = {o: p.pop(o) for o in OBJECTIVES if o in p}
    p = checked(p, PLANNER, f"planner {planner}")
    weights = {}
    for o, shipped in OBJECTIVES.items():
        own = given.get(o, {k: getattr(shipped, v) for k, v in WEIGHTS.items()})
        own = checked(own, {k: (float, REQUIRED, lambda v: v >= 0, "must not be negative") for k in WEIGHTS}, f"planner {planner}, {o}")
        if not any(own.values()):
            raise ConfigError(f"planner {planner}, {o}: one weight at least must be positive")
        weights[o] = Weights(**{WEIGHTS[k]: v for k, v in own.items()})
    r = checked(read_toml(spark, root, "replanning", replanning), REPLANNING, f"replanning {replanning}")
    v = checked(read_toml(spark, root, "vessel_models", vessel), VESSEL, f"vessel {vessel}")
    try:
        ship = Vessel(v["economic_speed_knots"], v["minimum_steerage_speed_knots"], v["maximum_speed_knots"], v["minimum_speed_factor"])
    except ValueError as e:
        raise ConfigError(f"vessel {vessel}: {e}") from e
    policy = Policy.from_config(r["minimum_interval_minutes"], r["hysteresis"], r["risk_trigger_threshold"], r["deviation_trigger_km"], r["route_switch_gain_threshold"])
    whole = {"planner": p | {o: vars(w) for o, w in weights.items()}, "replanning": r, "vessel": v}
    return Settings(ship, weights, policy, p, digest(whole))
