"""Vessel speed, equivalent-hour cost and time arithmetic as Catalyst expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: km/h and m/s in a knot (fixed values).
KNOT_KMH = 1.852
KNOT_MS = 0.5144444444444445
MICROS_PER_HOUR = 3_600_000_000


@dataclass(frozen=True)
class Vessel:
    """Speeds in knots; the defaults are the shipped reference vessel's."""

    economic: float = 10.0
    steerage: float = 3.0
    maximum: float = 15.7
    least_factor: float = 0.20

    def __post_init__(self) -> None:
        if not 0 < self.steerage <= self.economic <= self.maximum:
            raise ValueError("0 < steerage <= economic <= maximum must hold")
        if not 0 < self.least_factor <= 1:
            raise ValueError("least_factor must be within (0, 1]")

    @property
    def calm_kmh(self) -> float:
        return min(self.maximum, self.economic) * KNOT_KMH

    @property
    def maximum_kmh(self) -> float:
        return self.maximum * KNOT_KMH


@dataclass(frozen=True)
class Weights:
    time: float
    risk: float
    distance: float
    turn: float
    uncertainty: float
    deviation: float = 0.0

    def __post_init__(self) -> None:
        own = (self.time, self.risk, self.distance, self.turn, self.uncertainty, self.deviation)
        if min(own) < 0 or max(own) <= 0:
            raise ValueError("weights are not negative and not all zero")


#: Shipped policies (fixed values).
OBJECTIVES = {
    "fastest": Weights(1.0, 0.2, 0.05, 0.05, 0.2),
    "low_risk": Weights(0.45, 2.5, 0.05, 0.08, 0.8),
    "recommended": Weights(0.85, 1.3, 0.08, 0.1, 0.45),
}

FULL_TURN_HOURS = 0.25
FULL_DEVIATION_HOURS = 1.0


def risk_level(risk: Column) -> Column:
    """1 to 5: floor(5 risk) + 1, held in range."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.floor(risk * 5) + 1)).cast("int")


def speed_status(factor: Column, vessel: Vessel) -> Column:
    """'ok', or why a factor gives no safe speed."""
    return (
        F.when(factor.isNull() | (factor <= 0) | (factor > 1), "invalid")
        .when(factor < vessel.least_factor, "factor")
        .when(F.least(F.lit(vessel.maximum), vessel.economic * factor) < vessel.steerage, "steerage")
        .otherwise("ok")
    )


def vessel_speed(factor: Column, vessel: Vessel) -> Column:
    """Knots under an environment factor; NULL where the vessel can't go safely."""
    return F.when(speed_status(factor, vessel) == "ok", F.least(F.lit(vessel.maximum), vessel.economic * factor))


def edge_cost(distance: Column, hours: Column, risk: Column, confidence: Column, turn: Column, weights: dict[str, Column] | Weights, maximum_kmh: float, deviation: Column | None = None) -> dict[str, Column]:
    """The cost components in equivalent hours, and their weighted total."""
    w = weights if isinstance(weights, dict) else {k: F.lit(v) for k, v in vars(weights).items()}
    parts = {
        "travel_hours": hours,
        "risk_hours": hours * risk,
        "distance_hours": distance / maximum_kmh,
        "turn_hours": turn / 180 * FULL_TURN_HOURS,
        "deviation_hours": (F.lit(0.0) if deviation is None else deviation) * FULL_DEVIATION_HOURS,
        "uncertain_hours": hours * (1 - confidence),
    }
    used = zip(("time", "risk", "distance", "turn", "deviation", "uncertainty"), parts.values(), strict=True)
    total = None
    for name, x in used:
        term = w[name] * x
        total = term if total is None else total + term
    return parts | {"total_hours": total}


def lower_bound(distance: Column, weights: Weights, maximum_kmh: float) -> Column:
    """Least cost that a remaining distance can have."""
    return (weights.time + weights.distance) * (distance / maximum_kmh)


def plus_hours(micros: Column, hours: Column) -> Column:
    """Time in epoch microseconds after some hours, rounded half to even."""
    return micros + F.bround(hours * MICROS_PER_HOUR).cast("bigint")


def bucket(micros: Column, start: Column, width_micros: int) -> Column:
    return F.floor((micros - start) / width_micros).cast("int")
