"""When to replan, and when to switch to a new plan.

Triggers are a fold over a key's observations in order: the baseline moves
only when a triggered plan was published, which each observation tells. The
fold runs over sorted partitions with one small state at a time, so a key with
any number of observations needs no memory of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in their fixed order.
REASONS = ("time", "data", "risk", "deviation", "event", "manual")


@dataclass(frozen=True)
class Policy:
    min_interval_us: int = 30 * 60_000_000
    change: float = 0.10
    high: float = 0.65
    clear: float = 0.55
    deviation_km: float = 10.0
    gain: float = 0.03
    hysteresis: float = 0.02
    urgent_bypasses: bool = True

    @staticmethod
    def from_config(minimum_interval_minutes: float, hysteresis: float, risk_trigger_threshold: float, deviation_trigger_km: float, route_switch_gain_threshold: float) -> Policy:
        """The change threshold is the hysteresis, and the clear mark lies that much below the high mark."""
        return Policy(round(minimum_interval_minutes * 60_000_000), hysteresis, risk_trigger_threshold, max(0.0, risk_trigger_threshold - hysteresis), deviation_trigger_km, route_switch_gain_threshold, hysteresis)


@dataclass
class Baseline:
    """The state of one key."""

    at_us: int | None = None
    valid_us: int | None = None
    data_revision: int | None = None
    risk_revision: str | None = None
    avg_risk: float | None = None
    max_risk: float | None = None
    event: str | None = None
    latched: bool = False
    generation: int | None = None

    def decide(self, o, p: Policy) -> tuple[str, str, int | None]:
        """(outcome, reasons, retry time): outcome is none, fire, wait or error."""
        known = self.at_us is not None
        if known and (o.data_revision < self.data_revision or o.valid_us < self.valid_us):
            return "error", "", None
        crossed = o.max_risk >= p.high and not self.latched
        moved = known and max(abs(o.max_risk - self.max_risk), abs(o.avg_risk - self.avg_risk)) >= p.change
        on = {
            "time": known and o.valid_us > self.valid_us,
            "data": known and (o.data_revision > self.data_revision or o.risk_revision != self.risk_revision),
            "risk": o.hard or crossed or moved,
            "deviation": o.deviation_km >= p.deviation_km,
            "event": o.event is not None and o.event != self.event,
            "manual": o.manual,
        }
        reasons = ",".join(r for r in REASONS if on[r])
        if not reasons:
            return "none", "", None
        if known and o.at_us < self.at_us + p.min_interval_us and not (p.urgent_bypasses and (o.manual or o.hard)):
            return "wait", reasons, self.at_us + p.min_interval_us
        return "fire", reasons, None

    def commit(self, o, p: Policy) -> None:
        if self.at_us is not None and o.at_us < self.at_us:
            raise ValueError("the baseline can't move backwards")
        self.at_us, self.valid_us, self.data_revision, self.risk_revision = o.at_us, o.valid_us, o.data_revision, o.risk_revision
        self.avg_risk, self.max_risk, self.event = o.avg_risk, o.max_risk, o.event
        if o.max_risk >= p.high:
            self.latched = True
        elif o.max_risk <= p.clear:
            self.latched = False

    def enter(self, generation: int) -> bool:
        """A later generation starts afresh; an earlier one is refused."""
        if self.generation is not None and generation < self.generation:
            return False
        if self.generation is None or generation > self.generation:
            self.__init__(generation=generation)
        return True


OBSERVATION = ("key", "seq", "at_us", "valid_us", "data_revision", "risk_revision", "avg_risk", "max_risk", "deviation_km", "event", "manual", "hard", "published")
DECISIONS = "key bigint, seq bigint, outcome string, reasons string, retry_us bigint"


def step(state: Baseline, o, policy: Policy) -> tuple:
    outcome, reasons, retry = state.decide(o, policy)
    if outcome == "fire" and o.published:
        state.commit(o, policy)
    return o.key, o.seq, outcome, reasons, retry


def triggers(observations: DataFrame, policy: Policy | None = None) -> DataFrame:
    """A decision for every observation (see OBSERVATION), ordered by (at_us, seq) within a key."""
    policy = policy or Policy()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), Baseline()
        for pdf in batches:
            pdf["event"] = pdf["event"].astype(object).where(pdf["event"].notna(), None)
            rows = []
            for o in pdf.itertuples(index=False):
                if o.key != key:
                    key, state = o.key, Baseline()
                rows.append(step(state, o, policy))
            yield pd.DataFrame(rows, columns=["key", "seq", "outcome", "reasons", "retry_us"]).astype({"retry_us": "Int64"})

    return observations.select(*OBSERVATION).repartition("key").sortWithinPartitions("key", "at_us", "seq").mapInPandas(fold, DECISIONS)


TIMED_OBSERVATION = (*OBSERVATION, "generation")
#: Fields without which an observation is none.
NEEDED = ("key", "seq", "at_us", "valid_us", "data_revision", "avg_risk", "max_risk", "generation")
TIMED = "key bigint, seq bigint, at_us bigint, outcome string, reasons string, retry_us bigint"


class Held(NamedTuple):
    """A decision that waits, as it will be taken at its retry time ``at_us``."""

    seq: int
    at_us: int
    valid_us: int
    data_revision: int
    risk_revision: str
    avg_risk: float
    max_risk: float
    event: str | None
    published: bool
    reasons: str


@dataclass
class Timed:
    """A key's baseline by generation, and the decision that waits for its retry time.

    A waiting decision fires at that time unless a later one fired or waits in
    its place, or a later generation began; it comes before an observation of
    the same time. An observation of an earlier generation is stale.
    """

    policy: Policy
    baseline: Baseline
    held: Held | None = None

    def ring(self, until_us: int) -> list[tuple]:
        """What fires up to a time: (seq, at_us, outcome, reasons, retry_us)."""
        h = self.held
        if h is None or h.at_us > until_us:
            return []
        self.held = None
        if h.published:
            self.baseline.commit(h, self.policy)
        return [(h.seq, h.at_us, "fire", h.reasons, None)]

    def take(self, o) -> list[tuple]:
        """What an observation and the time that passed before it come to."""
        rows = self.ring(o.at_us)
        before = self.baseline.generation
        if not self.baseline.enter(o.generation):
            return [*rows, (o.seq, o.at_us, "stale", "", None)]
        if before != o.generation:
            self.held = None
        outcome, reasons, retry = self.baseline.decide(o, self.policy)
        if outcome == "wait":
            self.held = Held(o.seq, retry, o.valid_us, o.data_revision, o.risk_revision, o.avg_risk, o.max_risk, o.event, o.published, reasons)
        elif outcome == "fire":
            self.held = None
            if o.published:
                self.baseline.commit(o, self.policy)
        return [*rows, (o.seq, o.at_us, outcome, reasons, retry)]


def timed_frame(key, rows: list[tuple]) -> pd.DataFrame:
    keys = key if isinstance(key, list) else [key] * len(rows)
    out = pd.DataFrame(rows, columns=["seq", "at_us", "outcome", "reasons", "retry_us"])
    out.insert(0, "key", keys)
    return out.astype({"retry_us": "Int64"})


def complete(observations: DataFrame) -> DataFrame:
    """Observations that can be decided: with all NEEDED fields, no deviation for a missing one, and false for missing marks."""
    some = observations.select(*TIMED_OBSERVATION).dropna(subset=list(NEEDED))
    return some.fillna(0.0, "deviation_km").fillna(False, ["manual", "hard", "published"])


def timed(observations: DataFrame, until_us: int, policy: Policy | None = None) -> DataFrame:
    """Decisions on observations (TIMED_OBSERVATION) with those that fire at their retry time, up to ``until_us``; generations included. Incomplete observations (see ``complete``) are left out."""
    policy = policy or Policy()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), Timed(policy, Baseline())
        for pdf in batches:
            pdf["event"] = pdf["event"].astype(object).where(pdf["event"].notna(), None)
            keys, rows = [], []
            for o in pdf.itertuples(index=False):
                if o.key != key:
                    rows += state.ring(until_us)
                    keys += [key] * (len(rows) - len(keys))
                    key, state = o.key, Timed(policy, Baseline())
                rows += state.take(o)
                keys += [key] * (len(rows) - len(keys))
            yield timed_frame(keys, rows)
        rows = state.ring(until_us)
        yield timed_frame(key, rows)

    return complete(observations).repartition("key").sortWithinPartitions("key", "at_us", "seq").mapInPandas(fold, TIMED)


def initial(observation, policy: Policy) -> Baseline:
    """The baseline after a first plan."""
    state = Baseline()
    state.commit(observation, policy)
    return state


def state_dict(state: Baseline) -> dict:
    return asdict(state)


def formal_violations(now: DataFrame) -> DataFrame:
    """Broken rules of formal replans (at_us, valid_us, start_us, revision, last_revision, risk_revision, commit_id, has_prior)."""
    rules = {
        "observed at another time than the start": (F.col("at_us") != F.col("start_us")) | (F.col("valid_us") != F.col("start_us")),
        "revision does not rise": F.col("revision") <= F.col("last_revision"),
        "risk revision is not the committed window": ~F.col("risk_revision").eqNullSafe(F.col("commit_id")),
        "no plan to replace": ~F.col("has_prior"),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))
    return now.select("key", F.explode(broken).alias("rule"))


def switch_gate(pairs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Accept or refuse a candidate against the current plan; an expression in one row.

    ``pairs`` has structs ``current`` (or NULL) and ``candidate`` of
    (scenario, generation, corridor, vessel, cost, max_risk), ``reasons`` and
    ``force``.
    """
    p = policy or Policy()
    a, b, reasons = F.col("current"), F.col("candidate"), F.col("reasons")
    gain = (a["cost"] - b["cost"]) / F.greatest(F.abs(a["cost"]), F.lit(1e-12))
    has = lambda r: F.array_contains(reasons, r)
    cases: list[tuple[Column, bool, str, Column]] = [
        (a.isNull(), True, "no current route", F.lit(1.0)),
        (a["scenario"] != b["scenario"], False, "scenario mismatch", F.lit(0.0)),
        (a["generation"] != b["generation"], False, "generation mismatch", F.lit(0.0)),
        (a["corridor"] != b["corridor"], False, "corridor mismatch", F.lit(0.0)),
        (a["vessel"] != b["vessel"], False, "vessel mismatch", F.lit(0.0)),
        (F.col("force") | has("event") | has("manual"), True, "forced", gain),
        (has("risk") & (b["max_risk"] <= a["max_risk"] - p.hysteresis), True, "less risk", gain),
        (b["max_risk"] > a["max_risk"] + p.hysteresis, False, "more risk", gain),
        (gain < p.gain, False, "too little gain", gain),
    ]
    out = F.struct(F.lit(True).alias("accepted"), F.lit("enough gain").alias("why"), gain.alias("gain"))
    for when, accepted, why, value in reversed(cases):
        out = F.when(when, F.struct(F.lit(accepted).alias("accepted"), F.lit(why).alias("why"), value.alias("gain"))).otherwise(out)
    return pairs.withColumn("__rg_g", out).select(*(c for c in pairs.columns if c not in ("current", "candidate", "reasons", "force")), F.col("__rg_g.accepted").alias("accepted"), F.col("__rg_g.why").alias("why"), F.col("__rg_g.gain").alias("gain"))
