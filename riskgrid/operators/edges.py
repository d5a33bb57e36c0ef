"""Edges in time: sampled series of every edge, and what crossing one costs at a departure.

Where the points of an edge lie does not depend on time, so their values in
every frame are taken once (``edge_series``); a crossing at any time is then
array look-ups and arithmetic in one row, without a join or Python.
``crossing_steps`` is that arithmetic as SQL texts, the same in every round of a
search, so that their generated code is compiled once. Each is analysed by
itself over the one before, which takes less than one nested text.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.motion import FULL_DEVIATION_HOURS, FULL_TURN_HOURS, KNOT_KMH, MICROS_PER_HOUR, Vessel
from riskgrid.functions.sql import double, long

POINTS = 3
MIN_CONFIDENCE = 0.10
MAX_GAP_US = 180 * 60_000_000
#: Hours that a crossing takes at most in the arithmetic; beyond that it is outside every window.
LONGEST_H = 1e6
#: What a step of ``crossing_steps`` reads.
ROWS = "{rows}"
PARTS = ("time", "risk", "distance", "turn", "deviation", "uncertainty")


def point_series(cube: DataFrame, n_frames: int, n: int = POINTS) -> DataFrame:
    """(y, x, series): every point of the grid's edges with arrays over all ``n_frames`` frames.

    y and x count (n - 1)-ths of a grid step. A cell gives its values to the
    points less than a step away, so each point is made once, however many
    edges share it: two aggregations, no join. A point that a frame or a
    missing cell leaves without some contributor has unknown risk there.
    """
    last = n - 1
    near = [(a, b, (1 - abs(a) / last) * (1 - abs(b) / last)) for a in range(1 - last, last) for b in range(1 - last, last)]
    parts = F.expr("array(" + ", ".join(f"named_struct('a', {a}, 'b', {b}, 'w', {double(w)})" for a, b, w in near) + ")")
    dealt = cube.select("frame", "row", "col", "risk", "hard", "confidence", "factor", F.explode(parts).alias("p"))
    dealt = dealt.withColumns({"y": F.col("row") * last + F.col("p.a"), "x": F.col("col") * last + F.col("p.b")})
    # points between grid lines lie on one of a square's diagonals
    y, x = F.pmod("y", F.lit(last)), F.pmod("x", F.lit(last))
    met = dealt.where((y == 0) | (x == 0) | (y == x) | (y + x == last)).groupBy("y", "x", "frame").agg(
        F.sum(F.col("p.w") * F.col("risk")).alias("risk"),
        F.count("risk").alias("known"),
        F.bool_or("hard").alias("hard"),
        F.min("confidence").alias("confidence"),
        F.min(F.coalesce("factor", F.lit(1.0))).alias("factor"),
    )
    due = F.when(F.col("y") % last == 0, 1).otherwise(2) * F.when(F.col("x") % last == 0, 1).otherwise(2)
    hard = F.coalesce("hard", F.lit(False))
    value = F.struct("frame", F.when(F.col("known") == due, F.round("risk", 9)).when(hard, 1.0).alias("risk"), hard.alias("hard"), "confidence", "factor")
    rows = met.groupBy("y", "x").agg(F.sort_array(F.collect_list(value)).alias("v"))
    every = F.sequence(F.lit(0), F.lit(n_frames - 1))
    nothing = F.lit(None).cast("struct<frame:int,risk:double,hard:boolean,confidence:double,factor:double>")
    whole = F.when(F.size("v") == n_frames, F.col("v")).otherwise(F.transform(every, lambda k: F.coalesce(F.get(F.filter("v", lambda s: s["frame"] == k), F.lit(0)), nothing)))
    rows = rows.withColumn("v", whole)
    return rows.select("y", "x", F.struct(F.col("v.risk").alias("risk"), F.transform("v.hard", lambda h: F.coalesce(h, F.lit(False))).alias("hard"), F.col("v.confidence").alias("confidence"), F.col("v.factor").alias("factor")).alias("series"))


def sample_counts(km: Column, n: int, max_spacing_km: float | None) -> Column:
    """How many points a crossing of so many km is sampled at: ``n``, or more where they would lie farther apart."""
    if n < 2 or (max_spacing_km is not None and max_spacing_km <= 0):
        raise ValueError("an edge has two points at least, and a positive spacing")
    return F.lit(n) if max_spacing_km is None else F.greatest(F.lit(n), F.ceil(km / max_spacing_km).cast("int") + 1)


def edge_series(cube: DataFrame, edges: DataFrame, n_frames: int, n: int = POINTS, max_spacing_km: float | None = None) -> DataFrame:
    """Each edge with its ``points`` (i, risk, hard, confidence, factor: arrays over all frames), and what bounds a crossing at any time: low_risk, best_factor, best_confidence.

    One equi-join of the edges' points with the points of the grid, and one
    aggregation by edge. With a spacing, edges have as many points as their
    length asks for; the grid's points are made once for each number of points
    (as many as the longest edge over the spacing).
    """
    counted = edges.withColumn("n_points", sample_counts(F.col("km"), n, max_spacing_km))
    every = [n] if max_spacing_km is None else sorted(r.n_points for r in counted.select("n_points").distinct().collect())
    points = None
    for k in every:
        own = point_series(cube, n_frames, k).withColumn("n_points", F.lit(k))
        points = own if points is None else points.unionByName(own)
    if points is None:  # no edges
        points = point_series(cube, n_frames, n).withColumn("n_points", F.lit(n))
    last = F.col("n_points") - 1
    dealt = counted.select("r", "c", "dr", "dc", "n_points", F.explode(F.sequence(F.lit(0), last)).alias("i")).withColumns({"y": F.col("r") * last + F.col("dr") * F.col("i"), "x": F.col("c") * last + F.col("dc") * F.col("i")})
    met = dealt.join(points, ["n_points", "y", "x"])
    by_edge = met.groupBy("r", "c", "dr", "dc").agg(F.sort_array(F.collect_list(F.struct("i", "series.risk", "series.hard", "series.confidence", "series.factor"))).alias("points"))
    lowest = F.transform("points", lambda p: F.coalesce(F.array_min(p["risk"]), F.lit(0.0)))
    inner = F.aggregate(lowest, F.lit(0.0), lambda a, v: a + v)
    bounds = {
        "low_risk": F.greatest(F.lit(0.0), (inner - 0.5 * F.get(lowest, F.lit(0)) - 0.5 * F.element_at(lowest, -1)) / (F.size("points") - 1)),
        "best_factor": F.array_min(F.transform("points", lambda p: F.coalesce(F.array_max(p["factor"]), F.lit(1.0)))),
        "best_confidence": F.array_min(F.transform("points", lambda p: F.coalesce(F.array_max(p["confidence"]), F.lit(1.0)))),
    }
    return edges.join(by_edge.withColumns(bounds), ["r", "c", "dr", "dc"])


def frames_ahead(times: list[int], hours: float) -> int:
    """How many frames after the one at or before a departure a crossing of so many hours can need."""
    ahead, j = 0, 0
    for k in range(len(times)):
        begin = times[min(k + 1, len(times) - 1)]
        while j < len(times) - 1 and times[j] < begin + hours * MICROS_PER_HOUR:
            j += 1
        ahead = max(ahead, j - k)
    return ahead + 1


def in_chunks(series: DataFrame, n_frames: int, chunk: int, ahead: int) -> DataFrame:
    """``edge_series`` cut into chunks of frames, each with the frames that a crossing begun in it may still need: ``chunk`` counts them, ``points`` begin with frame chunk * size."""
    every = F.sequence(F.lit(0), F.lit((n_frames - 1) // chunk))
    fields = ", ".join(f"'{c}', slice(p.{c}, chunk * {chunk} + 1, {chunk + ahead})" for c in ("risk", "hard", "confidence", "factor"))
    return series.withColumn("chunk", F.explode(every)).withColumn("points", F.expr(f"transform(points, p -> named_struct('i', p.i, {fields}))"))


def frame_sql(times: list[int]) -> tuple[str, str, str]:
    """SQL of the last frame at or before a time ``{t}``, and of the times of frame ``{k}`` and the one after it."""
    step = times[1] - times[0] if len(times) > 1 else 1
    if all(t == times[0] + k * step for k, t in enumerate(times)):
        return f"CAST(({{t}} - {long(times[0])}) div {long(step)} AS INT)", f"({long(times[0])} + {{k}} * {long(step)})", f"({long(times[0])} + ({{k}} + 1) * {long(step)})"
    axis = f"array({', '.join(map(long, times))})"
    return f"(size(filter({axis}, x_axis -> x_axis <= {{t}})) - 1)", f"get({axis}, {{k}})", f"get({axis}, {{k}} + 1)"


def crossing_sql(source: str, *args: Any, **options: Any) -> str:
    """``crossing_steps`` of a table or subquery, as one text."""
    for step in crossing_steps(*args, **options):
        source = f"({step.replace(ROWS, source)})"
    return source[1:-1]


def crossing_steps(times: list[int], vessel: Vessel, weights: Mapping[str, float | str], min_confidence: float = MIN_CONFIDENCE, max_risk: str | None = None, max_gap_us: int = MAX_GAP_US, base: str = "0") -> list[str]:
    """SQL texts, each over the rows (``ROWS``) of the one before, that cross the edges of the first's (columns of ``edge_series``) at ``depart_us`` with ``heading_before``.

    Adds reject (NULL, or error, coverage, hard, risk, speed: the first that
    applies), hours, knots, risk, max_risk, confidence, arrive_us, the first
    and last frame it used and the cost components. Travel time and samples
    are refined twice, each time with the travel time before; edges may have
    different numbers of points. ``weights``, ``max_risk`` and ``base`` (the
    frame that the series begin with) may be SQL of the source's columns.
    """
    frame, low, high = frame_sql(times)
    low, high = low.replace("{k}", "z.k"), high.replace("{k}", "z.k")

    def value(name: str, both: str) -> str:
        a, b = f"get(p.{name}, z.k - {base})", f"get(p.{name}, z.k - {base} + 1)"
        return f"IF({low} = z.t, {a}, {both.format(a=a, b=b)})"

    share = f"(CAST(z.t - {low} AS DOUBLE) / CAST({high} - {low} AS DOUBLE))"
    covered = f"z.t >= {long(times[0])} AND z.t <= {long(times[-1])} AND ({low} = z.t OR {high} - {low} <= {long(max_gap_us)})"
    risk = value("risk", "{a} + " + share + " * ({b} - {a})")
    sample = f"""named_struct('risk', IF(coalesce({covered}, false), {risk}, NULL), 'out', NOT coalesce({covered}, false), 'hard', {value("hard", "{a} OR {b}")},
        'confidence', {value("confidence", "least({a}, {b})")}, 'factor', {value("factor", "least({a}, {b})")}, 'low', z.k, 'high', IF({low} = z.t, z.k, z.k + 1))"""
    at = f"depart_us + CAST(bround(least(x_hours, {double(LONGEST_H)}) * (p.i / (size(points) - 1)) * {double(MICROS_PER_HOUR)}) AS BIGINT)"
    # one-element arrays name the time and the frame of a point, so that they are computed once
    samples = f"transform(points, p -> get(transform(transform(array({at}), t -> named_struct('t', t, 'k', {frame.replace('{t}', 't')})), z -> {sample}), 0))"
    knots = f"least({double(vessel.maximum)}, {double(vessel.economic)} * x_factor)"
    slow = f"x_factor IS NULL OR x_factor <= 0 OR x_factor > 1 OR x_factor < {double(vessel.least_factor)} OR {knots} < {double(vessel.steerage)}"
    risky = f"array_min(x_s.confidence) < {double(min_confidence)}" + ("" if max_risk is None else f" OR coalesce(array_max(x_s.risk) > {max_risk}, false)")
    # of the points that can't be sampled the first one tells why
    failed = "get(filter(transform(x_s, p -> CASE WHEN p.out THEN 'coverage' WHEN p.risk IS NULL THEN 'error' END), e -> e IS NOT NULL), 0)"
    out = []
    q = f"SELECT *, km / {double(vessel.calm_kmh)} AS x_hours, CAST(NULL AS STRING) AS x_before FROM {ROWS}"
    for turn in (1, 2):
        q = f"SELECT *, {samples} AS x_s FROM {q if q == ROWS else f'({q})'}"
        q = f"SELECT *, array_min(x_s.factor) AS x_factor, {failed} AS x_failed FROM ({q})"
        q = f"SELECT * EXCEPT (x_failed, x_before, x_hours), coalesce(x_before, x_failed, CASE WHEN array_contains(x_s.hard, true) THEN 'hard' WHEN {risky} THEN 'risk' WHEN {slow} THEN 'speed' END) AS x_before, km / nullif({knots} * {double(KNOT_KMH)}, 0D) AS x_hours FROM ({q})"
        if turn == 1:
            out.append(f"SELECT * EXCEPT (x_s, x_factor) FROM ({q})")
            q = ROWS
    seen = {
        "reject": "x_before",
        "knots": knots,
        "hours": "x_hours",
        "risk": "(aggregate(x_s.risk, 0D, (a, r) -> a + r) - 0.5D * get(x_s, 0).risk - 0.5D * element_at(x_s, -1).risk) / (size(x_s) - 1)",
        "max_risk": "array_max(x_s.risk)",
        "confidence": "array_min(x_s.confidence)",
        "frame_low": "array_min(x_s.low)",
        "frame_high": "array_max(x_s.high)",
        "turn": "coalesce(least(pmod(heading - heading_before, 360D), 360D - pmod(heading - heading_before, 360D)), 0D)",
    }
    out.append(q)
    q = f"SELECT * EXCEPT (x_s, x_factor, x_hours, x_before), {', '.join(f'{v} AS {k}' for k, v in seen.items())} FROM {ROWS}"
    parts = {
        "travel_hours": "hours",
        "risk_hours": "hours * risk",
        "distance_hours": f"km / {double(vessel.maximum_kmh)}",
        "turn_hours": f"turn / 180D * {double(FULL_TURN_HOURS)}",
        "deviation_hours": f"0D * {double(FULL_DEVIATION_HOURS)}",
        "uncertain_hours": "hours * (1D - confidence)",
    }
    q = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in parts.items())} FROM ({q})"
    w = {k: v if isinstance(v, str) else double(v) for k, v in weights.items()}
    total = " + ".join(f"{w.get(k, '0D')} * {p}" for k, p in zip(PARTS, parts, strict=True))
    out.append(f"SELECT *, {total} AS total_hours, depart_us + CAST(bround(least(hours, {double(LONGEST_H)}) * {double(MICROS_PER_HOUR)}) AS BIGINT) AS arrive_us FROM ({q})")
    return out


def cross(departures: DataFrame, times: list[int], vessel: Vessel, weights: Mapping[str, float | str], min_confidence: float = MIN_CONFIDENCE, max_risk: str | None = None, max_gap_us: int = MAX_GAP_US) -> DataFrame:
    """``crossing_sql`` of a DataFrame."""
    return departures.sparkSession.sql(crossing_sql("{rows}", times, vessel, weights, min_confidence, max_risk, max_gap_us), rows=departures)


def reject_counts(crossed: DataFrame, keys: list[str]) -> DataFrame:
    return crossed.groupBy(*keys, F.coalesce("reject", F.lit("none")).alias("reject")).agg(F.count("*").alias("n"))
