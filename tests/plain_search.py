"""A plain heap search of one request at a time, for tests of the engine's search."""

import heapq
import math
from array import array
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd

from riskgrid.functions.geo import EARTH_KM
from riskgrid.functions.motion import FULL_TURN_HOURS, KNOT_KMH, MICROS_PER_HOUR, Vessel, Weights


class Field:
    """A cube as arrays, and crossings on them."""

    def __init__(self, cube: pd.DataFrame, links: pd.DataFrame, vessel: Vessel, min_confidence: float, max_gap_us: int, n: int):
        self.times = np.sort(cube["valid_us"].unique())
        ny, nx = int(cube["row"].max()) + 1, int(cube["col"].max()) + 1
        at = np.searchsorted(self.times, cube["valid_us"].to_numpy()), cube["row"].to_numpy(), cube["col"].to_numpy()

        def grid(name: str, empty: float) -> np.ndarray:
            out = np.full((len(self.times), ny, nx), np.nan)
            out[at] = cube[name].astype("float64").fillna(empty).to_numpy()
            return out

        self.risk, self.conf, self.factor = grid("risk", np.nan), grid("confidence", np.nan), grid("factor", 1.0)
        self.hard = grid("hard", 1.0) > 0
        self.vessel, self.min_confidence, self.max_gap, self.n = vessel, min_confidence, max_gap_us, n
        self.out: dict[tuple[int, int], list] = {}
        for e in links.sort_values(["r", "c", "dr", "dc"]).itertuples(index=False):
            self.out.setdefault((e.r, e.c), []).append((e.r2, e.c2, (e.dr, e.dc), e.km, e.heading))
        self.place = {(e.r, e.c): (e.lat, e.lon) for e in links.itertuples(index=False)}
        self.axis = self.times.tolist()
        self.series: dict[tuple[int, int], tuple] = {}

    def point_series(self, y: int, x: int) -> tuple[array, array, array, array]:
        """Values over all frames of a point, its place counted in (n - 1)-ths of a cell: edges share their points."""
        found = self.series.get((y, x))
        if found is None:
            parts = self.n - 1
            ys = [(k, w) for k, w in ((y // parts, 1 - y % parts / parts), (y // parts + 1, y % parts / parts)) if w > 0]
            xs = [(k, w) for k, w in ((x // parts, 1 - x % parts / parts), (x // parts + 1, x % parts / parts)) if w > 0]
            risk, hard = np.zeros(len(self.axis)), np.zeros(len(self.axis), bool)
            conf, fac = np.full(len(self.axis), np.inf), np.full(len(self.axis), np.inf)
            for r, wr in ys:
                for c, wc in xs:
                    risk = risk + wr * wc * self.risk[:, r, c]
                    hard |= self.hard[:, r, c]
                    conf, fac = np.minimum(conf, self.conf[:, r, c]), np.minimum(fac, self.factor[:, r, c])
            risk = np.where(np.isnan(risk) & hard, 1.0, np.round(risk, 9))
            found = self.series[y, x] = (array("d", risk), array("b", hard.astype(np.int8)), array("d", conf), array("d", fac))
        return found

    def at(self, series, t: int):
        """(status, risk, hard, confidence, factor, low frame, high frame) at a time."""
        times = self.axis
        k = bisect_right(times, t) - 1
        if k < 0 or t > times[-1]:
            return ("coverage",)
        risk, hard, conf, fac = series
        if times[k] == t:
            value = ("ok", risk[k], hard[k], conf[k], fac[k], k, k)
        else:
            gap = times[k + 1] - times[k]
            if gap > self.max_gap:
                return ("coverage",)
            share = (t - times[k]) / gap
            value = ("ok", risk[k] + share * (risk[k + 1] - risk[k]), hard[k] or hard[k + 1], min(conf[k], conf[k + 1]), min(fac[k], fac[k + 1]), k, k + 1)
        return ("error",) if value[1] != value[1] else value

    def bound(self, goal: tuple[int, int], weights: Weights) -> Callable[[tuple[int, int]], float]:
        """Least cost from a node to the goal: the great circle at the best speed."""
        known: dict[tuple[int, int], float] = {}
        lat2, lon2 = self.place.get(goal, (math.nan, math.nan))
        v = self.vessel
        each = (weights.time + weights.distance) / v.maximum_kmh

        def least(node: tuple[int, int]) -> float:
            if node not in known:
                lat1, lon1 = self.place[node]
                a, b = math.radians(lat1), math.radians(lat2)
                half = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
                known[node] = each * 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(half))) * (1 - 1e-9)
            return known[node]

        return least

    def crossing(self, r: int, c: int, move: tuple[int, int], km: float, depart: int):
        """Reject reason, or the figures of a crossing."""
        v, parts = self.vessel, self.n - 1
        hours = km / v.calm_kmh
        points = [self.point_series(r * parts + move[0] * i, c * parts + move[1] * i) for i in range(self.n)]
        for _ in range(2):
            seen = []
            for i, series in enumerate(points):
                s = self.at(series, depart + round(hours * (i / parts) * MICROS_PER_HOUR))
                if s[0] != "ok":
                    return s[0]
                seen.append(s)
            if any(s[2] for s in seen):
                return "hard"
            if any(s[3] < self.min_confidence for s in seen):
                return "risk"
            factor = min(s[4] for s in seen)
            knots = min(v.maximum, v.economic * factor)
            if factor < v.least_factor or knots < v.steerage:
                return "speed"
            hours = km / (knots * KNOT_KMH)
        inner = sum(s[1] for s in seen)
        risk = (inner - 0.5 * seen[0][1] - 0.5 * seen[-1][1]) / (self.n - 1)
        return hours, knots, risk, max(s[1] for s in seen), min(s[3] for s in seen), min(s[5] for s in seen), max(s[6] for s in seen)


def plan_one(field: Field, q, weights: Weights, max_expansions: int = 250_000, counters: dict[str, int] | None = None) -> list[tuple]:
    """Label-setting search of one request, nearest to the goal by the lower bound first; its steps, or one row with the status.

    counters: filled with the effort (expanded, generated, stale, pushed) and
    the crossings refused by each reason.
    """
    counters = {} if counters is None else counters

    def count(what: str) -> None:
        counters[what] = counters.get(what, 0) + 1

    def failed(status: str) -> list[tuple]:
        return [(q.search, 0, q.r0, q.c0, q.depart_us, *([None] * 11), status)]

    start = field.at(field.point_series(q.r0 * (field.n - 1), q.c0 * (field.n - 1)), q.depart_us)
    if start[0] != "ok":
        return failed("error")
    if start[2]:
        return failed("start blocked")
    first = (q.search, 0, q.r0, q.c0, q.depart_us, 0.0, 0.0, None, None, start[1], start[1], start[3], 0.0, 0.0, start[5], start[6], "ok")
    if (q.r0, q.c0) == (q.r1, q.c1):
        return [first]
    begin = (q.r0, q.c0, 0, None)
    labels = {begin: (0.0, q.depart_us)}
    came: dict = {}
    least = field.bound((q.r1, q.c1), weights)
    if (q.r0, q.c0) not in field.place or (q.r1, q.c1) not in field.place:
        return failed("no route")
    heap = [(least((q.r0, q.c0)), 0.0, q.depart_us, (q.r0, q.c0, 0, (9, 9)), begin)]
    closed: set = set()
    outside = False
    maximum = field.vessel.maximum_kmh
    while heap:
        _, cost, arrival, _, state = heapq.heappop(heap)
        if state in closed or labels[state] != (cost, arrival):
            count("stale")
            continue
        closed.add(state)
        r, c, _, before = state
        if len(closed) > max_expansions:
            return failed("limit")
        if (r, c) != (q.r1, q.c1):
            count("expanded")
        if (r, c) == (q.r1, q.c1):
            path = []
            while state in came:
                state, row = came[state]
                path.append(row)
            return [first, *((q.search, k + 1, *row, "ok") for k, row in enumerate(reversed(path)))]
        heading_before = next((h for r2, c2, m, _, h in field.out[r - before[0], c - before[1]] if m == before), None) if before else None
        for r2, c2, move, km, heading in field.out.get((r, c), ()):
            got = field.crossing(r, c, move, km, arrival)
            count("generated")
            if isinstance(got, str):
                count(got)
                if got == "error":
                    return failed("error")
                outside |= got == "coverage"
                continue
            hours, knots, risk, most, confidence, low, high = got
            reach = arrival + round(hours * MICROS_PER_HOUR)
            if q.horizon_us is not None and reach - q.depart_us > q.horizon_us:
                outside = True
                count("coverage")
                continue
            turn = 0.0
            if heading_before is not None:
                turn = (heading - heading_before) % 360.0
                turn = min(turn, 360.0 - turn)
            total = cost + (weights.time * hours + weights.risk * (hours * risk) + weights.distance * (km / maximum) + weights.turn * (turn / 180 * FULL_TURN_HOURS) + weights.uncertainty * (hours * (1 - confidence)))
            nxt = (r2, c2, (reach - q.depart_us) // q.bucket_us, move)
            old = labels.get(nxt)
            if nxt in closed or (old is not None and total >= old[0] - 1e-12):
                continue
            labels[nxt] = (total, reach)
            came[nxt] = (state, (r2, c2, reach, km, hours, knots, heading, risk, most, confidence, total, hours * risk, low, high))
            heapq.heappush(heap, (total + least((r2, c2)), total, reach, (r, c, 0, before or (9, 9)), nxt))
            count("pushed")
    return failed("no coverage" if outside else "no route")
