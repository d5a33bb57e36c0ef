"""The route search against a plain heap search of one request at a time."""

import itertools
import math
import random
import threading
import time

import pandas as pd
import pytest
import plain_search
from riskgrid.functions.motion import OBJECTIVES, Vessel, Weights
from riskgrid.operators import grid, search
from riskgrid.operators.edges import MAX_GAP_US, MIN_CONFIDENCE, POINTS, edge_series
from riskgrid.plans import grids
from riskgrid.sources.cube import HOUR, T0, table_cube

CUBE = "frame int, row int, col int, valid_us bigint, lat double, lon double, risk double, hard boolean, confidence double, factor double"
WANTED = "search string, objective string, r0 int, c0 int, r1 int, c1 int, depart_us bigint, horizon_us bigint, bucket_us bigint"
FIGURES = ("km", "hours", "knots", "heading", "risk", "max_risk", "confidence", "cost", "risk_hours", "frame_low", "frame_high")


def random_cube(seed, shape=(5, 5), frames=6, hard=0.03, unknown=0.0, uneven=False):
    r = random.Random(seed)
    at = [T0 + k * HOUR + (k % 2) * (HOUR // 3 if uneven else 0) for k in range(frames)]
    return [
        (k, i, j, at[k], 70 + 0.05 * i, 18 + 0.1 * j, None if r.random() < unknown else round(r.random(), 2), r.random() < hard, round(0.4 + 0.6 * r.random(), 2), round(0.35 + 0.6 * r.random(), 2))
        for k in range(frames)
        for i in range(shape[0])
        for j in range(shape[1])
    ]


def named(rows, ddl):
    return pd.DataFrame(rows, columns=[x.split()[0] for x in ddl.split(", ")])


def field_of(spark, cube, n=POINTS):
    links = grid.edges(grid.nodes(spark.createDataFrame(cube, CUBE))).toPandas()
    return plain_search.Field(named(cube, CUBE), links, Vessel(), MIN_CONFIDENCE, MAX_GAP_US, n)


def requests(seed, n=4, shape=(5, 5)):
    r = random.Random(seed)
    return [(f"{i}/{o}", o, r.randrange(shape[0]), r.randrange(2), r.randrange(shape[0]), shape[1] - 1 - r.randrange(2), T0 + r.randrange(3) * HOUR // 3, 4 * HOUR, HOUR) for i in range(n) for o in OBJECTIVES]


def asked(rows):
    for q in named(rows, WANTED).astype({"horizon_us": object}).itertuples(index=False):
        yield q._replace(horizon_us=None if q.horizon_us is None or q.horizon_us != q.horizon_us else int(q.horizon_us))


ODD = [("same", "fastest", 1, 1, 1, 1, T0, None, HOUR), ("before", "fastest", 1, 1, 1, 3, T0 - 1, None, HOUR), ("no node", "fastest", 9, 9, 1, 1, T0, None, HOUR), ("no goal", "fastest", 1, 1, 9, 9, T0, None, HOUR)]


def compared(spark, cube, wanted, objectives=OBJECTIVES, **options):
    """Runs both searches; every status, step, figure and count must agree. Returns the statuses."""
    n = options.pop("n", POINTS)
    most = options.get("max_expansions", search.MAX_EXPANSIONS)
    found = search.run(spark.createDataFrame(cube, CUBE), spark.createDataFrame(wanted, WANTED), objectives=objectives, n=n, **options)
    steps = {k: v.sort_values("step") for k, v in search.steps(found).toPandas().groupby("search")}
    counts = {r.search: r for r in search.counters(found).collect()}
    field, seen = field_of(spark, cube, n), []
    for q in asked(wanted):
        got, count = steps[q.search], {}
        seen.append(got.status.iloc[0])
        if not (0 <= q.r0 < 5 and 0 <= q.c0 < 5):
            assert seen[-1] == "error"
            continue
        want = plain_search.plan_one(field, q, objectives[q.objective], most, counters=count)
        assert seen[-1] == want[0][-1], q
        if seen[-1] == "ok":
            told = named(want, search.RESULT)
            assert got[["row", "col", "step"]].to_numpy().tolist() == told[["row", "col", "step"]].to_numpy().tolist()
            assert (got.eta_us.to_numpy() - told.eta_us.to_numpy()).max() <= 3
            for f in FIGURES:
                a, b = got[f].astype(float).to_numpy(), told[f].astype(float).to_numpy()
                assert ((abs(a - b) < 1e-6) | ((a != a) & (b != b))).all(), f
        if seen[-1] in ("ok", "no coverage", "no route") and q.r1 < 9:
            c = counts[q.search]
            names = {"expanded": "expanded", "crossings": "generated", **{f"refused_{x}": x for x in search.REFUSED}}
            assert {k: c[k] for k in names} == {k: count.get(v, 0) for k, v in names.items()}, q
    return seen


@pytest.mark.parametrize(("seed", "more"), [(0, {}), (1, {"unknown": 0.004}), (2, {"unknown": 0.004, "uneven": True}), (3, {"hard": 0.15})])
def test_search_is_the_plain_search(spark, seed, more):
    seen = compared(spark, random_cube(seed, **more), requests(seed) + ODD)
    assert "ok" in seen and "error" in seen


def test_other_policies_points_and_no_bound(spark):
    free = {**OBJECTIVES, "fastest": Weights(0.0, 1.0, 0.0, 0.3, 0.0)}
    cube = random_cube(4, (5, 5), 4, unknown=0.002)
    assert "ok" in compared(spark, cube, requests(5, 2), free)
    assert "ok" in compared(spark, cube, requests(6, 1), n=5)
    plain = search.counters(search.run(spark.createDataFrame(cube, CUBE), spark.createDataFrame(requests(6, 1), WANTED), use_bound=False)).collect()
    bound = {r.search: r for r in search.counters(search.run(spark.createDataFrame(cube, CUBE), spark.createDataFrame(requests(6, 1), WANTED))).collect()}
    assert all(r.status == bound[r.search].status and r.expanded >= bound[r.search].expanded for r in plain if r.status == "ok")


def test_samples_by_spacing(spark):
    """An edge has as many points as its length asks for, and its ends are those of three points."""
    cube = spark.createDataFrame(random_cube(6, (3, 3), 2), CUBE)
    links = grid.edges(grid.nodes(cube))
    three = {(e.r, e.c, e.dr, e.dc): e.points for e in edge_series(cube, links, 2).collect()}
    for e in edge_series(cube, links, 2, max_spacing_km=1.4).collect():
        ends = three[e.r, e.c, e.dr, e.dc]
        assert len(e.points) == max(3, math.ceil(e.km / 1.4) + 1)
        assert e.points[0].risk == ends[0].risk and e.points[-1].risk == ends[2].risk


def test_limit_has_its_own_status(spark, monkeypatch):
    cube = random_cube(2, hard=0.0)
    monkeypatch.setattr(search, "LOOK", 2)
    seen = compared(spark, cube, requests(2, 3), max_expansions=12)
    assert "limit" in seen


def test_one_bad_cell_behind_the_start_stops_no_search(spark):
    """An unknown cell that the plain search never reaches is none of ours either."""
    rows = [(k, i, j, T0 + k * HOUR, 70 + 0.05 * i, 18 + 0.1 * j, None if (i, j) == (2, 0) else 0.1, False, 0.9, 0.9) for k in range(8) for i in range(5) for j in range(9)]
    assert compared(spark, rows, [("a", "fastest", 2, 3, 2, 8, T0, None, HOUR)]) == ["ok"]


def test_progress_cancel_and_budget(spark):
    cube, wanted = spark.createDataFrame(random_cube(2, hard=0.0), CUBE), spark.createDataFrame(requests(2, 1), WANTED)
    told = []
    whole = search.run(cube, wanted, progress=told.append)
    assert [t["round"] for t in told] == list(range(1, whole.rounds + 1)) and told[-1]["open"] == 0 and sum(t["settled"] for t in told) == whole.labels.count()
    turns = itertools.count()
    few = search.run(cube, wanted, cancelled=lambda: next(turns) > 1)
    assert few.rounds == 2 and {r.status for r in search.steps(few).collect()} == {"cancelled"}
    begin = time.time()
    late = search.run(cube, wanted, budget_s=0.01)
    assert late.cancelled and {r.status for r in search.counters(late).collect()} == {"cancelled"} and time.time() - begin < 120
    assert not spark.getTags() and threading.active_count() < 100


def test_no_requests_and_no_cube(spark):
    cube, wanted = spark.createDataFrame(random_cube(1, (3, 3), 3), CUBE), spark.createDataFrame(requests(1, 1, (3, 3)), WANTED)
    assert search.routes(cube, wanted.limit(0)).count() == 0
    assert {r.status for r in search.routes(cube.limit(0), wanted).collect()} == {"error"}


def test_rounds_read_their_tiles_and_move_no_edges(spark):
    """What a round scans of the edges is bounded by its tiles, and the edges aren't shuffled."""
    cube = spark.createDataFrame(random_cube(1, (9, 20), 3, hard=0.0), CUBE)
    found = search.run(cube, spark.createDataFrame([("a", "fastest", 4, 0, 4, 19, T0, HOUR, HOUR)], WANTED), cancelled=lambda c=itertools.count(): next(c) > 0)
    assert found.rounds == 1 and found.links.select("tile").distinct().count() > 9


def test_edges_cross_as_in_the_search(spark, sf_dir):
    cube = table_cube(spark, sf_dir).cache()
    times = [r.valid_us for r in cube.select("valid_us").distinct().orderBy("valid_us").collect()]
    links = grid.edges(grid.nodes(cube)).toPandas()
    field = plain_search.Field(cube.toPandas(), links, Vessel(), MIN_CONFIDENCE, MAX_GAP_US, POINTS)
    assert field.axis == times
    rows = grids.crossed(spark, sf_dir).select("r", "c", "dr", "dc", "km", "depart_us", "reject", "hours", "knots", "risk", "max_risk", "confidence", "frame_low", "frame_high").collect()
    allowed = 0
    for e in rows:
        got = field.crossing(e.r, e.c, (e.dr, e.dc), e.km, e.depart_us)
        if isinstance(got, str):
            assert e.reject == got
        else:
            allowed += 1
            assert e.reject is None and all(abs(x - y) < 1e-8 for x, y in zip(got, e[7:], strict=True))
    assert allowed > 100


@pytest.mark.parametrize("n", [3, 5])
def test_series_of_edges_are_those_of_their_points(spark, n):
    rows = random_cube(7, (4, 3), 3, unknown=0.1)
    rows = [r for r in rows if r[:3] != (1, 2, 1)]  # one frame lacks a cell
    df = spark.createDataFrame(rows, CUBE)
    links = grid.edges(grid.nodes(df))
    field = plain_search.Field(named(rows, CUBE), links.toPandas(), Vessel(), MIN_CONFIDENCE, MAX_GAP_US, n)
    lost = (1, 2, 1)
    for e in edge_series(df, links, 3, n).collect():
        for p in e.points:
            y, x = e.r * (n - 1) + e.dr * p.i, e.c * (n - 1) + e.dc * p.i
            risk, hard, conf, fac = field.point_series(y, x)
            for k in range(3):
                if abs(y / (n - 1) - lost[1]) < 1 and abs(x / (n - 1) - lost[2]) < 1 and k == lost[0]:
                    assert p.risk[k] is None or p.hard[k]
                    continue
                assert (p.risk[k] is None and risk[k] != risk[k]) or abs(p.risk[k] - risk[k]) < 1e-9
                assert p.hard[k] == bool(hard[k]) and abs(p.confidence[k] - conf[k]) < 1e-12 and abs(p.factor[k] - fac[k]) < 1e-12


def test_requests_that_ask_the_same_are_one_search(spark):
    cube, asked = spark.createDataFrame(random_cube(3), CUBE), requests(3)
    odd = [*ODD, ("nothing", "fastest", None, 1, 1, 1, T0, None, HOUR)]
    twice = [(f"{k}/{q[0]}", *q[1:]) for k in range(3) for q in (*asked, *odd)]
    found = search.run(cube, spark.createDataFrame(twice, WANTED))
    assert found.wanted.count() == len({q[1:] for q in twice}) < len(twice)
    own = lambda rows, k: sorted(str(tuple(r)[1:]) for r in rows if r.search.startswith(f"{k}/"))
    alone = search.run(cube, spark.createDataFrame([*asked, *odd], WANTED))
    for made in (search.steps, search.counters):
        rows, want = made(found).collect(), sorted(str(tuple(r)[1:]) for r in made(alone).collect())
        assert all(own(rows, k) == want for k in range(3))


def test_a_round_is_two_jobs(spark):
    """What is final is broadcast, and the next frontier written: no round is planned again between its stages (three jobs before)."""
    sc, jobs = spark.sparkContext, []
    sc.setJobGroup("rounds", "rounds")
    try:
        count = lambda _: jobs.append(len(sc.statusTracker().getJobIdsForGroup("rounds")))
        search.run(spark.createDataFrame(random_cube(0), CUBE), spark.createDataFrame(requests(0, 1), WANTED), progress=count)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) > 2 and max(b - a for a, b in itertools.pairwise(jobs)) == 2
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
