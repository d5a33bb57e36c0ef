"""Requests to publications, replanning ticks, and sets of plans as documents."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_search import CUBE, random_cube

from riskgrid.functions.motion import OBJECTIVES
from riskgrid.operators import documents, layers, plan_sets, publish, replan, search, service
from riskgrid.plans import windows
from riskgrid.sources.cube import HOUR, T0

TOKENS = "run_id string, scenario_id string, generation int, config_digest string, model_digest string, planner_digest string, request_id string, revision bigint"
REQUESTS = f"log string, seq bigint, {TOKENS}, corridor_id string, vessel_id string, r0 int, c0 int, r1 int, c1 int, depart_us bigint, horizon_us bigint, bucket_us bigint, reasons array<string>, force boolean"
PLAN = "log string, plan_id string, plan struct<scenario:string,generation:int,corridor:string,vessel:string,cost:double,max_risk:double>"
LOG = f"log string, seq bigint, kind string, {TOKENS}, plan_id string"


def token(request, revision=0, generation=0, scenario="s"):
    return ("run", scenario, generation, "c", "m", "p", request, revision)


def test_requests_from_begin_to_publication(spark):
    cube = [(*x[:7], x[1:3] == (0, 0), *x[8:]) for x in random_cube(7, (4, 4), 6, hard=0.0)]
    cube = spark.createDataFrame(cube, CUBE)

    def request(log, seq, tok, r0=1, force=False, reasons=()):
        return (log, seq, *tok, "corridor", "vessel", r0, 0, 2, 3, T0, 4 * HOUR, HOUR, list(reasons), force)

    asked = [
        request("first", 0, token("q")),
        request("better stands", 0, token("q")),
        request("forced", 0, token("q"), force=True),
        request("blocked", 0, token("q"), r0=0),
        request("overtaken", 0, token("q")),
        request("older", 2, token("q", revision=1)),
        request("other scenario", 0, token("q", scenario="t")),
        request("twice", 0, token("q")),
        request("twice", 2, token("q2", revision=1)),
    ]
    cheap = ("s", 0, "corridor", "vessel", 0.01, 1.0)
    current = [("better stands", "old", cheap), ("forced", "old", cheap), ("other scenario", "old", cheap)]
    log = [("overtaken", 1, "activate", *token("new", revision=5), None), ("older", 0, "activate", *token("new", revision=5), None)]
    out, whole = service.execute(cube, spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(log, LOG), spark.createDataFrame(current, PLAN))
    got = {(r.log, r.seq): r for r in out.collect()}
    said = {k: (r.status, r.why) for k, r in got.items()}
    assert said == {
        ("first", 0): ("published", "no current route"),
        ("better stands", 0): ("kept", "too little gain"),
        ("forced", 0): ("published", "forced"),
        ("blocked", 0): ("failed", "start blocked"),
        ("overtaken", 0): ("superseded", "rejected: stale"),
        ("older", 2): ("superseded", "rejected: older revision"),
        ("other scenario", 0): ("kept", "scenario mismatch"),
        ("twice", 0): ("published", "no current route"),
        ("twice", 2): ("published", "no current route"),
    }
    want = spark.createDataFrame([("x", "recommended", 1, 0, 2, 3, T0, 4 * HOUR, HOUR)], "search string, objective string, r0 int, c0 int, r1 int, c1 int, depart_us bigint, horizon_us bigint, bucket_us bigint")
    cost = max(r.cost for r in search.routes(cube, want).collect())
    assert abs(got["first", 0].cost - cost) < 1e-9 and got["blocked", 0].plan_id is None
    stands = {r.log: r for r in publish.replay(whole).collect() if r.seq == 3}
    assert (stands["twice"].current, stands["twice"].previous) == ("plan-twice-2", "plan-twice-0")
    none = spark.createDataFrame([], REQUESTS)
    assert service.execute(cube, none, spark.createDataFrame(log, LOG), spark.createDataFrame(current, PLAN))[0].count() == 0


def test_ticks_decide_as_the_fold(spark):
    rows = windows.observations(spark, "/root/testdata/sf0.001")
    wanted = spark.createDataFrame(rows.withColumn("key", F.col("seq") % 6).orderBy("key", "at_us", "seq").collect(), rows.schema)
    fold = {r.seq: (r.outcome, r.reasons, r.retry_us) for r in replan.triggers(wanted).collect()}
    series = {}
    for r in sorted(wanted.collect(), key=lambda r: (r.at_us, r.seq)):
        series.setdefault(r.key, []).append(r)
    series = {k: v[:6] for k, v in series.items()}
    fields = ("at_us", "valid_us", "data_revision", "risk_revision", "avg_risk", "max_risk", "event")
    kinds = "key bigint, " + ", ".join(f"b_{c} {dict(wanted.dtypes)[c]}" for c in fields) + ", b_latched boolean"
    baselines, seen = spark.createDataFrame([], kinds), 0
    for k in range(6):
        now = [v[k] for v in series.values() if len(v) > k]
        decided = service.tick(baselines, spark.createDataFrame(now, wanted.schema))
        for r in decided.collect():
            seen += 1
            assert (r.outcome, r.reasons, r.retry_us) == fold[r.seq]
        published = spark.createDataFrame([(r.key,) for r in now if r.published] or [(-1,)], "key bigint")
        baselines = spark.createDataFrame(service.moved_baselines(baselines, decided, published).collect(), kinds)
    assert seen > 20


def test_request_contracts(spark):
    good = ("good", 0, 0, 1, 1, T0, T0, 4 * HOUR, HOUR)
    rows = [good, ("out", 9, 0, 1, 9, T0, T0, None, HOUR), ("closed", 0, 1, 0, 0, T0, T0, None, HOUR), ("one", 0, 0, 0, 0, T0, T0 + 1, 217 * HOUR, 0)]
    asked = spark.createDataFrame(rows, "search string, r0 int, c0 int, r1 int, c1 int, depart_us bigint, as_of_us bigint, horizon_us bigint, bucket_us bigint")
    cells = spark.createDataFrame([(r, c, (r, c) != (0, 1)) for r in range(2) for c in range(2)], "row int, col int, open boolean")
    got = sorted((r.search, r.rule) for r in service.request_violations(asked, cells).collect())
    assert got == sorted([("out", "start is outside the grid"), ("out", "goal is outside the grid"), ("closed", "start is closed"), ("one", "start and goal are one node"), ("one", "forecast is newer than the start"), ("one", "horizon is not positive or too long"), ("one", "time bucket is not positive")])
    frames = spark.createDataFrame([("a", 5), ("a", 9), ("b", 3)], "run_id string, as_of bigint")
    asked = spark.createDataFrame([("x", "a", 8), ("y", "b", 8), ("z", "c", 8)], "search string, run_id string, as_of_us bigint")
    assert {(r.search, r.rule) for r in service.risk_violations(frames, asked, ["run_id"]).collect()} == {("x", "a frame is newer than the request"), ("z", "no frame of this identity")}


@pytest.fixture(scope="module")
def plan_set(spark):
    r = random.Random(1)
    steps = []
    for name, missing in (("set-a", None), ("set-b", ("short_range", "fastest"))):
        for layer, _ in layers.LAYERS:
            for o in OBJECTIVES:
                if (layer, o) != missing:
                    steps += [(name, layer, o, k, k % 3, k % 2, T0 + k * HOUR, 5.0 * (k > 0), 1.0 * (k > 0), 6.0 if k else None, 90.0 if k else None, 0.2, 0.3, 0.9, float(k), r.random(), k, k + 1) for k in range(3)]
    steps = spark.createDataFrame(steps, "set_id string, layer string, objective string, step int, row int, col int, eta_us bigint, km double, hours double, knots double, heading double, risk double, max_risk double, confidence double, cost double, risk_hours double, frame_low int, frame_high int")
    cells = spark.createDataFrame([(r, c, 70.0 + r, 18.0 + c) for r in range(3) for c in range(2)], "row int, col int, lat double, lon double")
    text = [c for c in documents.HEADER if c not in ("plan_id", "objective_mode", *documents.TIMES, *documents.WHOLE)]
    head = spark.createDataFrame([(s, *(f"{c}-1" for c in text), 0, 0, T0, T0, T0) for s in ("set-a", "set-b")], f"set_id string, {', '.join(f'{c} string' for c in text)}, generation_id int, input_revision int, generated_at bigint, as_of_time bigint, start_time bigint")
    focus = spark.createDataFrame([(s, n, 0.0, float(h or 96)) for s in ("set-a", "set-b") for n, h in layers.LAYERS], "set_id string, layer string, focus_from_h double, focus_to_h double")
    return plan_sets.layered_plans(steps, cells, head, focus)


def test_sets_are_whole_and_hold(spark, plan_set):
    full = {r.set_id: r.plan_id for r in plan_sets.plan_of(plan_set, "full_voyage").collect()}
    assert all(r.reference_plan_id == (None if r.layer == "full_voyage" else full[r.set_id]) for r in plan_set.collect())
    sets = plan_sets.set_documents(plan_set)
    assert [r.set_id for r in sets.collect()] == ["set-a"] and plan_sets.set_problems(sets).count() == 0


def test_tampered_sets_are_told(spark, plan_set):
    good = json.loads(plan_sets.set_documents(plan_set).first().document)

    def told(change):
        bad = json.loads(json.dumps(good))
        change(bad)
        rows = spark.createDataFrame([("x", json.dumps(bad))], "set_id string, document string")
        return {r.problem for r in plan_sets.set_problems(rows).collect()}

    assert told(lambda d: d["plans"][4]["metrics"].update(compute_ms=9.0)) == set()
    assert told(lambda d: d["plans"][0].update(input_revision=4)) >= {"full_voyage/fastest: id does not match content", "set id does not match content"}
    assert told(lambda d: d["plans"].pop()) == {"not every layer and objective once", "set id does not match content"}
    assert told(lambda d: d["plans"][5].update(extra=1) or d["plans"][6].pop("run_id")) == {"plan: unknown extra", "plan: missing run_id"}
    assert told(lambda d: d.pop("set")) == {"set: missing set"}
    not_json = spark.createDataFrame([("x", "{"), ("y", None)], "set_id string, document string")
    assert {r.problem for r in plan_sets.set_problems(not_json).collect()} == {"not JSON"}
