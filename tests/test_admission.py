"""Run contexts and formal requests in cases that the queries don't have."""

from riskgrid.operators import admission

IDENTITY = ["run_id"]
REQUEST = "request string, entry int, provenance string, " + ", ".join(f"{n} string" for n in admission.SHARED) + ", run_id string, start bigint, steps bigint, as_of bigint"
ENTRY = "entry int, " + ", ".join(f"{n} string" for n in admission.SHARED)
FRAME = "run_id string, valid bigint, as_of bigint, provenance string"
D = tuple("abcde")


def rules(spark, request, frames, entries=((1, *D),)):
    df = admission.admission_problems(spark.createDataFrame([request], REQUEST), spark.createDataFrame(list(entries), ENTRY), spark.createDataFrame(frames, FRAME), IDENTITY, 10)
    return {r.rule for r in df.collect()}


def test_windows(spark):
    good = ("q", 1, "formal", *D, "r", 100, 2, 50)
    frames = [("r", t, 40, "formal") for t in (100, 110, 120)]
    assert rules(spark, good, frames) == set()
    assert rules(spark, good, frames + frames + [("r", 105, 1, "development"), ("x", 110, 1, "development"), ("r", 110, 51, "development")]) == set()
    assert rules(spark, good, [*frames, ("r", 110, 50, "development")]) == rules(spark, good, [*frames, ("r", 110, 50, None)]) == {"a frame is not formal"}
    assert rules(spark, good, frames[:2]) == rules(spark, good, [*frames[:2], ("r", 120, 51, "formal")]) == rules(spark, good, []) == {"window is not complete"}
    assert rules(spark, (*good[:-2], 0, 50), frames[:1]) == set()
    assert rules(spark, (*good[:-2], -1, 50), frames) == rules(spark, (*good[:-2], None, 50), frames) == {"no window"}
    assert rules(spark, (*good[:-1], None), frames) == {"window is not complete"}


def test_entries(spark):
    frames = [("r", 100, 40, "formal")]
    good = ("q", 1, "formal", *D, "r", 100, 0, 50)
    assert rules(spark, good, frames, ()) == {"no such entry"}
    assert rules(spark, (*good[:3], None, *good[4:]), frames) == {"planner_digest differs from the entry's"}
    assert rules(spark, (*good[:3], None, *good[4:]), frames, ((1, None, *D[1:]),)) == set()
    assert rules(spark, ("q", 1, None, *good[3:]), frames) == {"not formal"}


def test_contexts_of_nulls_and_unknown_runs(spark):
    scenario = "scenario_id string, version string, mode string, corridor_id string, vessel_profile_id string, is_template boolean, simulation_start bigint, simulation_end bigint, more string"
    scenarios = spark.createDataFrame([("s", None, "m", "c", "v", False, 1, 2, None), ("t", "1", "m", "c", "w", None, 1, 2, None)], scenario)
    corridors, vessels = spark.createDataFrame([("c", "1")], "corridor_id string, version string"), spark.createDataFrame([("v", "1")], "vessel_profile_id string, version string")
    runs = spark.createDataFrame([("a", "s", "c", "v", "b", "d"), ("b", "t", "c", "v", None, None), ("n", None, "c", "v", "b", "d")], "run_id string, scenario string, corridor string, vessel string, dataset_bundle_id string, dataset_bundle_digest string")
    expected = admission.expected_contexts(runs, scenarios, corridors, vessels)
    told = expected.where("run_id <> 'n'").select("run_id", *(f"bound.{n}" for n in admission.BOUND))
    none = told.limit(1).select(*told.columns)
    unknown = none.withColumn("run_id", none.run_id.substr(5, 1))
    got = {(r.run_id, r.problem) for r in admission.context_problems(told.unionByName(unknown), expected).collect()}
    assert got == {("b", "scenario is not materialised"), ("b", "scenario is for another vessel"), ("", "no such run")}
    same = {r.run_id: r.bound for r in expected.collect()}
    assert same["n"] is None and same["a"].scenario_version is None and len(same["a"].config_digest) == 64
    assert admission.context_problems(told.where("false"), expected).count() == 0
