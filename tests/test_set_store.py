"""Layered sets come in whole, checked and fenced, or not at all."""

import json

import pytest

from riskgrid.functions.values import canonical_bytes
from riskgrid.operators import publish, set_store, shared
from riskgrid.operators.codec import plan_digest, set_digest
from riskgrid.operators.layers import LAYERS
from riskgrid.operators.plan_sets import PLAN_ID, SET_ID
from riskgrid.operators.shared import folder
from riskgrid.functions.motion import OBJECTIVES

TOKEN = ("run", "scenario", 0, "c", "m", "p", "request", 0)
COMMANDS = "log string, seq bigint, kind string, run_id string, scenario_id string, generation int, config_digest string, model_digest string, planner_digest string, request_id string, revision bigint, plan_id string"
SETS = "set_id string, layer_set_id string, " + COMMANDS.split("kind string, ")[1].rsplit(", ", 1)[0]
PLANS = "set_id string, layer string, objective string, plan_id string, reference_plan_id string, document string"


def documents(name):
    """Twelve plan documents of a set, with the ids that follow from them."""
    out, full = {}, None
    for layer, _ in LAYERS:
        for objective in ("recommended", *(o for o in OBJECTIVES if o != "recommended")):
            plan = {"layer": layer, "objective_mode": objective, "reference_plan_id": full if layer != LAYERS[0][0] else None, "metrics": {"cost": 1.5, "compute_ms": 7}, "say": f"{name} é", "generated_at": 3}
            plan["plan_id"] = PLAN_ID + plan_digest(plan)
            full = full or plan["plan_id"]
            out[layer, objective] = plan
    return out


def made(spark, *names):
    sets, plans = [], []
    for name in names:
        docs = documents(name)
        sets.append((name, SET_ID + set_digest(list(docs.values()), set=name), *TOKEN))
        plans += [(name, *place, p["plan_id"], p["reference_plan_id"], canonical_bytes(p).decode()) for place, p in docs.items()]
    return spark.createDataFrame(sets, SETS), set_store.contents(spark.createDataFrame(plans, PLANS))


def test_ids_follow_from_contents_as_from_documents(spark):
    sets, plans = made(spark, "a", "b")
    assert {(r.set_id, r.fault) for r in set_store.set_faults(sets, plans).collect()} == {("a", None), ("b", None)}


def test_faults(spark):
    sets, plans = made(spark, "a")
    rows = [tuple(r) for r in plans.collect()]
    k = next(i for i, r in enumerate(rows) if r[1] == "short_range")

    def fault(rows, sets=sets):
        return set_store.set_faults(sets, spark.createDataFrame(rows, plans.schema)).first().fault

    def changed(**values):
        own = dict(zip(set_store.PLANS, rows[k], strict=True)) | values
        return rows[:k] + [tuple(own.values())] + rows[k + 1 :]

    assert fault(rows) is None
    whole = "not every layer and objective once"
    assert fault(rows[1:]) == fault([*rows, rows[0]]) == fault(changed(layer="x")) == fault(changed(objective=None)) == fault([]) == whole
    assert fault(changed(content="{}")) == fault(changed(content=None)) == fault(changed(plan_id=None)) == "a plan's id does not match its content"
    assert fault(changed(reference_plan_id=None)) == fault(changed(reference_plan_id="x")) == "a plan names another reference"
    other = spark.createDataFrame([("a", "x", *TOKEN)], SETS)
    assert fault(rows, other) == "the set's id does not match its content"
    assert fault(rows, sets.unionByName(sets)) == "told twice"


def added(spark, *rows):
    return spark.createDataFrame([(log, seq, kind, *TOKEN, plan) for log, seq, kind, plan in rows], COMMANDS)


def test_a_lost_writer_leaves_the_old_state(spark, monkeypatch):
    root = folder(spark, "test-sets")
    assert set_store.standing(spark, root).count() == 0
    with pytest.raises(LookupError):
        set_store.current_plans(spark, root)
    set_store.commit(root, added(spark, ("l", 0, "activate", None), ("l", 1, "publish", "a"), ("m", 0, "activate", None)), *made(spark, "a"))
    assert {tuple(r) for r in set_store.standing(spark, root).collect()} == {("l", "a", None), ("m", None, None)}
    more = added(spark, ("l", 2, "publish", "b"), ("l", 3, "publish", "none"))
    write, steps = set_store.written, []
    for lost in range(6):
        count = iter(range(9))

        def failing(df, path, lost=lost, count=count):
            if next(count) == lost:
                steps.append(path.rsplit("/", 1)[1])
                raise OSError("lost")
            return write(df, path)

        with monkeypatch.context() as m:
            m.setattr(set_store, "written", failing)
            if lost == 5:
                m.setattr(set_store, "create_file", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                set_store.commit(root, more, *made(spark, "b"))
        assert {r.set_id for r in set_store.current_plans(spark, root).collect()} == {"a"}
    assert steps == ["commands", "sets", "plans", "said", "standing"]
    said = set_store.commit(root, more, *made(spark, "b"))
    assert {(r.seq, r.outcome) for r in said.collect()} == {(2, "ok"), (3, "rejected: no such set")}
    assert {tuple(r) for r in set_store.standing(spark, root).collect()} == {("l", "b", "a"), ("m", None, None)}
    assert set_store.current_plans(spark, root).count() == len(documents("b"))


def test_of_two_writers_one_fails(spark, monkeypatch):
    root = folder(spark, "test-two")
    set_store.commit(root, added(spark, ("l", 0, "activate", None)), *made(spark, "a"))
    state = set_store._state(spark, root)
    set_store.commit(root, added(spark, ("l", 1, "publish", "a")), *made(spark))
    monkeypatch.setattr(set_store, "_state", lambda *_: state)
    with pytest.raises(RuntimeError, match="another writer"):
        set_store.commit(root, added(spark, ("l", 1, "cancel", None)), *made(spark))
    monkeypatch.undo()
    assert [tuple(r) for r in set_store.standing(spark, root).collect()] == [("l", "a", None)]


def test_sets_of_another_token_are_refused(spark):
    sets, plans = made(spark, "a")
    log = added(spark, ("l", 0, "activate", None), ("l", 1, "publish", "a"))
    for field, value in (("revision", 1), ("run_id", None), ("model_digest", "x")):
        from pyspark.sql import functions as F

        other = sets.withColumn(field, F.lit(value).cast(sets.schema[field].dataType))
        assert {r.seq: (r.outcome, r.current) for r in set_store.replay_sets(log, other, plans).collect()} == {0: ("ok", None), 1: (f"rejected: set of another {field}", None)}
    assert json.loads(plans.first().content)["metrics"] == {"cost": 1.5}


def test_planned_sets_go_to_the_store_with_their_ids(spark):
    plans = [(name, *place, p["plan_id"], p["reference_plan_id"], canonical_bytes(p).decode()) for name in "ab" for place, p in documents(name).items()]
    tokens = spark.createDataFrame([("a", "", *TOKEN), ("b", "", *TOKEN)], SETS).drop("layer_set_id")
    sets, own = set_store.submission(spark.createDataFrame(plans[:-1], PLANS), tokens, folder(spark, "test-plans"))
    assert {r.set_id: r.layer_set_id for r in sets.collect()}["a"] == SET_ID + set_digest(list(documents("a").values()), set="a")
    root = folder(spark, "test-submitted")
    said = set_store.commit(root, added(spark, ("l", 0, "activate", None), ("l", 1, "publish", "a"), ("l", 2, "publish", "b")), sets, own)
    assert {r.seq: r.outcome for r in said.collect()} == {0: "ok", 1: "ok", 2: "rejected: not every layer and objective once"}
    assert {tuple(r) for r in set_store.standing(spark, root).collect()} == {("l", "a", None)}


def test_tasks_follow_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 10)
    commands = spark.createDataFrame([(f"log-{k}", k, "activate", *TOKEN, None) for k in range(200)], COMMANDS)
    assert publish.replay(commands).rdd.getNumPartitions() == 20
    sets, plans = made(spark, *(f"set-{k}" for k in range(10)))
    assert set_store.set_ids(plans).rdd.getNumPartitions() == 12
