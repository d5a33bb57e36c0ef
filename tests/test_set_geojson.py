"""GeoJSON of layered plans and sets: round trips and every refusal."""

import json

from pyspark.sql import functions as F
from riskgrid.operators import set_geojson
from riskgrid.plans import sets

ROW = "set_id string, layer string, objective string, plan_id string, reference_plan_id string, waypoints array<struct<lon:double,lat:double,eta_us:bigint,mps:double>>"
DOCUMENTS = "plan_id string, geojson string"


def plans(name="s"):
    return [(name, layer, objective, f"{name}/{k}", None if k < 3 else f"{name}/0", [(18.25 + k, 70.1, 10 * k, None), (18.5, 70.0, 10 * k + 5, 4.125)]) for k, (layer, objective) in enumerate(set_geojson.PLACES)]


def test_round_trips(spark):
    df = spark.createDataFrame(plans() + plans("t"), ROW)
    sets = set_geojson.set_collections(df)
    first = json.loads(sets.where("set_id = 's'").first().geojson)
    assert [f["geometry"]["type"] for f in first["features"]] == ["LineString"] * len(set_geojson.PLACES)
    assert [(f["properties"]["layer"], f["properties"]["objective"]) for f in first["features"]] == set_geojson.PLACES
    for read, documents in ((set_geojson.read_sets, sets), (set_geojson.read_plans, set_geojson.plan_collections(df))):
        got, problems = read(documents)
        assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, df.collect()))
        assert problems.count() == 0
    empty = spark.createDataFrame([], ROW)
    assert set_geojson.set_collections(empty).count() == set_geojson.plan_collections(empty).count() == 0


def test_incomplete_sets_give_no_collection(spark):
    rows = plans()
    for some in (rows[1:], rows + rows[:1], [*rows[1:], ("s", "x", *rows[0][2:])], [*rows, ("s", None, *rows[0][2:])]):
        assert set_geojson.set_collections(spark.createDataFrame(some, ROW)).count() == 0


def test_every_refusal_of_a_plan(spark):
    whole = json.loads(set_geojson.plan_collections(spark.createDataFrame(plans()[4:5], ROW)).first().geojson)

    def changed(change):
        d = json.loads(json.dumps(whole))
        change(d["features"])
        return json.dumps(d)

    cases = {
        "": {"not a feature collection"},
        "{": {"not a feature collection"},
        '{"type":"FeatureCollection"}': {"not a feature collection"},
        changed(lambda f: f[0].update(type="x")): {"feature is no route"},
        changed(lambda f: f[0]["geometry"].update(type="Point")): {"geometry is no line"},
        changed(lambda f: f[0]["geometry"].update(coordinates=[[1.0], [2.0, 3.0]])): {"geometry is no line", "a waypoint does not match"},
        changed(lambda f: f[0].update(id="x")): {"id is not the plan's"},
        changed(lambda f: f[0]["properties"]["waypoint_etas"].append(1)): {"arrays of different lengths"},
        changed(lambda f: f.pop()): {"another number of waypoints"},
        changed(lambda f: f[2]["properties"].update(index=0)): {"a waypoint does not match"},
        changed(lambda f: f[1]["properties"].update(recommended_speed_mps=1.0)): {"a waypoint does not match"},
        changed(lambda f: f[2].update(id="s/4:waypoint:2")): {"a waypoint does not match"},
        changed(lambda f: f[1]["geometry"].update(coordinates=[0.0, 0.0])): {"a waypoint does not match"},
        changed(lambda f: f[1]["properties"].update(plan_id="x")): {"a waypoint does not match"},
    }
    keyed = list(cases)
    for k, text in enumerate(keyed):
        got, problems = set_geojson.read_plans(spark.createDataFrame([("s/4", text)], DOCUMENTS))
        assert {r.problem for r in problems.collect()} == cases[text], (k, text)
        assert got.count() == 0
    _, problems = set_geojson.read_plans(spark.createDataFrame([("other", json.dumps(whole)), (None, None)], DOCUMENTS))
    assert {tuple(r) for r in problems.collect()} == {("other", "not the plan"), (None, "not a feature collection")}


def test_drawn_plans_are_dealt_by_their_number(spark, sf_dir):
    """Few bytes become many texts: all tasks of the session make them (one did, by the bytes that were exchanged)."""
    own = sets.drawn_plans(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(own) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_what_is_no_whole_collection(spark):
    """A text that ends early, and features that are no array, give no features; other spacing changes nothing."""
    text = set_geojson.plan_collections(spark.createDataFrame(plans()[:1], ROW)).first().geojson
    odd = [text[:-1], text[: len(text) // 2], f"[{text}]", '{"type":"FeatureCollection","features":{}}', '{"type":"FeatureCollection","features":"[]"}', '{"type":5,"features":[]}', "1"]
    got, problems = set_geojson.read_plans(spark.createDataFrame([("s/0", t) for t in odd], DOCUMENTS))
    assert [r.problem for r in problems.collect()] == ["not a feature collection"] * len(odd) and got.count() == 0
    spaced = json.dumps(json.loads(text), indent=1)
    got, problems = set_geojson.read_plans(spark.createDataFrame([("s/0", spaced)], DOCUMENTS))
    assert problems.count() == 0 and got.count() == 1
