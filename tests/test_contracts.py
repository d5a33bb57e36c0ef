"""Contracts, committed windows, documents, settings, times: each on a small table with good and bad rows."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from riskgrid.functions import motion, values
from riskgrid.operators import codec, hash_tree, replan, shared, validate, windows
from riskgrid.operators.shared import folder
from riskgrid.sources import config, frames
from riskgrid.sources.cube import HOUR, T0

SHA = "a" * 64


def rules_of(spark, schema, rows, rules, key="id"):
    found = validate.violations(spark.createDataFrame(rows, schema), rules, [key]).collect()
    return {(r[key], r.rule) for r in found}


def test_frame_and_source_rules(spark):
    schema = "id string, risk_id string, config_digest string, model_digest string, generation int, as_of bigint, generated bigint, sources array<struct<source_id:string,data_id:string,checksum:string,issue_time:bigint>>"
    good = ("good", "risk-1", SHA, SHA, 0, 5, 6, [("s", "d", SHA, 5)])
    rows = [good, ("bad", "Risk 1", "x", SHA, -1, 7, 6, []), ("late", "risk-2", SHA, None, None, 5, 5, [(" ", "d", SHA, 9)])]
    assert rules_of(spark, schema, rows, validate.frame_rules()) == {("bad", "risk_id"), ("bad", "config_digest"), ("bad", "generation is negative"), ("bad", "known after it was made"), ("late", "model_digest"), ("late", "generation is negative")}
    assert rules_of(spark, schema, rows, validate.source_rules()) == {("bad", "no source"), ("late", "blank source field"), ("late", "issued after it was known")}


def test_observation_policy_and_plan_rules(spark):
    schema = "id string, avg_risk double, max_risk double, deviation_km double, data_revision bigint, risk_revision string"
    rows = [("good", 0.2, 0.4, 0.0, 0, "r"), ("bad", 0.9, 0.4, -1.0, -1, " "), ("out", None, 1.5, 1.0, 1, "r")]
    assert rules_of(spark, schema, rows, validate.observation_rules()) == {("bad", "avg_risk over max_risk"), ("bad", "deviation is negative"), ("bad", "data_revision is negative"), ("bad", "risk_revision is blank"), ("out", "avg_risk outside [0, 1]"), ("out", "max_risk outside [0, 1]")}
    schema = "id string, change double, high double, clear double, gain double, hysteresis double, deviation_km double, min_interval_us bigint"
    rows = [("good", 0.1, 0.65, 0.55, 0.03, 0.02, 10.0, 0), ("bad", 1.1, 0.5, 0.6, 0.1, 0.1, -1.0, -1)]
    assert rules_of(spark, schema, rows, validate.policy_rules()) == {("bad", "change outside [0, 1]"), ("bad", "clear over high"), ("bad", "deviation_km is negative"), ("bad", "interval is negative")}
    steps = spark.createDataFrame([("good", 0, 1, 0.1, 0.2, False), ("good", 1, 2, 0.1, 0.2, False), ("bad", 0, 5, 0.3, 0.2, True), ("bad", 1, 5, 0.1, 0.2, False), ("one", 0, 1, 0.1, 0.2, False)], "route string, step int, eta_us bigint, risk double, max_risk double, hard boolean")
    assert {(r.route, r.rule) for r in validate.plan_rules(steps).collect()} == {("bad", "ETAs do not rise"), ("bad", "average over maximum"), ("bad", "crosses a hard cell"), ("one", "fewer than two waypoints")}
    a, b = (spark.createDataFrame([(x,) for x in xs], "lat double") for xs in ((1.0, 2.0), (2.0, 3.0)))
    assert {(r.lat, r.only) for r in validate.axis_mismatch(a, b, "lat").collect()} == {(1.0, "left"), (3.0, "right")}
    assert validate.axis_mismatch(a, a, "lat").isEmpty()


def test_formal_replans_and_generations(spark):
    schema = "key string, at_us bigint, valid_us bigint, start_us bigint, revision bigint, last_revision bigint, risk_revision string, commit_id string, has_prior boolean"
    now = spark.createDataFrame([("good", 1, 1, 1, 2, 1, "c", "c", True), ("bad", 1, 2, 1, 1, 1, "c", "d", False)], schema)
    assert {(r.key, r.rule) for r in replan.formal_violations(now).collect()} == {("bad", "observed at another time than the start"), ("bad", "revision does not rise"), ("bad", "risk revision is not the committed window"), ("bad", "no plan to replace")}
    state = replan.Baseline(at_us=5)
    assert state.enter(2) and state.at_us is None and state.enter(2) and not state.enter(1) and state.generation == 2


def test_windows_are_committed_once(spark):
    path = folder(spark, "test-window")
    rows = spark.createDataFrame([(k, f"frame-{k}", None if k else 1.5) for k in range(20)], "valid bigint, risk_id string, x double")
    with pytest.raises(LookupError):
        windows.committed_window(spark, path)
    digest = windows.commit_window(rows, path)
    assert windows.commit_window(rows.repartition(5, "risk_id").orderBy(F.desc("valid")), path) == digest
    for other in (rows.where("valid > 0"), rows.withColumn("x", F.lit(1.0)), rows.unionByName(rows.limit(1))):
        with pytest.raises(ValueError):
            windows.commit_window(other, path)
    assert windows.committed_window(spark, path, digest, check=True).count() == 20
    with pytest.raises(LookupError):
        windows.committed_window(spark, path, "0" * 64)


def test_published_frames_keep_their_content(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "risk_id string, digest string")
    new = spark.createDataFrame([("b", "2"), ("c", "3"), ("c", "3")], store.schema)
    assert [tuple(r) for r in windows.merge_published(store, new).collect()] == [("c", "3")]
    for bad in ([("a", "9")], [("d", "1"), ("d", "2")]):
        with pytest.raises(ValueError):
            windows.merge_published(store, spark.createDataFrame(bad, store.schema))


def test_times_and_buckets(spark):
    texts = {"2026-01-01T00:00:00Z": T0, "2026-01-01T00:00:00.000001+00:00": T0 + 1, "2026-01-01T01:00:00+01:00": None, "2026-01-01": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", values.utc_micros(F.col("t")).alias("us"), values.utc_text(values.utc_micros(F.col("t"))).alias("back")).collect()
    assert {r.t: r.us for r in rows} == texts
    assert {r.back for r in rows} == {"2026-01-01T00:00:00Z", "2026-01-01T00:00:00.000001Z", None}
    got = spark.range(1).select(motion.bucket(F.lit(T0 + HOUR), F.lit(T0), HOUR).alias("a"), motion.bucket(F.lit(T0 + HOUR - 1), F.lit(T0), HOUR).alias("b")).first()
    assert (got.a, got.b) == (1, 0)


def test_frame_documents_and_their_faults(spark, sf_dir):
    from riskgrid.plans import QUERIES

    made = QUERIES["frame_documents"](spark, sf_dir)
    first = json.loads(made.first().document)
    whole = {k: first.get(k, "x") for k in codec.FRAME_KEYS} | {"risk_id": ""}
    whole["risk_id"] = codec.canonical_risk_id(whole)
    moved = whole | {"source_summary": list(reversed(whole["source_summary"]))}
    rows = {"good": whole, "same": moved, "changed": whole | {"generation_id": 7}, "more": whole | {"extra": 1}}
    texts = [(k, json.dumps(v)) for k, v in rows.items()] + [("not json", "{"), ("null", None)]
    found = {r.id: r.problem for r in codec.tampered(spark.createDataFrame(texts, "id string, document string")).collect()}
    assert found == {"changed": "id does not match content", "more": "frame: unknown extra", "not json": "not JSON", "null": "not JSON"}
    assert codec.grid_digest([1.0, 2.0], [3.0]) != codec.grid_digest([1.0], [2.0, 3.0, 0.0])
    assert codec.window_digest({"a": 1}, [whole]) != codec.window_digest({"a": 2}, [whole])
    path = folder(spark, "test-documents")
    spark.createDataFrame(texts[:4], "id string, value string").select("value").repartition(4).write.text(path)
    assert frames.headers(frames.read_documents(spark, path, whole_files=False)).count() == 4
    digests = frames.file_digests(spark, f"{path}/*.txt").collect()
    assert digests and all(len(r.sha256) == 64 and r.n_bytes > 0 for r in digests)


def test_first_version_frames_are_lifted_and_marked(spark):
    old = {"schema_version": frames.V1, "risk_id": "risk-1", "model_version": "3", "valid_time": "2026-01-01T00:00:00Z", "generation_id": 0, "provenance": "measured"}
    docs = spark.createDataFrame([(json.dumps(old),), (json.dumps(old | {"schema_version": frames.V2}),)], "document string")
    with pytest.raises(ValueError):
        frames.lifted(frames.headers(docs), "run-1", SHA, acknowledged=False)
    rows = frames.lifted(frames.headers(docs), "run-1", SHA, acknowledged=True).collect()
    assert [(r.schema_version, r.run_id, r.model_version, r.provenance, r.valid_us, r.source_summary[0].quality_flag) for r in rows] == [(frames.V2, "run-1", "legacy-v1:3", frames.LEGACY, T0, frames.LEGACY)]


SHIP = 'schema_version = "c.vessel-model-config.v1"\nvessel_profile_id = "ship"\nvessel_profile_version = "1"\neconomic_speed_knots = 10\nminimum_steerage_speed_knots = 3.0\nmaximum_speed_knots = 15.7\nminimum_speed_factor = 0.2\nturn_radius_m = 2000.0\nunder_keel_clearance_m = 2.0\nbathymetry_hard_constraint_enabled = false\ncalibration_status = "demo_unvalidated"\nsource_notes = "none"\n'


def test_settings(spark, tmp_path):
    def put(section, name, text):
        (tmp_path / section).mkdir(exist_ok=True)
        (tmp_path / section / f"{name}.toml").write_text(text)

    root = f"file://{tmp_path}"
    put("planner", "default", "connectivity = 4\n[fastest]\ntravel_time = 2.0\nrisk = 0.1\ndistance = 0.0\nturn = 0\nuncertainty = 0.0\n")
    put("replanning", "default", "hysteresis = 0.05\n")
    put("vessel_models", "ship", SHIP)
    got = config.load(spark, root, "ship")
    assert got.objectives["fastest"].time == 2.0 and got.objectives["low_risk"] == motion.OBJECTIVES["low_risk"]
    assert (got.search_options()["connectivity"], got.bucket_us, got.vessel.maximum) == (4, HOUR, 15.7)
    assert (got.policy.change, got.policy.clear, got.policy.gain) == (0.05, 0.65 - 0.05, 0.05)
    put("planner", "same", (tmp_path / "planner/default.toml").read_text() + "\n# a remark\n")
    assert config.load(spark, root, "ship", planner="same").digest == got.digest
    for name, text, says in [
        ("odd", 'edge_sample_count = 4\nallow_waiting = true\nspeed = 1\ntime_bucket_minutes = "x"\n', ["edge_sample_count must be odd", "allow_waiting must be false", "speed is unknown", "time_bucket_minutes must be of type int"]),
        ("zero", "[fastest]\ntravel_time = 0\nrisk = 0\ndistance = 0\nturn = 0\nuncertainty = 0\n", ["one weight at least"]),
        ("broken", "a = = 1", ["is not TOML"]),
    ]:
        put("planner", name, text)
        with pytest.raises(config.ConfigError) as e:
            config.load(spark, root, "ship", planner=name)
        assert all(s in str(e.value) for s in says)
    for vessel in ("../ship", "none"):
        with pytest.raises(config.ConfigError):
            config.load(spark, root, vessel)
    put("vessel_models", "slow", SHIP.replace("= 15.7", "= 5.0"))
    with pytest.raises(config.ConfigError, match="steerage <= economic"):
        config.load(spark, root, "slow")


def cells(n_frames=3, changed=None):
    return [(k, i, j, k * 10, 70.0 + i, 18.0 + j, None if (k, i, j) == (0, 1, 1) else 0.1 * k + 0.01 * i, (k, i, j) == changed, 0.5, None if i == 0 else 0.9) for k in range(n_frames) for i in range(2) for j in range(3)]


CELLS = "frame int, row int, col int, valid_us bigint, lat double, lon double, risk double, hard boolean, confidence double, factor double"


def test_hash_tree_by_hand(spark):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def fixed(x):
        return "null" if x is None else str(round(x * 1e9))

    frames = {}
    for k, i, j, us, lat, lon, risk, hard, conf, factor in cells():
        frames.setdefault((k, us), {}).setdefault(i, {})[j] = sha("|".join([fixed(lat), fixed(lon), fixed(risk), str(hard).lower(), fixed(conf), fixed(1.0 if factor is None else factor)]))
    want = {us: sha("".join(sha("".join(v for _, v in sorted(line.items()))) for _, line in sorted(lines.items()))) for (_, us), lines in frames.items()}
    got = hash_tree.frame_digests(spark.createDataFrame(cells(), CELLS).repartition(3))
    assert {r.valid_us: r.digest for r in got.collect()} == want
    assert hash_tree.window_digest(got).first().digest == sha(",".join(f"{us}:{d}" for us, d in sorted(want.items())))
    assert hash_tree.window_digest(got.limit(0)).first().digest == sha("")


def test_committed_cells_are_checked_frame_by_frame(spark, tmp_path):
    cube = spark.createDataFrame(cells(), CELLS)
    path = f"file://{tmp_path}/window"
    root = windows.commit_cells(cube, path)
    assert windows.commit_cells(cube.repartition(2), path) == root
    other = spark.createDataFrame(cells(changed=(1, 0, 2)), CELLS)
    with pytest.raises(ValueError):
        windows.commit_cells(other, path)
    assert windows.committed_cells(spark, path, root).count() == 18
    changed = hash_tree.changed_frames(hash_tree.frame_digests(cube), hash_tree.frame_digests(other)).collect()
    assert [(r.valid_us, r.change) for r in changed] == [(10, "other")]
    # frame 1 is changed behind the manifest: who reads it is told, who reads the others isn't stopped
    base = open(f"{tmp_path}/window/manifest").read().split(" ", 1)[1]
    other.write.mode("overwrite").parquet(f"{base}/cells")
    assert windows.committed_cells(spark, path, root, [0, 20]).count() == 12
    for some in ([10], None):
        with pytest.raises(ValueError):
            windows.committed_cells(spark, path, root, some)
    with pytest.raises(LookupError):
        windows.committed_cells(spark, path, "0" * 64)


def test_a_lost_writer_leaves_the_key_free(spark, tmp_path):
    """A writer that dies before its rename leaves a file of another name only."""
    path = f"{tmp_path}/key"
    os.makedirs(path)
    open(f"{path}/manifest.{'0' * 32}.new", "w").close()
    rows = spark.createDataFrame([(1, "a")], "valid bigint, risk_id string")
    digest = windows.commit_window(rows, f"file://{path}")
    assert windows.committed_window(spark, f"file://{path}", digest).count() == 1
    assert not shared.create_file(spark, f"file://{path}/manifest", "again") and open(f"{path}/manifest").read().startswith(digest)
    assert [f for f in os.listdir(path) if f.endswith(".new")] == [f"manifest.{'0' * 32}.new"]


def test_documents_are_made_one_at_a_time(monkeypatch):
    import pandas as pd
    from riskgrid.operators import documents

    told, read = [], documents.json.loads
    monkeypatch.setattr(documents.F, "pandas_udf", lambda _: lambda f: lambda texts: f(texts))
    monkeypatch.setattr(documents.F, "col", lambda _: pd.Series(['{"a":1}', '{"b":2}']))
    monkeypatch.setattr(documents.json, "loads", lambda t: told.append("read") or read(t))
    monkeypatch.setattr(documents, "plan_digest", lambda d: told.append("made") or "digest")
    assert list(documents._canonical("text").document) == ['{"a":1}', '{"b":2}'] and told == ["read", "made"] * 2
