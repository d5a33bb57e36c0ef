"""The layered set queries take every voyage and the layers' own cut-offs."""

from riskgrid.operators import layers, search
from riskgrid.plans import routes


def test_set_takes_every_voyage_and_layer(spark, sf_dir, monkeypatch):
    seen = {}

    def whole(cube, wanted, horizon_h, *cutoffs, **options):
        first, last = cube.selectExpr("min(valid_us)", "max(valid_us)").first()
        seen.update(ids=[r.search for r in wanted.collect()], cutoffs=cutoffs, spans=wanted.where(f"depart_us < {first} or depart_us + {horizon_h} * 3600000000 > {last}").count(), hours=horizon_h)
        return spark.createDataFrame([], "set_id string, layer string, objective string, step int, row int, col int, eta_us bigint, cost double")

    monkeypatch.setattr(layers, "layered_set", whole)
    routes.four_layer_set(spark, sf_dir)
    every = {r.search.split("/")[0] for r in routes.requests(spark, sf_dir).collect()}
    assert sorted(seen["ids"]) == sorted(every)
    assert not seen["cutoffs"] and not seen["spans"] and seen["hours"] >= max(h for _, h in layers.LAYERS if h)


def test_anchors_at_the_layers_cut_offs(spark, sf_dir, monkeypatch):
    hour = 3_600_000_000
    steps = spark.createDataFrame([("a", k, k, 0, t * hour) for k, t in enumerate((0, 5, 20, 60, 90))], "search string, step int, row int, col int, eta_us bigint")
    monkeypatch.setattr(routes, "_found", lambda *_: (steps, None))
    assert {(r.layer, r.row) for r in routes.layer_anchors(spark, sf_dir).collect()} == {("long_range", 3), ("medium_range", 2), ("short_range", 1)}


def test_sets_that_ask_the_same_are_made_once(spark, monkeypatch):
    hour, seen = 3_600_000_000, []

    def one_step(cube, wanted, **_):
        seen.append(wanted.count())
        far = wanted.selectExpr("search", "1 step", "r1 row", "c1 col", "depart_us + 1000 eta_us", "1D hours", "'ok' status")
        return far.unionByName(wanted.selectExpr("search", "0 step", "r0 row", "c0 col", "depart_us eta_us", "0D hours", "'ok' status"))

    monkeypatch.setattr(search, "routes", one_step)
    rows = [(f"{k}", 0, 0, 3, 3 + k % 2, 0, hour) for k in range(6)]
    wanted = spark.createDataFrame(rows, "search string, r0 int, c0 int, r1 int, c1 int, depart_us bigint, bucket_us bigint")
    made = layers.layered_set(spark.range(0), wanted, 96.0).collect()
    assert seen == [6, 18] and len(made) == 6 * 12 * 2
    assert {(r.set_id, r.col) for r in made if r.step} == {(f"{k}", 3 + k % 2) for k in range(6)}
