"""Decisions that wait fire at their time, in the fold and in the stream."""

import random

from riskgrid.operators import replan
from riskgrid.operators.shared import folder
from riskgrid.streaming.timers import Decider, timed_decisions

MINUTE = 60_000_000
SCHEMA = "key bigint, seq bigint, at_us bigint, valid_us bigint, data_revision bigint, risk_revision string, avg_risk double, max_risk double, deviation_km double, event string, manual boolean, hard boolean, published boolean, generation int"


def seen(seq, minute, key=0, deviation=0.0, generation=0, manual=False, published=True, event=None, risk=0.1):
    return (key, seq, minute * MINUTE, 0, 0, "r", risk, risk, deviation, event, manual, False, published, generation)


def decided(spark, rows, until=10**6):
    return [tuple(r)[1:] for r in replan.timed(spark.createDataFrame(rows, SCHEMA), until * MINUTE).sort("at_us", "seq").collect()]


def test_a_waiting_decision_fires_at_its_time(spark):
    rows = [seen(0, 0, manual=True), seen(1, 10, deviation=20.0), seen(2, 40)]
    assert decided(spark, rows) == [(0, 0, "fire", "manual", None), (1, 10 * MINUTE, "wait", "deviation", 30 * MINUTE), (1, 30 * MINUTE, "fire", "deviation", None), (2, 40 * MINUTE, "none", "", None)]
    assert decided(spark, rows[:2], until=29) == decided(spark, rows)[:2]
    assert decided(spark, rows[:2], until=30) == decided(spark, rows)[:3]


def test_the_latest_waits_and_a_fire_ends_it(spark):
    rows = [seen(0, 0, manual=True), seen(1, 10, deviation=20.0), seen(2, 12, deviation=30.0), seen(3, 13), seen(4, 30, deviation=11.0)]
    # the second waits in the first's place; at minute 30 it fires before the observation of that time, which then waits itself
    assert [(r[0], r[2], r[4]) for r in decided(spark, rows)] == [(0, "fire", None), (1, "wait", 30 * MINUTE), (2, "wait", 30 * MINUTE), (3, "none", None), (2, "fire", None), (4, "wait", 60 * MINUTE), (4, "fire", None)]
    forced = [seen(0, 0, manual=True), seen(1, 10, deviation=20.0), seen(2, 12, manual=True), seen(3, 41)]
    assert [(r[0], r[2]) for r in decided(spark, forced)] == [(0, "fire"), (1, "wait"), (2, "fire"), (3, "none")]


def test_generations(spark):
    rows = [seen(0, 0, manual=True, generation=1), seen(1, 10, deviation=20.0, generation=1), seen(2, 20, generation=0, manual=True), seen(3, 21, deviation=20.0, generation=2), seen(4, 50, generation=2)]
    # a later generation has no baseline: nothing to wait for, and what waited is gone
    assert [(r[0], r[2]) for r in decided(spark, rows)] == [(0, "fire"), (1, "wait"), (2, "stale"), (3, "fire"), (4, "none")]


def test_no_rows_and_incomplete_ones(spark):
    assert decided(spark, []) == []
    whole = seen(0, 0, manual=True)
    for name in replan.NEEDED:
        k = replan.TIMED_OBSERVATION.index(name)
        assert decided(spark, [whole, (*whole[:k], None, *whole[k + 1 :])]) == [(0, 0, "fire", "manual", None)]
    marks = tuple(None if replan.TIMED_OBSERVATION[k] in ("deviation_km", "hard", "published", "event", "risk_revision") else v for k, v in enumerate(whole))
    assert decided(spark, [marks]) == [(0, 0, "fire", "manual", None)]


def test_the_stream_decides_as_the_fold_whatever_the_order_of_files(spark):
    r = random.Random(3)
    rows = []
    for key in range(4):
        times = sorted(r.sample(range(600), 40))
        rows += [seen(i, t, key, r.choice([0.0, 0.0, 20.0]), t // 250 - (r.random() < 0.1), r.random() < 0.1, r.random() < 0.8, r.choice([None, None, "e"]), r.choice([0.1, 0.15, 0.3, 0.7])) for i, t in enumerate(times)]
    r.shuffle(rows)
    want = replan.timed(spark.createDataFrame(rows, SCHEMA), 2000 * MINUTE).collect()
    assert {x.outcome for x in want} == {"fire", "wait", "none", "stale"} and len(want) > len(rows)
    base = folder(spark, "test-timers")

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        sink = timed_decisions(source, "1000 minutes").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        sink.awaitTermination(120)
        sink.stop()

    half = len(rows) // 2
    run(rows[:half])
    run(rows[half:])
    # time passes, by another key; what comes behind it is late and not decided
    run([seen(0, 5000, 99)])
    run([seen(1000, 3000, 0, manual=True)])
    got = spark.read.schema(replan.TIMED).parquet(f"{base}/out")
    assert sorted(map(str, got.where("key < 99").collect())) == sorted(map(str, want))


def test_a_call_asks_the_store_as_often_whatever_it_holds():
    class Store:
        """Value state, handle and timer values in one, counting what it is asked."""

        value, asked, timers = None, 0, ()

        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.asked, self.value = self.asked + 1, value

        def registerTimer(self, at):  # noqa: N802
            self.asked, self.timers = self.asked + 1, (*self.timers, at)

        def deleteTimer(self, at):  # noqa: N802
            self.asked, self.timers = self.asked + 1, tuple(t for t in self.timers if t != at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10**9

    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    counts = []
    for n in (3, 300):
        store, decider = Store(), Decider(replan.Policy())
        decider.init(store)
        for part in (range(n, 2 * n), range(n)):
            list(decider.handleInputRows((0,), iter([dict(zip(columns, seen(i, i), strict=True)) for i in part]), store))
        assert store.timers == (0,)
        assert len(list(decider.handleExpiredTimer((0,), store, None))) == 2 * n
        counts.append(store.asked)
    assert counts[0] == counts[1]
