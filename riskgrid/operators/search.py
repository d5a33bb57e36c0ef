"""Time-dependent route search over a cube as joins, many searches at once.

A state is (node, time bucket, incoming move); its label is the least cost and
the arrival that goes with it. A crossing depends on the exact arrival, so a
label may be expanded only when no cheaper one can still reach its state.

All searches share every round. A round takes from the table of open labels
those that are final. A state's move names the node it comes from, so only a
label of that node can still better it: one that is open there, or one that a
crossing into that node is still to make, from the least open cost of the
search on. Both bounds take the least that a crossing can cost by the edge's
own risk, confidence and speed over all frames. Final labels meet the edges' series
in one broadcast join (a shuffle if they are many), go to their search's task in
one exchange, and there the least label of each state is kept, and what is
final next is found. A label whose cost plus bound (great circle to the goal
at the best speed) is not below the best known cost of its goal is dropped.
What a round writes is its frontier: open labels, labels settled in it with
the crossings refused to them, and the bare states settled before that a
crossing can still reach in time. So a task holds the frontiers of some
searches, bounded by the grid. Settled labels are written once and never read
again before the end.

The edges lie in folders by tile of the grid and chunk of frames; a round reads
those of its open labels. The round is a few SQL texts over views, the same each
time, so its code is compiled once; each is analysed by itself. Found routes are walked back by pointer
doubling: a number of joins that grows with the logarithm of the longest route.

Requests have search, objective, r0, c0, r1, c1, depart_us, horizon_us (NULL:
none) and bucket_us. The status of a search is

* ``ok``;
* ``start blocked``; ``error``: the start lies outside grid or window or its
  risk is unknown, or a crossing meets unknown risk before the goal is
  settled (crossings from labels whose cost plus bound is below the goal's
  cost; labels beyond that count for nothing);
* ``limit``: more than ``max_expansions`` labels have a cost plus bound below
  the goal's cost;
* ``no coverage``: no route, and horizon or window refused some crossing;
* ``no route``; and ``cancelled``: the search was not done when the budget of
  seconds or the ``cancelled`` predicate ended the rounds.

Requests that ask the same have the same answer, so they are one search: the
work follows what is asked, not how often (``Search.same`` tells which request
is answered by which). The cube is written once, whatever it is counted from.

Ties between routes of equal cost are settled by arrival, then by the parent's
state; only cost, distance and hours are promised. Search ids are unique; an
empty cube gives errors; no requests give no rows.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions.geo import HAVERSINE_SQL, haversine_km
from riskgrid.functions.motion import KNOT_KMH, OBJECTIVES, Vessel, Weights
from riskgrid.functions.sql import double
from riskgrid.operators.edges import MAX_GAP_US, MIN_CONFIDENCE, POINTS, ROWS, crossing_steps, edge_series, frame_sql, frames_ahead, in_chunks
from riskgrid.operators.grid import edges, nodes
from riskgrid.operators.sample import axis_literal, axis_of, sample
from riskgrid.operators.shared import folder, together, written

MAX_EXPANSIONS = 250_000
#: Tiles of the edge table along rows and columns at most (a bit of a long each), their least side, and frames of a chunk.
TILES, SIDE, CHUNK = (7, 9), 4, 24
#: Rows that a round may broadcast (about 300 bytes each), and rounds between two looks at the limit.
BROADCAST_ROWS, LOOK = 100_000, 32
#: Labels of a frontier for each task that finds the next one, as many tasks as the session shuffles to at most.
FRONTIER_ROWS = 400

WEIGHTS = ("time", "risk", "distance", "turn", "uncertainty", "deviation")
STATE = ("row", "col", "bucket", "dr", "dc")
REFUSED = ("hard", "risk", "speed", "coverage", "error")
#: Figures of the crossing that led to a label.
CROSSED = ("km", "hours", "knots", "heading", "risk", "max_risk", "confidence", "risk_hours", "frame_low", "frame_high")
_CROSSED = "struct<km:double,hours:double,knots:double,heading:double,risk:double,max_risk:double,confidence:double,risk_hours:double,frame_low:int,frame_high:int>"
_PARENT = "struct<row:int,col:int,bucket:bigint,dr:int,dc:int>"
#: What a request asks; those that agree in all of it are one search.
ASKS = ("objective", "r0", "c0", "r1", "c1", "depart_us", "horizon_us", "bucket_us")
#: What was asked, in every open label: so a round joins nothing but edges.
ASKED = ("begin_us", "horizon_us", "bucket_us", "r1", "c1", "goal_lat", "goal_lon", "per_km", *(f"w_{x}" for x in WEIGHTS))
_ASKED = "struct<begin_us:bigint,horizon_us:bigint,bucket_us:bigint,r1:int,c1:int,goal_lat:double,goal_lon:double,per_km:double," + ",".join(f"w_{x}:double" for x in WEIGHTS) + ">"
_LABEL = f"struct<closed:boolean,at:int,goal:boolean,cost:double,arrive_us:bigint,bound:double,step:double,far:double,parent:{_PARENT},crossed:{_CROSSED},asked:{_ASKED}>"
#: ``k`` is the round that wrote a row, ``now`` marks what is final in the next one.
FRONTIER = f"search string, row int, col int, bucket bigint, dr int, dc int, k int, now boolean, v {_LABEL}, {', '.join(f'n_{x} bigint' for x in REFUSED)}"

STEPS = "search string, step int, row int, col int, eta_us bigint, km double, hours double, knots double, heading double, risk double, max_risk double, confidence double, cost double, risk_hours double, frame_low int, frame_high int"
RESULT = f"{STEPS}, status string"


@dataclass
class Search:
    """A run of searches: each request (search) with the one that is searched for it (of), what was asked of those, all settled labels, and how far it came."""

    same: DataFrame
    wanted: DataFrame
    starts: DataFrame
    labels: DataFrame
    rounds: int = 0
    open_labels: int = 0
    cancelled: bool = False
    links: DataFrame | None = None
    max_expansions: int = MAX_EXPANSIONS
    progress: list[dict[str, Any]] = field(default_factory=list)


def _starts(cube: DataFrame, wanted: DataFrame, times: list[int], max_gap_us: int) -> DataFrame:
    """The sample at each search's start: status, risk, hard, confidence, and the frames used."""
    at = wanted.join(nodes(cube).select(F.col("row").alias("r0"), F.col("col").alias("c0"), "lat", "lon"), ["r0", "c0"])
    seen = sample(at.select(F.col("search").alias("point_id"), "lat", "lon", F.col("depart_us").alias("t_us")), cube, max_gap_us)
    status = F.when(F.coalesce(F.col("status"), F.lit("outside")) != "ok", "error").when(F.col("hard"), "start blocked").otherwise("ok")
    met = wanted.select("search", "depart_us").join(seen.withColumnRenamed("point_id", "search"), "search", "left")
    axis = axis_literal(times).cast("array<bigint>")
    low = F.size(F.filter(axis, lambda v: v <= F.col("depart_us"))) - 1
    exact = F.array_contains(axis, F.col("depart_us"))
    return met.select("search", F.coalesce(status, F.lit("error")).alias("start_status"), F.col("risk").alias("start_risk"), F.col("confidence").alias("start_confidence"), low.alias("start_low"), F.when(exact, low).otherwise(low + 1).alias("start_high"))


def distinct(requests: DataFrame, base: str, asks: tuple[str, ...] = ASKS) -> tuple[DataFrame, DataFrame]:
    """One request of all that ask the same, and (search, of): which of these answers each. Both are written below ``base``."""
    one = written(requests.groupBy(*asks).agg(F.min("search").alias("of")), f"{base}/distinct")
    met = requests.select("search", *asks).alias("a").join(one.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in asks])
    return one.withColumnRenamed("of", "search"), written(met.select("search", "of"), f"{base}/same")


def _asked(spark: SparkSession, cube: DataFrame, requests: DataFrame, vessel: Vessel, objectives: dict[str, Weights], use_bound: bool) -> DataFrame:
    """Requests with their weights, the place of the goal, and the bound's cost of a kilometre."""
    # literals: rows from the driver would start Python workers for a handful of numbers
    policies = F.array(*(F.struct(F.lit(k).alias("objective"), *(F.lit(float(getattr(w, x))).alias(f"w_{x}") for x in WEIGHTS)) for k, w in objectives.items()))
    table = spark.range(1).select(F.inline(policies))
    goal = nodes(cube).select(F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("lat").alias("goal_lat"), F.col("lon").alias("goal_lon"))
    asked = requests.select("search", *ASKS)
    # a row for each policy: bounded by the code, not by data
    asked = asked.join(F.broadcast(table), "objective").join(goal, ["r1", "c1"], "left")
    return asked.withColumn("per_km", ((F.col("w_time") + F.col("w_distance")) / vessel.maximum_kmh) if use_bound else F.lit(0.0))


def _first(wanted: DataFrame, starts: DataFrame, cube: DataFrame) -> DataFrame:
    """The open label of every start."""
    none = F.lit(None).cast("double")
    place = nodes(cube).select(F.col("row").alias("r0"), F.col("col").alias("c0"), "lat", "lon")
    begin = wanted.join(starts.where("start_status = 'ok'"), "search").where("goal_lat is not null").join(place, ["r0", "c0"])
    crossed = {"km": F.lit(0.0), "hours": F.lit(0.0), "knots": none, "heading": none, "risk": F.col("start_risk"), "max_risk": F.col("start_risk"), "confidence": F.col("start_confidence"), "risk_hours": F.lit(0.0), "frame_low": F.col("start_low"), "frame_high": F.col("start_high")}
    goal = (F.col("r0") == F.col("r1")) & (F.col("c0") == F.col("c1"))
    bound = F.col("per_km") * haversine_km(F.col("lat"), F.col("lon"), F.col("goal_lat"), F.col("goal_lon"))
    asked = F.struct(F.col("depart_us").alias("begin_us"), *ASKED[1:])
    label = F.struct(F.lit(False).alias("closed"), F.lit(0).alias("at"), goal.alias("goal"), F.lit(0.0).alias("cost"), F.col("depart_us").alias("arrive_us"), bound.alias("bound"), F.lit(0.0).alias("step"), F.lit(0.0).alias("far"), F.lit(None).cast(_PARENT).alias("parent"), F.struct(*(v.alias(k) for k, v in crossed.items())).alias("crossed"), asked.alias("asked"))
    state = {"row": F.col("r0"), "col": F.col("c0"), "bucket": F.lit(0).cast("long"), "dr": F.lit(9), "dc": F.lit(9), "k": F.lit(0), "now": F.lit(True)}
    return begin.select("search", *(v.alias(k) for k, v in state.items()), label.cast(_LABEL).alias("v"), *(F.lit(0).cast("long").alias(f"n_{x}") for x in REFUSED))


def _round_sql(work: str, links: str, times: list[int], vessel: Vessel, min_confidence: float, max_risk: float | None, max_gap_us: int) -> list[str]:
    """One round over the views ``work`` and ``links`` ({where}, {hint} and {tasks} are filled in), each text over the rows (``ROWS``) of the one before."""
    weights = {x: f"w_{x}" for x in WEIGHTS}

    def struct(of: dict[str, str]) -> str:
        return f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in of.items())})"

    def least(km: str, factor: str, risk: str, confidence: str) -> str:
        hours = f"{km} / (least({double(vessel.maximum)}, {double(vessel.economic)} * least(1D, {factor})) * {double(KNOT_KMH)})"
        return f"({hours} * (w_time + w_risk * {risk} + w_uncertainty * greatest(0D, 1D - {confidence})) + w_distance * {km} / {double(vessel.maximum_kmh)}) * 0.999999999D"

    new = {
        "closed": "false",
        "at": "CAST(0 AS INT)",
        "goal": "r2 = r1 AND c2 = c1",
        "cost": "cost0 + total_hours",
        "arrive_us": "arrive_us",
        # a part in 1e9 less, so that rounding can't lift it over the true cost
        "bound": "per_km * " + HAVERSINE_SQL.format(a="lat2", x="lon2", b="goal_lat", y="goal_lon") + " * 0.999999999D",
        # least cost of the crossing into the state, and of it and any one into the node before
        "step": least("km", "best_factor", "low_risk", "best_confidence"),
        "far": f"{least('km', 'best_factor', 'low_risk', 'best_confidence')} + {least('in_km', 'in_factor', 'in_risk', 'in_confidence')}",
        "parent": struct({"row": "r", "col": "c", "bucket": "b_0", "dr": "dr_0", "dc": "dc_0"}),
        "crossed": struct({c: c for c in CROSSED}),
        "asked": struct({c: c for c in ASKED}),
    }
    kept = {
        "closed": "v.closed OR now",
        "at": "CAST(IF(now, k + 1, v.at) AS INT)",
        **{c: f"v.{c}" for c in ("goal", "cost", "arrive_us", "bound", "step", "far")},
        # a state settled before is only named
        "parent": "IF(v.closed, NULL, v.parent)",
        "crossed": "IF(v.closed, NULL, v.crossed)",
        "asked": "IF(v.closed OR now, NULL, v.asked)",
    }
    frame, _, _ = frame_sql(times)
    # no common table expressions: each is looked for in the whole plan again
    begun = f"""SELECT search, row, col, bucket AS b_0, dr AS dr_0, dc AS dc_0, k, v.cost AS cost0, v.arrive_us AS depart_us, v.crossed.heading AS heading_before, {', '.join('v.asked.' + c for c in ASKED)},
    {frame.replace('{t}', 'v.arrive_us')} div {CHUNK} AS chunk FROM {work} WHERE now AND NOT v.goal"""
    leaving = f"""SELECT {{hint}} b.*, e.r, e.c, e.dr, e.dc, e.r2, e.c2, e.lat2, e.lon2, e.km, e.heading, e.points, e.low_risk, e.best_factor, e.best_confidence, e.in_km, e.in_factor, e.in_risk, e.in_confidence
    FROM ({begun}) b JOIN {links} e ON b.row = e.r AND b.col = e.c AND b.chunk = e.chunk WHERE {{where}}"""
    crossing = crossing_steps(times, vessel, weights, min_confidence, None if max_risk is None else double(max_risk), max_gap_us, f"chunk * {CHUNK}")
    to = {"row": ("r2", "r"), "col": ("c2", "c"), "bucket": ("(arrive_us - begin_us) div bucket_us", "b_0"), "dr": ("dr", "dr_0"), "dc": ("dc", "dc_0")}
    state, refused = ", ".join(STATE), ", ".join(f"sum(n_{x}) AS n_{x}" for x in REFUSED)
    own = f"search, {state}"
    refusal = f"SELECT *, CASE WHEN reject IS NOT NULL THEN reject WHEN arrive_us - begin_us > horizon_us THEN 'coverage' END AS why FROM {ROWS}"
    either = f"""SELECT search, {', '.join(f'IF(why IS NULL, {a}, {b}) AS {k}' for k, (a, b) in to.items())}, k, IF(why IS NULL, {struct(new)}, NULL) AS v, {', '.join(f"CAST(why <=> '{x}' AS BIGINT) AS n_{x}" for x in REFUSED)} FROM ({refusal})
    UNION ALL SELECT {own}, k, {struct(kept)} AS v, {', '.join(f'0L AS n_{x}' for x in REFUSED)} FROM {work}"""
    least_label = f"""SELECT {own}, max(k) + 1 AS k, min_by(v, IF(v IS NULL, NULL, struct(NOT v.closed, v.cost, v.arrive_us, v.parent))) AS v, {refused}
FROM (SELECT /*+ REPARTITION({{tasks}}, search) */ * FROM ({either})) GROUP BY {own}"""
    final = f"""SELECT {own}, k, NOT v.closed AND (v.cost <= m OR v.cost < least(before + v.step, m + v.far)) AS now, v, {', '.join(f'n_{x}' for x in REFUSED)}
FROM (SELECT *, min(IF(v.closed, NULL, v.cost)) OVER w AS m, min(IF(v.goal, v.cost, NULL)) OVER w AS u, min(IF(v.closed, NULL, bucket)) OVER w AS first_bucket
    FROM (SELECT *, min(IF(told, v.cost, NULL)) OVER (PARTITION BY search, r, c) AS before
        FROM (SELECT a.*, told, r, c FROM {ROWS} a LATERAL VIEW inline(IF(v.closed, array(named_struct('told', false, 'r', row, 'c', col)), array(named_struct('told', true, 'r', row, 'c', col), named_struct('told', false, 'r', row - dr, 'c', col - dc)))) x AS told, r, c))
    WHERE NOT told WINDOW w AS (PARTITION BY search))
WHERE IF(v.closed, v.at = k OR v.goal OR bucket >= first_bucket, v.goal OR u IS NULL OR v.cost + v.bound < u)"""
    return [leaving, *crossing, least_label, final]


def _too_many(labels: DataFrame, work: DataFrame, most: int) -> DataFrame:
    """Searches with more settled labels below their least open cost plus bound than they may expand: all of these come before any goal."""
    least = work.where("not v.closed").groupBy("search").agg(F.min(F.col("v.cost") + F.col("v.bound")).alias("f"))
    return labels.join(least, "search").where("v.cost + v.bound < f").groupBy("search").count().where(F.col("count") > most).select("search")


def _quick(spark: SparkSession) -> SparkSession:
    """A session beside this one that plans a query once: rounds tell their numbers of tasks and what is broadcast from counts, and planning again after each stage costs more than it runs."""
    quick = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        quick.conf.set(name, spark.conf.get(name))
    quick.conf.set("spark.sql.adaptive.enabled", "false")
    return quick


def run(
    cube: DataFrame,
    requests: DataFrame,
    vessel: Vessel | None = None,
    objectives: dict[str, Weights] | None = None,
    min_confidence: float = MIN_CONFIDENCE,
    max_gap_us: int = MAX_GAP_US,
    connectivity: int = 8,
    n: int = POINTS,
    max_spacing_km: float | None = None,
    max_risk: float | None = None,
    max_expansions: int = MAX_EXPANSIONS,
    use_bound: bool = True,
    cancelled: Callable[[], bool] = lambda: False,
    budget_s: float | None = None,
    progress: Callable[[dict[str, Any]], None] | None = None,
) -> Search:
    """All rounds of all requests.

    progress is told of each round (round, labels in its frontier, open ones,
    settled in it). cancelled is asked before each round. After ``budget_s``
    seconds the jobs of the running round are interrupted by their tag and no
    other begins.
    """
    spark = cube.sparkSession
    vessel, objectives = vessel or Vessel(), objectives or OBJECTIVES
    base = folder(spark, "search")
    cube = written(cube, f"{base}/cube")
    times = axis_of(cube, "frame", "valid_us")
    frontier = spark.createDataFrame([], FRONTIER).schema

    def asked() -> tuple[DataFrame, ...]:
        one, same = distinct(requests, base)
        wanted = written(_asked(spark, cube, one, vessel, objectives, use_bound), f"{base}/wanted")
        if not times:
            return same, wanted
        starts = written(_starts(cube, wanted, times, max_gap_us), f"{base}/starts")
        return same, wanted, starts, written(_first(wanted, starts, cube), f"{base}/0")

    if not times:
        same, wanted = asked()
        starts = wanted.select("search", F.lit("error").alias("start_status"))
        return Search(same, wanted, starts, spark.createDataFrame([], frontier), max_expansions=max_expansions)
    size = cube.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    high, wide = (max(SIDE, -(-(most + 1) // parts)) for most, parts in zip((size.r, size.c), TILES, strict=True))

    def tile(row: str, col: str) -> str:
        return f"CAST({row} div {high} * {TILES[1]} + {col} div {wide} AS INT)"

    def linked() -> DataFrame:
        series = written(edge_series(cube, edges(nodes(cube), connectivity), len(times), n, max_spacing_km), f"{base}/series")
        into = series.groupBy(F.col("r2").alias("r"), F.col("c2").alias("c")).agg(F.min("km").alias("in_km"), F.max("best_factor").alias("in_factor"), F.min("low_risk").alias("in_risk"), F.max("best_confidence").alias("in_confidence"))
        far = series.agg(F.max("km")).first()[0] or 0.0
        slowest = max(vessel.steerage, vessel.economic * vessel.least_factor) * KNOT_KMH
        series = in_chunks(series.join(into, ["r", "c"]), len(times), CHUNK, frames_ahead(times, max(far / slowest, far / vessel.calm_kmh)))
        links = series.select("r", "c", "dr", "dc", "r2", "c2", "lat2", "lon2", "km", "heading", "low_risk", "best_factor", "best_confidence", "in_km", "in_factor", "in_risk", "in_confidence", "points", "chunk", F.expr(tile("r", "c")).alias("tile"))
        links.repartition("tile", "chunk").write.partitionBy("tile", "chunk").parquet(f"{base}/links")
        return spark.read.schema(links.select(*(c for c in links.columns if c not in ("tile", "chunk")), "tile", "chunk").schema).parquet(f"{base}/links")

    (same, wanted, starts, work), links = together(spark, asked, linked)
    names = {x: f"riskgrid_{x}_{uuid.uuid4().hex}" for x in ("work", "links", "rows")}
    quick = _quick(spark)
    quick.read.schema(links.schema).parquet(f"{base}/links").createOrReplaceTempView(names["links"])
    texts = _round_sql(names["work"], names["links"], times, vessel, min_confidence, max_risk, max_gap_us)
    out = Search(same, wanted, starts, work.limit(0), links=links, max_expansions=max_expansions)
    chunk = frame_sql(times)[0].replace("{t}", "v.arrive_us") + f" div {CHUNK}"
    watch = [F.count("*").alias("labels"), F.expr("count_if(NOT v.closed)").alias("open"), F.expr("count_if(v.at = k)").alias("settled"), F.expr(f"bit_or(IF(now, shiftleft(1L, {tile('row', 'col')}), 0L))").alias("tiles"), F.expr(f"min(IF(now, {chunk}, NULL))").alias("first"), F.expr(f"max(IF(now, {chunk}, NULL))").alias("last"), F.expr("count_if(now)").alias("now")]
    told, settled, path = work.agg(*watch).first().asDict(), 0, f"{base}/0"
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = f"riskgrid-search-{uuid.uuid4().hex}"
    over = threading.Event()

    def end() -> None:
        over.set()
        quick.interruptTag(tag)

    timer = threading.Timer(budget_s, end) if budget_s is not None else None
    try:
        quick.addTag(tag)
        if timer:
            timer.start()
        while told["open"]:
            if over.is_set() or cancelled():
                out.cancelled = True
                break
            quick.read.schema(frontier).parquet(path).createOrReplaceTempView(names["work"])
            # folders of what is final now, as the last round told; the hint stands only for counted rows
            own = ", ".join(str(k) for k in range(63) if told["tiles"] >> k & 1)
            where = f"e.tile IN ({own}) AND e.chunk BETWEEN {told['first']} AND {told['last']}"
            hint = "/*+ BROADCAST(b) */" if told["now"] <= BROADCAST_ROWS else ""
            seen = Observation()
            path, tasks = f"{base}/{out.rounds + 1}", min(most, -(-told["labels"] // FRONTIER_ROWS))
            try:
                made = quick.sql(texts[0].replace("{where}", where).replace("{hint}", hint))
                for text in texts[1:]:
                    made.createOrReplaceTempView(names["rows"])
                    made = quick.sql(text.replace(ROWS, names["rows"]).replace("{tasks}", str(tasks)))
                made.observe(seen, *watch).write.parquet(path)
            except Exception:
                if not over.is_set():
                    raise
                out.cancelled = True
                break
            out.rounds += 1
            work = spark.read.schema(frontier).parquet(path)
            told = seen.get
            settled += told["settled"]
            out.progress.append({"round": out.rounds, "labels": told["labels"], "open": told["open"], "settled": told["settled"]})
            if progress:
                progress(out.progress[-1])
            if out.rounds % LOOK == 0 and settled > max_expansions and told["open"]:
                many = _too_many(_settled(spark, base, out.rounds), work, max_expansions)
                path = f"{base}/less-{out.rounds}"
                work = written(work.join(many, "search", "left_anti"), path)
                told = work.agg(*watch).first().asDict()
    finally:
        if timer:
            timer.cancel()
        quick.removeTag(tag)
        for name in names.values():
            quick.catalog.dropTempView(name)
    out.open_labels = told["open"]
    # searches that still have open labels when the rounds are ended were not done
    left = work.where("not v.closed").select("search").distinct() if out.cancelled else work.select("search").limit(0)
    out.starts = starts.join(left.withColumn("left", F.lit(True)), "search", "left")
    if out.rounds:
        out.labels = written(_settled(spark, base, out.rounds), f"{base}/labels")
    return out


def _settled(spark: SparkSession, base: str, rounds: int) -> DataFrame:
    """All labels settled in the rounds, each where it was written."""
    schema = spark.createDataFrame([], FRONTIER).schema
    return spark.read.schema(schema).parquet(*(f"{base}/{k}" for k in range(1, rounds + 1))).where("v.closed and v.at = k")


def counters(found: Search) -> DataFrame:
    """The effort of each request's search, in labels and crossings that come before its goal in the order of cost plus bound (all of them if there is no route).

    search, status, rounds of its last label, expanded, nodes, states (settled,
    the goal's too), crossings, accepted, refused as hard, risk, speed,
    coverage and error, and the largest time bucket.
    """
    per, goals = _needed(found)
    out = goals.select("search", "status").join(per, "search", "left").select("search", "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS))
    return _each(found, out)


def _each(found: Search, rows: DataFrame) -> DataFrame:
    """Rows of what was searched, for each request that it answers."""
    return rows.withColumnRenamed("search", "of").join(found.same, "of").select(*rows.columns)


COUNTERS = ("last_round", "expanded", "nodes", "states", "crossings", "accepted", *(f"refused_{x}" for x in REFUSED), "max_bucket")


def _needed(found: Search) -> tuple[DataFrame, DataFrame]:
    """Counts by search of what comes before the goal, and the goal's label of each search with its status."""
    wanted, labels = found.wanted, found.labels
    best = labels.where("v.goal").groupBy("search").agg(F.min_by(F.struct(*STATE, "v"), F.struct("v.cost", "v.arrive_us", *STATE)).alias("goal"))
    met = labels.join(best.select("search", F.col("goal.v.cost").alias("goal_cost")), "search", "left")
    met = met.where("v.goal or goal_cost is null or v.cost + v.bound < goal_cost")
    if found.links is not None:
        degree = found.links.where("chunk = 0").groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.count("*").alias("degree"))
        met = met.join(degree, ["row", "col"], "left")
    else:
        met = met.withColumn("degree", F.lit(0).cast("long"))
    mine = ~F.col("v.goal")
    refused = {f"refused_{x}": F.sum(F.when(mine, F.col(f"n_{x}")).otherwise(0)) for x in REFUSED}
    per = met.groupBy("search").agg(
        F.max("v.at").alias("last_round"),
        F.count_if(mine).alias("expanded"),
        F.count_distinct("row", "col").alias("nodes"),
        F.count("*").alias("states"),
        F.coalesce(F.sum(F.when(mine, F.col("degree"))), F.lit(0)).alias("crossings"),
        *(v.alias(k) for k, v in refused.items()),
        F.max("bucket").alias("max_bucket"),
    )
    per = per.withColumn("accepted", F.col("crossings") - sum((F.col(k) for k in refused), F.lit(0)))
    left = F.col("left") if "left" in found.starts.columns else F.lit(False)
    rows = wanted.select("search", "r0", "c0", "depart_us").join(found.starts.select("search", "start_status", left.alias("left")), "search", "left").join(best, "search", "left").join(per, "search", "left")
    status = (
        F.when(F.col("start_status") != "ok", F.col("start_status"))
        .when(F.coalesce("refused_error", F.lit(0)) > 0, "error")
        .when(F.coalesce("expanded", F.lit(0)) + F.when(F.col("goal").isNotNull(), 1).otherwise(0) > found.max_expansions, "limit")
        .when(F.col("left") & (F.col("goal").isNull() | found.cancelled), "cancelled")
        .when(F.col("goal").isNotNull(), "ok")
        .when(F.coalesce("refused_coverage", F.lit(0)) > 0, "no coverage")
        .otherwise("no route")
    )
    return per, rows.select("search", "r0", "c0", "depart_us", status.alias("status"), "goal")


def steps(found: Search) -> DataFrame:
    """Steps of all requests in the form of ``RESULT``: found routes walked back from their goals, one row with the status for the others."""
    spark = found.wanted.sparkSession
    base = folder(spark, "steps")
    _, goals = _needed(found)
    goals = written(goals, f"{base}/goals")
    good = goals.where("status = 'ok'").select("search", F.col("goal.v.cost").alias("goal_cost"), F.struct(*(F.col(f"goal.{c}").alias(c) for c in STATE)).alias("at"))
    labels = found.labels.join(good.select("search", "goal_cost"), "search").where("v.goal or v.cost + v.bound <= goal_cost").select("search", F.struct(*STATE).alias("at"), "v.parent", "v.cost", "v.arrive_us", "v.crossed")
    labels = written(labels, f"{base}/labels")
    # jumps of 1, 2, 4, ... labels towards the start, until none is left
    jump = labels.where("parent is not null").select("search", "at", F.col("parent").alias("to"))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        far = jump.select("search", F.col("at").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(far, ["search", "to"]).select("search", "at", F.col("further").alias("to")), f"{base}/jump-{len(jumps)}")
    on = good.select("search", "at", F.lit(0).alias("back"))
    for k in reversed(range(len(jumps))):
        # every label of a route is one sum of jumps away from its goal
        both = F.array_compact(F.array(F.struct("at", "back"), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("at"), (F.col("back") + (1 << k)).alias("back")))))
        on = on.join(jumps[k], ["search", "at"], "left").select("search", F.explode(both).alias("x")).select("search", "x.*")
    on = written(on, f"{base}/on")
    last = on.groupBy("search").agg(F.max("back").alias("n"))
    names = [x.split()[0] for x in RESULT.split(", ")]
    made = on.join(last, "search").join(labels, ["search", "at"]).select("search", (F.col("n") - F.col("back")).alias("step"), "at.row", "at.col", F.col("arrive_us").alias("eta_us"), "crossed.*", "cost", F.lit("ok").alias("status")).select(*names)
    kinds = dict(made.dtypes)
    failed = goals.where("status <> 'ok'").select("search", F.lit(0).alias("step"), F.col("r0").alias("row"), F.col("c0").alias("col"), F.col("depart_us").alias("eta_us"), *(F.lit(None).cast(kinds[c]).alias(c) for c in names[5:-1]), "status")
    return _each(found, written(made.unionByName(failed), f"{base}/steps"))


def routes(cube: DataFrame, requests: DataFrame, **options: Any) -> DataFrame:
    """Route steps of all requests (``RESULT``); options as in ``run``."""
    return steps(run(cube, requests, **options))
