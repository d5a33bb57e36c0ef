"""Sampling a cube at points in space and time.

A point meets at most two frames (one if its time is a frame's time) and at
most four cells (fewer on a grid line). Risk is weighed linearly; hard is true
if any contributor is hard; confidence and factor are the least of the
contributors. A point outside the window or grid, or between frames that are
too far apart, has a status and no values; unknown risk is never safe.

The cube is laid out for this (``blocks``): one row for each cell and its
neighbours above and to the right, with their values over all frames as
arrays. A point meets one row of it, and the rest is look-ups and arithmetic in
that row: no exchange of the cube's cells, no aggregation of points. Blocks
that a count finds few are broadcast; others lie in a bucketed table
(``laid_out``), so only points are shuffled, to the buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.motion import risk_level
from riskgrid.operators.shared import folder

TOLERANCE = 1e-10
#: Bytes of blocks that may be broadcast; a value of a cell in a frame takes about 25.
BROADCAST_BYTES, VALUE_BYTES = 32 << 20, 25


def axis_literal(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def axis_of(cube: DataFrame, index: str, value: str) -> list:
    """An axis of the grid in order: as many values as the grid has lines."""
    return axes_of(cube, ((index, value),))[0]


def axes_of(cube: DataFrame, axes: tuple[tuple[str, str], ...] = (("frame", "valid_us"), ("row", "lat"), ("col", "lon"))) -> list[list]:
    """Several axes (index, value) from one pass over the cube, in order."""
    kinds = dict(cube.dtypes)
    one = F.array(*(F.struct(F.lit(k).alias("axis"), F.col(i).cast("long").alias("i"), F.when(F.lit(kinds[v] == "bigint"), F.col(v)).cast("long").alias("whole"), F.col(v).cast("double").alias("v")) for k, (i, v) in enumerate(axes)))
    rows = cube.select(F.explode(one).alias("x")).groupBy("x.axis", "x.i").agg(F.min("x.whole").alias("whole"), F.min("x.v").alias("v")).collect()
    out: list[list] = [[] for _ in axes]
    for r in sorted(rows, key=lambda r: (r.axis, r.i)):
        out[r.axis].append(r.v if r.whole is None else r.whole)
    return out


def step_of(axis: list) -> float | None:
    """The step of an axis whose lines lie evenly, or None."""
    if len(axis) < 2:
        return None
    step = (axis[-1] - axis[0]) / (len(axis) - 1)
    return step if all(abs(axis[0] + step * k - v) < 0.25 * abs(step) for k, v in enumerate(axis)) else None


def line_below(x: Column, axis: list) -> Column:
    """Position of the last line at or below x on an ascending axis (-1: none), by arithmetic if the lines lie nearly evenly."""
    values, step = axis_literal(axis), step_of(axis)
    if not step:
        return F.size(F.filter(values, lambda v: v <= x)) - 1
    # a guess that is off by one at most, set right by the lines themselves
    guess = F.least(F.greatest(F.floor((x - F.lit(axis[0])) / step), F.lit(0)), F.lit(len(axis) - 1)).cast("int")
    above, own = F.get(values, guess + 1), F.get(values, guess)
    return F.when(above <= x, guess + 1).when(own <= x, guess).otherwise(guess - 1)


def bracket(x: Column, axis: list, tolerance: float = 0.0) -> Column:
    """(low, high, fraction) positions of x on an ascending axis; low = high on a line; NULL outside."""
    values = axis_literal(axis)
    low = line_below(x + tolerance if tolerance else x, axis)
    at, nxt = F.get(values, low), F.get(values, F.least(low + 1, F.lit(len(axis) - 1)))
    inside = (x >= axis[0] - tolerance) & (x <= axis[-1] + tolerance)
    return F.when(
        inside,
        F.when(F.abs(x - at) <= tolerance, F.struct(low.alias("low"), low.alias("high"), F.lit(0.0).alias("fraction")))
        .otherwise(F.struct(low.alias("low"), (low + 1).alias("high"), ((x - at) / (nxt - at)).alias("fraction"))),
    )


_SERIES = "struct<risk:array<double>,hard:array<boolean>,confidence:array<double>,factor:array<double>>"


def cell_series(cube: DataFrame, n_frames: int) -> DataFrame:
    """(row, col, series): every cell with arrays over all frames; hard is NULL where a frame lacks the cell."""
    value = F.struct("frame", F.col("risk").cast("double").alias("risk"), F.coalesce("hard", F.lit(False)).alias("hard"), F.col("confidence").cast("double").alias("confidence"), F.coalesce("factor", F.lit(1.0)).cast("double").alias("factor"))
    rows = cube.groupBy("row", "col").agg(F.sort_array(F.collect_list(value)).alias("v"))
    at = F.expr(f"IF(size(v) = {n_frames}, v, transform(sequence(0, {n_frames - 1}), k -> get(filter(v, s -> s.frame = k), 0)))")
    return rows.withColumn("v", at).select("row", "col", F.struct("v.risk", "v.hard", "v.confidence", "v.factor").cast(_SERIES).alias("series"))


def blocks(cube: DataFrame, n_frames: int) -> DataFrame:
    """(row, col, s00, s01, s10, s11): the series of every cell and of its neighbours at +col, +row and both; NULL beyond the grid or where there is no cell."""
    cells = cell_series(cube, n_frames)
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    parts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in corners))
    dealt = cells.withColumn("p", F.explode(parts)).select((F.col("row") - F.col("p.a")).alias("row"), (F.col("col") - F.col("p.b")).alias("col"), "p", "series")
    return dealt.groupBy("row", "col").agg(*(F.first(F.when((F.col("p.a") == a) & (F.col("p.b") == b), F.col("series")), ignorenulls=True).alias(f"s{a}{b}") for a, b in corners))


def laid_out(rows: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Rows written as a bucketed table in the shared folder: joins on the keys don't move them again."""
    spark = rows.sparkSession
    name = f"riskgrid_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", folder(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


def _ends(axis: str) -> str:
    """(position, weight) of the one or two lines of a bracket, as SQL."""
    return f"IF({axis}.low = {axis}.high, array(named_struct('at', {axis}.low, 'w', 1D)), array(named_struct('at', {axis}.low, 'w', 1D - {axis}.fraction), named_struct('at', {axis}.high, 'w', {axis}.fraction)))"


#: Contributors of a point: weight and series.
_NEAR = f"""filter(flatten(transform({_ends('y')}, a -> transform({_ends('x')}, b -> named_struct('w', a.w * b.w,
    's', IF(a.at = y.low, IF(b.at = x.low, s00, s01), IF(b.at = x.low, s10, s11)))))), c -> c.s IS NOT NULL)"""
#: What they make of each frame of a point: a cell that a frame lacks gives nothing.
_SEEN = f"""transform({_ends('t')}, f -> named_struct('w', f.w,
    'any', exists(near, c -> get(c.s.hard, f.at) IS NOT NULL),
    'risk', aggregate(near, 0D, (total, c) -> total + coalesce(c.w * get(c.s.risk, f.at), 0D)),
    'unknown', exists(near, c -> get(c.s.hard, f.at) IS NOT NULL AND get(c.s.risk, f.at) IS NULL),
    'hard', exists(near, c -> coalesce(get(c.s.hard, f.at), false)),
    'confidence', array_min(transform(near, c -> get(c.s.confidence, f.at))),
    'factor', array_min(transform(near, c -> get(c.s.factor, f.at)))))"""


def sample(points: DataFrame, cube: DataFrame, max_gap_us: int | None = None, digits: int = 9) -> DataFrame:
    """Values at points (point_id, lat, lon, t_us): status, risk, hard, confidence, factor, level.

    Axes are as small as the grid's lines, come from one pass over the cube and
    go into the plan; a point's brackets are found once and it meets its block
    in one equi-join. An empty cube covers nothing; a point whose cells are all
    missing is ok and has no values; null coordinates lie out of bounds, a
    null time has no coverage; repeated points give repeated rows.
    """
    times, lats, lons = axes_of(cube)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("risk", "double"), ("hard", "boolean"), ("confidence", "double"), ("factor", "double"), ("level", "int"))]
    if not times:
        return points.select("point_id", F.lit("no coverage").alias("status"), *none)
    gap = max_gap_us if max_gap_us is not None else times[-1] - times[0] + 1
    grid = blocks(cube, len(times))
    few = len(lats) * len(lons) * len(times) * 4 * VALUE_BYTES <= BROADCAST_BYTES
    grid = F.broadcast(grid) if few else laid_out(grid)
    # a generator keeps the brackets from being computed again wherever they are used
    found = F.struct(bracket(F.col("t_us"), times).alias("t"), bracket(F.col("lat"), lats, TOLERANCE).alias("y"), bracket(F.col("lon"), lons, TOLERANCE).alias("x"))
    placed = points.select("point_id", F.explode(F.array(found)).alias("b")).select("point_id", "b.*")
    taxis = axis_literal(times)
    too_far = F.get(taxis, F.col("t.high")) - F.get(taxis, F.col("t.low")) > gap
    status = F.when(F.col("y").isNull() | F.col("x").isNull(), "out of bounds").when(F.col("t").isNull() | too_far, "no coverage").otherwise("ok")
    # those that meet no block are dealt over rows that no grid has
    row = F.coalesce("y.low", (-2 - F.pmod(F.xxhash64("point_id"), F.lit(1 << 20))).cast("int"))
    placed = placed.withColumns({"status": status, "row": row, "col": F.coalesce("x.low", F.lit(-2))})
    met = placed.join(grid, ["row", "col"], "left").withColumn("near", F.expr(f"explode(array({_NEAR}))"))
    met = met.select("point_id", "status", "t", "near").withColumn("seen", F.expr(f"explode(array(IF(status = 'ok', {_SEEN}, NULL)))"))
    bad = F.expr("exists(seen, f -> f.unknown AND NOT f.hard)")
    risk = F.round(F.expr("aggregate(seen, 0D, (total, f) -> total + f.w * IF(f.unknown, 1D, f.risk))"), digits)
    there = F.expr("exists(seen, f -> f.any)")
    out = met.select(
        "point_id",
        F.when(bad, "unknown risk").otherwise(F.col("status")).alias("status"),
        F.when(there & ~bad, risk).alias("risk"),
        F.when(there, F.expr("exists(seen, f -> f.hard)")).alias("hard"),
        F.array_min(F.col("seen.confidence")).alias("confidence"),
        F.array_min(F.col("seen.factor")).alias("factor"),
    )
    return out.withColumn("level", risk_level(F.col("risk")))
