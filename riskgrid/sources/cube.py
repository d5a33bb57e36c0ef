"""Risk cubes in long form, from tables and from formulas.

A cube has one row for each (frame, row, col): the frame's time in epoch
microseconds, the cell's coordinates, and risk, hard, confidence and factor.
Risk is NULL where it is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
T0 = 1_767_225_600_000_000  # 2026-01-01T00:00Z
LAT0, LAT_STEP, LON0, LON_STEP = 70.0, 0.05, 18.0, 0.10
ROWS, COLS, FRAMES = 12, 10, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 12 x 10 grid over 7 hourly frames, counted from all rows of ``lineitem``.

    One pass with partial sums for the 840 keys; whole numbers only until the
    last step, so every engine gets the same cube.
    """
    li = table(spark, sf_dir, "lineitem")
    sums = (
        li.select(
            (F.col("l_linenumber") - 1).cast("int").alias("frame"),
            F.pmod("l_partkey", F.lit(ROWS)).cast("int").alias("row"),
            F.pmod("l_suppkey", F.lit(COLS)).cast("int").alias("col"),
            F.round(F.col("l_discount") * 100).cast("long").alias("d"),
            F.col("l_quantity").cast("long").alias("q"),
        )
        .groupBy("frame", "row", "col")
        .agg(F.count("*").alias("n"), F.sum("d").alias("d"), F.sum("q").alias("q"))
    )
    return sums.select(
        "frame",
        "row",
        "col",
        (F.lit(T0) + F.col("frame") * F.lit(HOUR)).alias("valid_us"),
        (F.lit(LAT0) + LAT_STEP * F.col("row")).alias("lat"),
        (F.lit(LON0) + LON_STEP * F.col("col")).alias("lon"),
        ((F.col("d") % 101) / 100.0).alias("risk"),
        (F.col("q") % 7 == 0).alias("hard"),
        (0.5 + (F.col("q") % 50) / 100.0).alias("confidence"),
        (0.4 + (F.col("d") % 60) / 100.0).alias("factor"),
    )


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def _fixture(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of smooth cubes with a wall across the middle row; ``id`` counts the cells of a cube, frame by frame and row by row."""
    i, ny, nx = F.col("id"), F.col("ny"), F.col("nx")
    base = rows.withColumns({"frame": F.floor(i / (ny * nx)).cast("int"), "row": (F.floor(i / nx) % ny).cast("int"), "col": (i % nx).cast("int")})
    x, y, k = F.col("col") / (nx - 1), F.col("row") / (ny - 1), F.col("frame")
    pi = F.pi()
    wall = (F.col("row") == F.floor(ny / 2)) & (F.col("col") >= F.floor(nx / 3)) & (F.col("col") < F.floor(2 * nx / 3)) & (F.col("col") != F.floor(nx / 2))
    return base.select(
        *keys,
        "frame",
        "row",
        "col",
        (F.col("start_us") + k * F.col("interval_us")).alias("valid_us"),
        (F.col("south") + (F.col("north") - F.col("south")) * y).alias("lat"),
        (F.col("west") + (F.col("east") - F.col("west")) * x).alias("lon"),
        _clip(0.28 + 0.20 * x + 0.12 * y + 0.14 * F.sin(pi * (2.7 * x + 1.3 * y + 0.11 * k)), 0.0, 1.0).alias("risk"),
        wall.alias("hard"),
        F.greatest(F.lit(0.55), 0.92 - 0.01 * k).alias("confidence"),
        _clip(0.86 + 0.10 * F.cos(pi * (1.1 * x - 0.7 * y + 0.07 * k)), 0.72, 0.96).alias("factor"),
    )


#: What a fixture is asked by.
FIXTURE = ("frames", "ny", "nx", "west", "south", "east", "north", "start_us", "interval_us")


def fixture_cubes(asked: DataFrame, keys: list[str]) -> DataFrame:
    """A smooth cube for every row of ``asked`` (keys and FIXTURE), all in one pass without a join or shuffle.

    Rows that ask for less than two frames, three rows or three columns, or
    for no positive interval, give no cells.
    """
    good = asked.where("frames >= 2 and ny >= 3 and nx >= 3 and interval_us > 0")
    return _fixture(good.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") * F.col("ny") * F.col("nx") - 1))), keys)


def analytic_cube(spark: SparkSession, frames: int = 25, shape: tuple[int, int] = (21, 31), box: tuple[float, float, float, float] = (18.0, 70.0, 21.0, 72.0), start_us: int = T0, interval_us: int = HOUR) -> DataFrame:
    """One smooth cube from formulas alone, built from a distributed range."""
    ny, nx = shape
    if frames < 2 or ny < 3 or nx < 3 or interval_us <= 0:
        raise ValueError("a cube has two frames, three rows and three columns at least")
    asked = dict(zip(FIXTURE, (frames, ny, nx, *box, start_us, interval_us), strict=True))
    return _fixture(spark.range(frames * ny * nx).withColumns({k: F.lit(v) for k, v in asked.items()}), [])


#: Identity of a frame's run: all of it must agree over a window (fixed set).
IDENTITY = ("run_id", "scenario_id", "corridor_id", "vessel_id", "config_digest", "model_digest", "generation")


def table_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame headers with several revisions of each time, from all rows of ``orders``.

    valid_us is the order's day, as_of_us and generated_us are when it was
    known; the run is the customer modulo 20.
    """
    o = table(spark, sf_dir, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    run = F.pmod("o_custkey", F.lit(20))
    return o.select(
        F.concat(F.lit("frame-"), F.col("o_orderkey").cast("string")).alias("risk_id"),
        F.concat(F.lit("run-"), run.cast("string")).alias("run_id"),
        F.concat(F.lit("scenario-"), (run % 4).cast("string")).alias("scenario_id"),
        F.concat(F.lit("corridor-"), F.pmod("o_orderkey", F.lit(3)).cast("string")).alias("corridor_id"),
        F.lit("vessel-1").alias("vessel_id"),
        F.lit("c" * 64).alias("config_digest"),
        F.lit("d" * 64).alias("model_digest"),
        F.pmod("o_orderkey", F.lit(2)).cast("int").alias("generation"),
        (F.floor(day / 7) * 7 * 24).alias("valid_h"),
        (day * 24).alias("as_of_h"),
        F.pmod("o_orderkey", F.lit(24)).cast("long").alias("generated_h"),
    )
