"""Queries on cubes: building, sampling, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions.motion import risk_level
from riskgrid.operators import codec, hash_tree, validate
from riskgrid.operators.sample import sample
from riskgrid.plans.registry import CUBE, T0, query
from riskgrid.sources.cube import fixture_cubes, table, table_cube


@query(f"""WITH {CUBE} SELECT frame, "row", col, valid_us, round(lat, 6) AS lat, round(lon, 6) AS lon, risk, hard, round(confidence, 6) AS confidence, round(factor, 6) AS factor FROM cube""")
def cube_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_cube(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("lat", "lon", "confidence", "factor")})


@query(f"""WITH a AS (SELECT s_suppkey AS scenario, (2 + s_suppkey % 5)::INT AS frames, (3 + s_suppkey % 6)::INT AS ny, (3 + s_suppkey % 7)::INT AS nx, 10.0::DOUBLE + s_nationkey AS west, 60.0::DOUBLE + s_suppkey % 10 AS south, {T0} + (s_suppkey % 24) * 3600000000 AS start_us, (1 + s_suppkey % 3) * 3600000000 AS step_us FROM supplier),
k AS (SELECT *, unnest(range(frames * ny * nx)) AS i FROM a),
c AS (SELECT *, (i // (ny * nx))::INT AS frame, (i // nx % ny)::INT AS "row", (i % nx)::INT AS col FROM k), x AS (SELECT *, col / (nx - 1)::DOUBLE AS x, "row" / (ny - 1)::DOUBLE AS y FROM c)
SELECT scenario, frame, "row", col, start_us + frame * step_us AS valid_us, round(south + 2.0::DOUBLE * y, 6) AS lat, round(west + 3.0::DOUBLE * x, 6) AS lon,
round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.28::DOUBLE + 0.20::DOUBLE * x + 0.12::DOUBLE * y + 0.14::DOUBLE * sin(pi() * (2.7::DOUBLE * x + 1.3::DOUBLE * y + 0.11::DOUBLE * frame)))), 6) AS risk,
("row" = ny // 2 AND col >= nx // 3 AND col < 2 * nx // 3 AND col <> nx // 2) AS hard,
round(greatest(0.55::DOUBLE, 0.92::DOUBLE - 0.01::DOUBLE * frame), 6) AS confidence,
round(least(0.96::DOUBLE, greatest(0.72::DOUBLE, 0.86::DOUBLE + 0.10::DOUBLE * cos(pi() * (1.1::DOUBLE * x - 0.7::DOUBLE * y + 0.07::DOUBLE * frame)))), 6) AS factor FROM x""")
def cube_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth cube for every supplier: its own size, place, begin and interval."""
    k, hour = F.col("s_suppkey"), F.lit(3_600_000_000)
    south, west = 60.0 + k % 10, 10.0 + F.col("s_nationkey")
    own = {"frames": 2 + k % 5, "ny": 3 + k % 6, "nx": 3 + k % 7, "west": west, "south": south, "east": west + 3.0, "north": south + 2.0, "start_us": F.lit(T0) + k % 24 * hour, "interval_us": (1 + k % 3) * hour}
    asked = table(spark, sf_dir, "supplier").select(k.alias("scenario"), *(v.alias(c) for c, v in own.items()))
    return fixture_cubes(asked, ["scenario"]).withColumns({c: F.round(c, 6) for c in ("lat", "lon", "risk", "confidence", "factor")})


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for every event, on quarters of cells and eighths of hours; some lie outside."""
    e = table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    return e.select(
        k.alias("point_id"),
        (70.0 + 0.05 * (F.pmod(k * 7, F.lit(46)) / 4)).alias("lat"),
        (18.0 + 0.10 * (F.pmod(k * 11, F.lit(38)) / 4)).alias("lon"),
        (F.lit(T0) + F.pmod(k * 13, F.lit(50)) * F.lit(450_000_000)).alias("t_us"),
    )


@query(f"""WITH {CUBE},
p AS (SELECT event_id AS id, (event_id * 7 % 46)::INT AS yq, (event_id * 11 % 38)::INT AS xq, (event_id * 13 % 50)::INT AS tq FROM events),
st AS (SELECT *, CASE WHEN yq > 44 OR xq > 36 THEN 'out of bounds' WHEN tq > 48 THEN 'no coverage' ELSE 'ok' END AS status FROM p),
ty AS (SELECT id, tq, xq, yq, u.a AS ta, u.w AS tw FROM st, LATERAL (VALUES (tq // 8, 8 - tq % 8), (tq // 8 + 1, tq % 8)) AS u(a, w) WHERE status = 'ok' AND u.w > 0),
yy AS (SELECT ty.*, u.a AS ya, u.w AS yw FROM ty, LATERAL (VALUES (yq // 4, 4 - yq % 4), (yq // 4 + 1, yq % 4)) AS u(a, w) WHERE u.w > 0),
xx AS (SELECT yy.*, u.a AS xa, u.w AS xw FROM yy, LATERAL (VALUES (xq // 4, 4 - xq % 4), (xq // 4 + 1, xq % 4)) AS u(a, w) WHERE u.w > 0),
v AS (SELECT id, round(sum(tw * yw * xw * round(risk * 100)::BIGINT)::DOUBLE / 12800, 9) AS risk, bool_or(hard) AS hard, min(confidence) AS confidence, min(factor) AS factor
    FROM xx JOIN cube ON frame = ta AND "row" = ya AND col = xa GROUP BY id)
SELECT st.id AS point_id, status, risk, hard, round(confidence, 6) AS confidence, round(factor, 6) AS factor, CASE WHEN risk IS NOT NULL THEN least(5, greatest(1, floor(risk * 5) + 1))::INT END AS level FROM st LEFT JOIN v USING (id)""")
def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample(event_points(spark, sf_dir), table_cube(spark, sf_dir))
    # a NULL risk has no level in SQL; the operator gives none either
    return out.withColumns({"confidence": F.round("confidence", 6), "factor": F.round("factor", 6), "level": F.when(F.col("risk").isNotNull(), F.col("level"))})


@query(f"""WITH {CUBE}, x AS (SELECT frame, "row", col, CASE WHEN ("row" + col) % 5 = 0 THEN round(risk + 0.3::DOUBLE, 6) WHEN ("row" + col) % 7 = 0 THEN NULL ELSE risk END AS risk, hard, CASE WHEN "row" = 3 THEN NULL ELSE confidence END AS confidence, CASE WHEN col = 4 THEN 0.0::DOUBLE ELSE factor END AS factor FROM cube)
SELECT frame, "row", col, 'risk outside [0, 1]' AS rule FROM x WHERE risk > 1 OR risk < 0
UNION ALL SELECT frame, "row", col, 'unknown risk at a navigable cell' FROM x WHERE risk IS NULL AND NOT (hard OR coalesce(confidence, 0.0) = 0)
UNION ALL SELECT frame, "row", col, 'confidence outside [0, 1]' FROM x WHERE confidence IS NULL OR confidence > 1
UNION ALL SELECT frame, "row", col, 'factor outside (0, 1]' FROM x WHERE factor <= 0 OR factor > 1""")
def payload_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row") + F.col("col")
    x = table_cube(spark, sf_dir).withColumns(
        {
            "risk": F.when(k % 5 == 0, F.round(F.col("risk") + 0.3, 6)).when(k % 7 == 0, F.lit(None)).otherwise(F.col("risk")),
            "confidence": F.when(F.col("row") != 3, F.col("confidence")),
            "factor": F.when(F.col("col") == 4, 0.0).otherwise(F.col("factor")),
        }
    )
    return validate.violations(x, validate.payload_rules(), ["frame", "row", "col"])


@query("""SELECT least(5, greatest(1, floor((l_partkey % 101) / 100.0::DOUBLE * 5) + 1))::INT AS level, count(*) AS n, min((l_partkey % 101) / 100.0::DOUBLE) AS least, max((l_partkey % 101) / 100.0::DOUBLE) AS most FROM lineitem GROUP BY 1""")
def risk_level_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.pmod("l_partkey", F.lit(101)) / 100.0).alias("risk"))
    return li.groupBy(risk_level(F.col("risk")).alias("level")).agg(F.count("*").alias("n"), F.min("risk").alias("least"), F.max("risk").alias("most"))


@query(f"""WITH {CUBE}, x AS (SELECT frame, "row", hard, CASE WHEN round(risk * 100)::INT % 9 = 0 THEN NULL ELSE risk END AS risk FROM cube)
SELECT frame, "row", count(*) AS n, count(*) FILTER (risk IS NULL) AS unknown, CASE WHEN count(*) FILTER (risk IS NULL) = 0 THEN max(risk) WHEN bool_or(hard) THEN 1.0::DOUBLE END AS risk,
CASE WHEN count(*) FILTER (risk IS NULL) > 0 AND NOT bool_or(hard) THEN 'unknown risk' ELSE 'ok' END AS status FROM x GROUP BY 1, 2""")
def unknown_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown risk along a row of cells: 1 beside a hard cell, else an error."""
    x = table_cube(spark, sf_dir).withColumn("risk", F.when(F.round(F.col("risk") * 100).cast("int") % 9 != 0, F.col("risk")))
    missing = F.count_if(F.col("risk").isNull())
    return x.groupBy("frame", "row").agg(
        F.count("*").alias("n"),
        missing.alias("unknown"),
        F.when(missing == 0, F.max("risk")).when(F.bool_or("hard"), 1.0).alias("risk"),
        F.when((missing > 0) & ~F.bool_or("hard"), "unknown risk").otherwise("ok").alias("status"),
    )


_FIX = "coalesce(round({x} * 1e9)::BIGINT::VARCHAR, 'null')"
_TREE = f"""leaf AS (SELECT frame, valid_us, "row", col, sha256(concat_ws('|', {', '.join(_FIX.format(x=c) for c in ('lat', 'lon', 'risk'))}, hard::VARCHAR, {', '.join(_FIX.format(x=c) for c in ('confidence', 'factor'))})) AS d FROM cube),
line AS (SELECT frame, valid_us, "row", sha256(string_agg(d, '' ORDER BY col)) AS d FROM leaf GROUP BY 1, 2, 3),
fr AS (SELECT frame, valid_us, sha256(string_agg(d, '' ORDER BY "row")) AS digest FROM line GROUP BY 1, 2)"""


@query(f"WITH {CUBE}, {_TREE} SELECT * FROM fr UNION ALL SELECT -1, count(*), sha256(string_agg(valid_us || ':' || digest, ',' ORDER BY valid_us)) FROM fr")
def window_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the cube's frames, and (frame -1, with their number) of the window."""
    frames = hash_tree.frame_digests(table_cube(spark, sf_dir))
    root = hash_tree.window_digest(frames).select(F.lit(-1).alias("frame"), F.col("frames").alias("valid_us"), "digest")
    return frames.unionByName(root)


@query(f"""WITH {CUBE}, b AS (SELECT frame, valid_us FROM cube GROUP BY 1, 2) SELECT valid_us, CASE WHEN frame = 1 THEN 'new' WHEN frame = 2 THEN 'gone' ELSE 'other' END AS change FROM b
WHERE frame IN (1, 2) OR frame IN (SELECT frame FROM cube WHERE frame >= 3 AND "row" = 5 AND col % 4 = frame % 4 AND hard)""")
def changed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that differ after one is dropped, one is added and some hard cells of a row are opened."""
    cube = table_cube(spark, sf_dir)
    opened = (F.col("frame") >= 3) & (F.col("row") == 5) & (F.col("col") % 4 == F.col("frame") % 4)
    after = cube.where("frame <> 2").withColumn("hard", F.col("hard") & ~opened)
    return hash_tree.changed_frames(hash_tree.frame_digests(cube.where("frame <> 1")), hash_tree.frame_digests(after))


@query()
def frame_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical documents of the cube's frames with their content digests."""
    cube = table_cube(spark, sf_dir)
    head = cube.groupBy("frame").agg(F.min("valid_us").alias("us")).select(
        "frame",
        F.lit("2.0").alias("schema_version"),
        F.lit("run-00000000-0000-4000-8000-000000000000").alias("run_id"),
        F.lit("scenario-1").alias("scenario_id"),
        F.lit("corridor-1").alias("corridor_id"),
        F.lit("vessel-1").alias("vessel_profile_id"),
        F.lit("c" * 64).alias("config_digest"),
        F.lit("d" * 64).alias("model_config_digest"),
        F.lit(0).alias("generation_id"),
        F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_time"),
        F.lit("2026-01-01T00:00:00Z").alias("as_of_time"),
        F.lit("2026-01-01T00:00:00Z").alias("generated_at"),
        F.lit("model-1").alias("model_version"),
        F.array().cast("array<string>").alias("source_summary"),
        F.lit("development").alias("provenance"),
    )
    return codec.frame_documents(cube, head)


@query(f"""WITH {CUBE} SELECT frame, "row", col, risk, hard, round(confidence, 6) AS confidence, round(factor, 6) AS factor, least(5, greatest(1, floor(risk * 5) + 1))::INT AS level FROM cube""")
def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells read back from the canonical documents."""
    d = frame_documents(spark, sf_dir)
    cells = codec.cells_of(d)
    hour = ((F.unix_micros(F.to_timestamp("valid_time")) - F.lit(T0)) / F.lit(3_600_000_000)).cast("int")
    return cells.select(hour.alias("frame"), "row", "col", "risk", "hard", F.round("confidence", 6).alias("confidence"), F.round("factor", 6).alias("factor"), "level")
