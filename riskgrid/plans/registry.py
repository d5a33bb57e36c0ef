"""Where queries and their SQL meet."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that DuckDB must agree with."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


T0 = 1767225600000000
#: The cube of sources.cube.table_cube, in SQL.
CUBE = f"""s AS (SELECT (l_linenumber - 1)::INT AS frame, (l_partkey % 12)::INT AS r, (l_suppkey % 10)::INT AS c,
    sum(round(l_discount * 100)::BIGINT)::BIGINT AS d, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1, 2, 3),
cube AS (SELECT frame, r AS "row", c AS col, {T0} + frame::BIGINT * 3600000000 AS valid_us,
    70.0::DOUBLE + 0.05::DOUBLE * r AS lat, 18.0::DOUBLE + 0.1::DOUBLE * c AS lon,
    (d % 101) / 100.0::DOUBLE AS risk, q % 7 = 0 AS hard,
    0.5::DOUBLE + (q % 50) / 100.0::DOUBLE AS confidence, 0.4::DOUBLE + (d % 60) / 100.0::DOUBLE AS factor FROM s)"""

FRAMES = """f AS (SELECT 'frame-' || o_orderkey AS risk_id, 'run-' || (o_custkey % 20) AS run_id,
    'scenario-' || (o_custkey % 20 % 4) AS scenario_id, 'corridor-' || (o_orderkey % 3) AS corridor_id,
    (o_orderkey % 2)::INT AS generation, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS day,
    (o_orderkey % 24)::BIGINT AS generated_h FROM orders),
frames AS (SELECT risk_id, run_id, scenario_id, corridor_id, generation, (day // 7) * 7 * 24 AS valid, day * 24 AS as_of, day * 24 + generated_h AS generated FROM f)"""

HAVERSINE = "2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({y}) - radians({x})) / 2), 2))))"
BEARING = "(degrees(atan2(sin(radians({y}) - radians({x})) * cos(radians({b})), cos(radians({a})) * sin(radians({b})) - sin(radians({a})) * cos(radians({b})) * cos(radians({y}) - radians({x})))) + 360.0::DOUBLE) % 360.0::DOUBLE"
EDGES = f"""n AS (SELECT "row", col, min(lat) AS lat, min(lon) AS lon FROM cube GROUP BY 1, 2),
moves AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) AS m(dr, dc)),
e AS (SELECT a."row" AS r, a.col AS c, dr, dc, b."row" AS r2, b.col AS c2,
    {HAVERSINE.format(a="a.lat", x="a.lon", b="b.lat", y="b.lon")} AS km, {BEARING.format(a="a.lat", x="a.lon", b="b.lat", y="b.lon")} AS heading
    FROM n a, moves, n b WHERE b."row" = a."row" + dr AND b.col = a.col + dc)"""
