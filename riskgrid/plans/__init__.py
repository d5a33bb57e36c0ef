"""Registered queries and their DuckDB counterparts."""

from riskgrid.plans import admission, cubes, grids, routes, sets, windows  # noqa: F401
from riskgrid.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
