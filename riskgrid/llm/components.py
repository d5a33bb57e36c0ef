"""Connected components of an edge table; see ``riskgrid.operators.components``."""

from riskgrid.operators.components import components

__all__ = ["components"]
