"""Column functions: geometry, vessel motion and cost, values and patterns."""

from riskgrid.functions.geo import bearing_degrees, edge_points, haversine_km, heading_change
from riskgrid.functions.motion import Vessel, Weights, edge_cost, lower_bound, risk_level, vessel_speed

__all__ = ["Vessel", "Weights", "bearing_degrees", "edge_cost", "edge_points", "haversine_km", "heading_change", "lower_bound", "risk_level", "vessel_speed"]
