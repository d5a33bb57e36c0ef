"""Operators over cubes, frames, grids, searches, plans and publications."""
