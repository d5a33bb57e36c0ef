"""Time-dependent risk cubes and route planning over them, on Spark DataFrames."""
