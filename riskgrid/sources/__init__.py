"""Where cubes, frames and observations come from."""
