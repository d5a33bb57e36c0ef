"""The content digest of a window as a tree: cells, grid lines, frames, window.

A cell's leaf is the SHA-256 of its numbers in fixed point (nine digits, so
that every engine writes the same text), a line's digest that of its leaves in
order of columns, a frame's that of its lines in order of rows, the window's
that of its frames in order of time. A group never holds more than one side of
the grid, or the window's frames. Who has the digests of the frames tells
which ones changed without reading the others, and a check under a lease reads
those of interest only.

Defined cases: unknown risk is written as null, a missing factor as 1; a cell
that stands twice in a frame is two leaves, in the order of their digests; an
empty window has the digest of the empty text; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def _fixed(x: Column) -> Column:
    return F.coalesce(F.round(x.cast("double") * 10**DIGITS).cast("long").cast("string"), F.lit("null"))


def leaf(cell: tuple[str, ...] = ("lat", "lon", "risk", "hard", "confidence", "factor")) -> Column:
    """Digest of a cell's content."""
    values = {"hard": F.coalesce(F.col("hard").cast("string"), F.lit("null")), "factor": _fixed(F.coalesce("factor", F.lit(1.0)))}
    return F.sha2(F.concat_ws("|", *(values.get(c, _fixed(F.col(c))) for c in cell)), 256)


def _folded(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One digest for each key from its rows' digests in order."""
    parts = F.sort_array(F.collect_list(F.struct(order, "digest")))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["digest"]), ""), 256).alias("digest"))


def frame_digests(cube: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, frame, valid_us, digest) of every frame."""
    own = [*keys, "frame", "valid_us"]
    lines = _folded(cube.select(*own, "row", "col", leaf().alias("digest")), [*own, "row"], "col")
    return _folded(lines, own, "row")


def window_digest(frames: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, frames, digest) of windows from the digests of their frames (keys, valid_us, digest)."""
    parts = F.sort_array(F.collect_list(F.struct("valid_us", "digest")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["valid_us"].cast("string"), F.lit(":"), p["digest"])), ",")
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))


def changed_frames(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, valid_us, change) of frames that are new, gone or other between two tables of frame digests; cells are not read."""
    on = [*keys, "valid_us"]
    a, b = before.select(*on, F.col("digest").alias("a")), after.select(*on, F.col("digest").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "other")
    return a.join(b, on, "full").select(*on, change.alias("change")).where("change is not null")
