"""Connected components of an edge table, by alternating star operations.

Large-star links every larger neighbour of a node to the smallest node next to
it; small-star does so for the smaller neighbours. Alternating them turns each
component into a star around its smallest node in a number of rounds that
grows with the logarithm of its size. Every round is two joins on the node id
and is written to the shared folder, so lost executors cost one round at most.
The edges never leave the executors; the driver sees one count and one sum.

A node with many neighbours is no bottleneck: its least neighbour is found by
partial minima, and in the join it meets one row, which Spark's skew join
copies to the parts of a large side.

Defined cases: loops and repeated edges count for nothing; a null end is no
edge; nodes without an edge don't come out; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators.shared import folder, written


def _linked(edges: DataFrame, larger: bool) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = edges.join(low, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) of any order in; (node, root) out: every node but the roots, with the smallest node of its component."""
    turned = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = written(_clean(edges.where("u is not null and v is not null").select(*turned)), folder(edges.sparkSession, name))
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = _clean(_linked(both, True)).select(*turned)
        now = written(_clean(_linked(star, False)).select(*turned), folder(edges.sparkSession, name))
