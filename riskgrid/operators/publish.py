"""Fenced publication: what every command of a log does, from window expressions alone.

Commands (activate, cancel, publish) come as a log for each run, each with the
token of its request. What stands at a command follows from what came before:

* Activations of one run in a row form a stretch. One counts if its
  (generation, revision) is not below the greatest of its stretch so far; so
  the active token is that of the last one that counts.
* A cancellation counts if it has the active token, and holds until another
  token becomes active. The cancelled token can't be activated again.
* A publication stands if it has the active token and that is not cancelled.
* The current plan is that of the last publication that stands, the previous
  one the last different plan before it; both go when a token of another
  context (run, scenario, generation, digests) becomes active.

Every log is one sorted stretch of rows: its order allows nothing else, and
Spark's windows spill. Logs are dealt by their key over as many tasks as the
number of commands asks for.

Defined cases: a null in a token is a value like any other; commands of equal
seq are taken in the order of kind and token; an empty log gives no rows; extra
columns stay out of ``replay`` and in ``fence``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.operators.shared import create_file, dealt

#: Fields of a token (fixed set); the first six are its context.
TOKEN = ("run_id", "scenario_id", "generation", "config_digest", "model_digest", "planner_digest", "request_id", "revision")
CONTEXT = TOKEN[:6]


def replay(commands: DataFrame, rows: int | None = None) -> DataFrame:
    """(log, seq, kind, outcome, current, previous) of every command (log, seq, kind, token columns, plan_id): what it did, and the plans that stand after it.

    rows: how many commands there are, if that is known.
    """
    token, context = F.struct(*TOKEN), F.struct(*CONTEXT)
    rows = dealt(commands.select("log", "seq", "kind", *TOKEN, "plan_id"), "log", rows=rows).withColumns({"__rg_t": token, "__rg_x": context, "__rg_a": F.col("kind") == "activate"})
    order = ("seq", "kind", "__rg_t")

    def before(*keys: str):
        return Window.partitionBy("log", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def upto(*keys: str):
        return Window.partitionBy("log", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def last(value: str, when: Column, window) -> Column:
        """The latest value at which a condition holds; in a struct, so that nulls count."""
        return F.last(F.when(when, F.struct(value)), ignorenulls=True).over(window)[value]

    # stretches of activations of one run, and which of them reach the greatest so far
    run = F.struct("run_id")
    rows = rows.withColumn("__rg_b", F.last(F.when(F.col("__rg_a"), run), ignorenulls=True).over(before()))
    rows = rows.withColumn("__rg_s", F.count_if(F.col("__rg_a") & ~F.col("__rg_b").eqNullSafe(run)).over(upto()))
    level = F.struct("generation", "revision")
    rows = rows.withColumn("__rg_m", F.max(F.when(F.col("__rg_a"), level)).over(before("__rg_s")))
    reached = F.col("__rg_a") & (F.col("__rg_m").isNull() | (level >= F.col("__rg_m")))
    rows = rows.withColumn("__rg_r", reached)
    # the active token before each command, and the epochs of tokens and contexts
    rows = rows.withColumns({"__rg_o": last("__rg_t", F.col("__rg_r"), before()), "__rg_ox": last("__rg_x", F.col("__rg_r"), before()), "__rg_n": F.count_if("__rg_r").over(before())})
    rows = rows.withColumn("__rg_own", (F.col("__rg_n") > 0) & F.col("__rg_o").eqNullSafe(F.col("__rg_t")))
    rows = rows.withColumns(
        {
            "__rg_e": F.count_if(F.col("__rg_r") & ~F.col("__rg_own")).over(upto()),
            "__rg_c": F.count_if(F.col("__rg_r") & ((F.col("__rg_n") == 0) | ~F.col("__rg_ox").eqNullSafe(F.col("__rg_x")))).over(upto()),
        }
    )
    cancels = (F.col("kind") == "cancel") & F.col("__rg_own")
    rows = rows.withColumn("__rg_gone", F.coalesce(F.bool_or(cancels).over(before("__rg_e")), F.lit(False)))
    older = F.col("generation") < F.col("__rg_m.generation")
    outcome = (
        F.when(F.col("__rg_a"), F.when(F.col("__rg_r"), F.when(F.col("__rg_own") & F.col("__rg_gone"), "rejected: cancelled").otherwise("ok")).when(older, "rejected: older generation").otherwise("rejected: older revision"))
        .when(F.col("kind") == "cancel", F.when(F.col("__rg_own"), "ok").otherwise("not active"))
        .otherwise(F.when(F.col("__rg_n") == 0, "rejected: nothing active").when(~F.col("__rg_own"), "rejected: stale").when(F.col("__rg_gone"), "rejected: cancelled").otherwise("ok"))
    )
    rows = rows.withColumn("outcome", outcome)
    # plans that stand, each with the one before it in its context
    stands = (F.col("kind") == "publish") & (F.col("outcome") == "ok")
    rows = rows.withColumn("__rg_p", last("plan_id", stands, before("__rg_c")))
    rows = rows.withColumn("__rg_k", F.count_if(stands).over(before("__rg_c")))
    other = stands & (F.col("__rg_k") > 0) & ~F.col("__rg_p").eqNullSafe(F.col("plan_id"))
    return rows.select("log", "seq", "kind", "outcome", last("plan_id", stands, upto("__rg_c")).alias("current"), last("__rg_p", other, upto("__rg_c")).alias("previous"))


def fence(commands: DataFrame) -> DataFrame:
    """Publications that a fence lets through that knows requests alone.

    For logs whose activations only move forward: a publication stands if its
    request is the last one activated before it and was not cancelled since.
    """
    w = Window.partitionBy("log").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    now = commands.withColumn("__rg_a", F.last(F.when(F.col("kind") == "activate", F.col("request_id")), ignorenulls=True).over(w))
    v = Window.partitionBy("log", "__rg_a").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    now = now.withColumn("__rg_c", F.max(((F.col("kind") == "cancel") & (F.col("request_id") == F.col("__rg_a"))).cast("int")).over(v))
    ok = (F.col("request_id") == F.col("__rg_a")) & (F.col("__rg_c") == 0)
    return now.where("kind = 'publish'").select("log", "seq", "plan_id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def latest_plan(published: DataFrame) -> DataFrame:
    """Of accepted publications, the one of the highest (generation, revision, seq) by run."""
    return published.where("accepted").groupBy("log").agg(F.max_by("plan_id", F.struct("generation", "revision", "seq")).alias("plan_id"))


def publish_table(df: DataFrame, root: str) -> str:
    """Put a table in place of the one published under ``root``, whole or not at all; returns its path.

    The rows go to a fresh folder; then a pointer file that names it is
    created beside, under the next free number. The file system lets one
    writer only create a file, so of two that take the same number one fails.
    Readers follow the pointer of the greatest number.
    """
    spark = df.sparkSession
    path = f"{root}/data-{uuid.uuid4().hex}"
    df.write.parquet(path)
    number = max((n for n, _ in _pointers(spark, root)), default=-1) + 1
    if not create_file(spark, f"{root}/pointer-{number:012d}", path):
        raise RuntimeError(f"another writer has published under {root} meanwhile")
    return path


def published_table(spark: SparkSession, root: str) -> DataFrame:
    """The table published last under ``root``."""
    for _, pointer in sorted(_pointers(spark, root), reverse=True):
        named = spark.read.text(pointer).take(1)
        if named:
            return spark.read.parquet(named[0].value)
    raise LookupError(f"nothing is published under {root}")


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer-*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    paths = [str(f.getPath().toString()) for f in found or []]
    return [(int(p.rsplit("-", 1)[1]), p) for p in paths if not p.endswith(".new")]
