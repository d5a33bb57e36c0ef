"""A store of complete layered plan sets: a set comes in whole, checked and fenced, or not at all.

Publishing is a commit in two phases over several tables. First a writer puts
what it adds (commands, sets, plans) and what stands after it in a fresh
folder, and decides from what it reads back there: ids are computed again from
contents, the set's token must be that of its command, and the fence of
``publish.replay`` must let it through. Then one file, created whole under the
number after the one the writer began from, names all segments and the table
of standing sets. So a writer that is lost at any step leaves the old state, a
reader never sees a part, and of two writers that began from one state one
fails and may begin again.

Only logs that get commands are replayed; what stands for the others is taken
over as it is. Plans are grouped by (set, layer, objective) first, so no more
than one row for each of the twelve places is ever gathered for a set.

Defined cases: a publication of a set that isn't there is refused; so is one
whose set is told twice; plans of no set are kept but never read; an empty
addition changes nothing but the number; null contents have no digest, so
their ids don't match; extra columns are not kept.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions.motion import OBJECTIVES
from riskgrid.functions.values import canonical_bytes
from riskgrid.operators.codec import VOLATILE, VOLATILE_METRICS
from riskgrid.operators.layers import LAYERS
from riskgrid.operators.plan_sets import PLAN_ID, SET_ID
from riskgrid.operators.publish import TOKEN, _pointers, replay
from riskgrid.operators.shared import create_file, dealt, written

FULL = LAYERS[0][0]
PLACES = len(LAYERS) * len(OBJECTIVES)
#: Columns of the tables of a store.
COMMANDS = ("log", "seq", "kind", *TOKEN, "plan_id")
SETS = ("set_id", "layer_set_id", *TOKEN)
PLANS = ("set_id", "layer", "objective", "plan_id", "reference_plan_id", "content")
STANDING = "log string, current string, previous string"


def contents(plans: DataFrame) -> DataFrame:
    """Plans of ``plan_sets.layered_plans`` with their content: the canonical text of all that counts for their ids."""

    @F.pandas_udf("string")
    def content(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            own = {k: v for k, v in json.loads(text).items() if k not in VOLATILE}
            own["metrics"] = {k: v for k, v in own["metrics"].items() if k not in VOLATILE_METRICS}
            out.append(canonical_bytes(own).decode())
        return pd.Series(out, dtype=object)

    return plans.withColumn("content", content("document")).select(*PLANS)


def set_ids(plans: DataFrame) -> DataFrame:
    """What the plans of each set come to: set_id, expected_id, and faults as booleans."""
    known = F.col("layer").isin([n for n, _ in LAYERS]) & F.col("objective").isin(list(OBJECTIVES))
    digest = F.sha2("content", 256)
    right = F.coalesce(F.col("plan_id") == F.concat(F.lit(PLAN_ID), digest), F.lit(False))
    place = dealt(plans, "set_id").groupBy("set_id", F.when(known, F.col("layer")).alias("layer"), F.when(known, F.col("objective")).alias("objective")).agg(
        F.count("*").alias("n"),
        F.max(digest).alias("digest"),
        F.bool_and(right).alias("right"),
        F.max("plan_id").alias("plan_id"),
        F.max("reference_plan_id").alias("high"),
        F.min(F.coalesce("reference_plan_id", F.lit(""))).alias("low"),
    )
    full = (F.col("layer") == FULL) & (F.col("objective") == "recommended")
    lower = F.col("layer") != FULL
    by = place.groupBy("set_id").agg(
        F.count_if(F.col("layer").isNotNull() & (F.col("n") == 1)).alias("single"),
        F.count("*").alias("places"),
        F.bool_and("right").alias("right"),
        F.max(F.when(full, F.col("plan_id"))).alias("full_id"),
        F.max(F.when(lower, F.col("high"))).alias("high"),
        F.min(F.when(lower, F.col("low"))).alias("low"),
        F.count(F.when(F.col("layer") == FULL, F.col("high"))).alias("circular"),
        F.sort_array(F.collect_list(F.when(F.col("layer").isNotNull(), F.col("digest")))).alias("plans"),
    )
    named = F.coalesce((F.col("high") == F.col("full_id")) & (F.col("low") == F.col("full_id")) & (F.col("circular") == 0), F.lit(False))
    text = F.to_json(F.struct("plans", F.col("set_id").alias("set")))
    return by.select(
        "set_id",
        F.concat(F.lit(SET_ID), F.sha2(text, 256)).alias("expected_id"),
        ((F.col("single") == PLACES) & (F.col("places") == PLACES)).alias("whole"),
        "right",
        named.alias("named"),
    )


def set_faults(sets: DataFrame, plans: DataFrame) -> DataFrame:
    """(set_id, layer_set_id, token, fault): the first thing wrong with each set, NULL if it holds."""
    told = sets.groupBy("set_id").agg(F.count("*").alias("__rg_n"), *(F.first(c).alias(c) for c in SETS[1:]))
    met = told.join(set_ids(plans), "set_id", "left")
    fault = (
        F.when(F.col("__rg_n") > 1, "told twice")
        .when(~F.coalesce("whole", F.lit(False)), "not every layer and objective once")
        .when(~F.col("right"), "a plan's id does not match its content")
        .when(~F.col("named"), "a plan names another reference")
        .when(~F.col("layer_set_id").eqNullSafe(F.col("expected_id")), "the set's id does not match its content")
    )
    return met.select(*SETS, fault.alias("fault"))


def replay_sets(commands: DataFrame, sets: DataFrame, plans: DataFrame) -> DataFrame:
    """(log, seq, kind, outcome, current, previous) of every command, as ``publish.replay`` gives them, with faulty sets refused and nothing changed by them."""
    own = set_faults(sets, plans).select(F.col("set_id").alias("plan_id"), F.struct(*TOKEN).alias("__rg_t"), "fault", F.lit(True).alias("__rg_there"))
    met = commands.select(*COMMANDS).join(own, "plan_id", "left")
    other: Column = F.coalesce(*(F.when(~F.col(c).eqNullSafe(F.col(f"__rg_t.{c}")), F.lit(f"set of another {c}")) for c in TOKEN))
    fault = F.when(F.col("__rg_there").isNull(), "no such set").otherwise(F.coalesce("fault", other))
    kind = F.when((F.col("kind") == "publish") & fault.isNotNull(), F.concat(F.lit("publish/"), fault)).otherwise(F.col("kind"))
    said = replay(met.withColumn("kind", kind), commands.count())
    fault = F.when(F.col("kind").startswith("publish/"), F.substring_index("kind", "/", -1))
    outcome = F.when((F.col("outcome") == "ok") & fault.isNotNull(), F.concat(F.lit("rejected: "), fault)).otherwise(F.col("outcome"))
    return said.select("log", "seq", F.substring_index("kind", "/", 1).alias("kind"), outcome.alias("outcome"), "current", "previous")


def submission(plans: DataFrame, tokens: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Sets and plans to commit, of ``plan_sets.layered_plans`` (written to ``path``) and the token of each set (set_id, TOKEN).

    A set's id follows from its plans; one that lacks a plan gets an id too and
    is refused by the store.
    """
    own = written(contents(plans), path)
    ids = set_ids(own).select("set_id", F.col("expected_id").alias("layer_set_id"))
    return ids.join(tokens.select("set_id", *TOKEN), "set_id").select(*SETS), own


def _state(spark: SparkSession, root: str) -> tuple[int, list[str], str | None]:
    """Number of the last commit under ``root``, its segments, and its table of standing sets."""
    found = max(_pointers(spark, root), default=None)
    if found is None:
        return -1, [], None
    standing, *segments = json.loads(spark.read.text(found[1], wholetext=True).first().value)
    return found[0], segments, standing


def _table(spark: SparkSession, segments: list[str], name: str) -> DataFrame:
    return spark.read.parquet(*(f"{s}/{name}" for s in segments))


def commit(root: str, commands: DataFrame, sets: DataFrame, plans: DataFrame) -> DataFrame:
    """Add commands, sets and plans to the store under ``root``; returns the outcome of every added command.

    Commands must come after those of their log that the store has. Raises if
    another writer has committed since this one began; nothing is changed then.
    """
    spark = commands.sparkSession
    number, segments, before = _state(spark, root)
    own = f"{root}/segment-{uuid.uuid4().hex}"
    added = written(commands.select(*COMMANDS), f"{own}/commands")
    written(sets.select(*SETS), f"{own}/sets")
    written(plans.select(*PLANS), f"{own}/plans")
    segments = [*segments, own]
    # decided from what was written, for the logs that get commands
    logs = added.select("log").distinct()
    log = _table(spark, segments, "commands").join(logs, "log", "left_semi")
    asked = log.where("kind = 'publish'").select(F.col("plan_id").alias("set_id")).distinct()
    own_sets, own_plans = (dealt(_table(spark, segments, t), "set_id").join(asked, "set_id", "left_semi") for t in ("sets", "plans"))
    said = written(replay_sets(log, own_sets, own_plans), f"{own}/said")
    order = F.struct("seq", "kind")
    last = said.groupBy("log").agg(F.max_by("current", order).alias("current"), F.max_by("previous", order).alias("previous"))
    if before:
        last = last.unionByName(spark.read.schema(STANDING).parquet(before).join(logs, "log", "left_anti"))
    written(last, f"{own}/standing")
    if not create_file(spark, f"{root}/pointer-{number + 1:012d}", json.dumps([f"{own}/standing", *segments])):
        raise RuntimeError(f"another writer has committed under {root} meanwhile")
    return said.join(added.select("log", "seq").distinct(), ["log", "seq"], "left_semi")


def standing(spark: SparkSession, root: str) -> DataFrame:
    """(log, current, previous): ids of the sets that stand; no rows if nothing was committed."""
    _, _, path = _state(spark, root)
    return spark.read.schema(STANDING).parquet(path) if path else spark.createDataFrame([], STANDING)


def current_plans(spark: SparkSession, root: str) -> DataFrame:
    """log and the plans of the set that stands for it."""
    _, segments, path = _state(spark, root)
    if not path:
        raise LookupError(f"nothing is committed under {root}")
    now = spark.read.schema(STANDING).parquet(path).where("current is not null").select("log", F.col("current").alias("set_id"))
    return now.join(dealt(_table(spark, segments, "plans"), "set_id"), "set_id")
