"""Replanning triggers as a stateful stream.

Each micro-batch is dealt by key; the baseline of a key is its state. Within a
batch a key's observations are folded in (at_us, seq) order, so a stream whose
files arrive in time order decides as the batch fold does. A batch holds as
many files as the source hands out (``files_per_batch``), which bounds what a
key can have in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskgrid.operators.shared import folder
from riskgrid.operators.replan import DECISIONS, OBSERVATION, Baseline, Policy, state_dict, step

STATE = "at_us bigint, valid_us bigint, data_revision bigint, risk_revision string, avg_risk double, max_risk double, event string, latched boolean, generation bigint"


def decisions(stream: DataFrame, policy: Policy | None = None) -> DataFrame:
    """A streaming DataFrame of decisions for a streaming DataFrame of observations."""
    policy = policy or Policy()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = Baseline(*held.get) if held.exists else Baseline()
        pdf = pd.concat(list(batches)).sort_values(["at_us", "seq"])
        pdf["event"] = pdf["event"].astype(object).where(pdf["event"].notna(), None)
        rows = [step(state, o, policy) for o in pdf.itertuples(index=False)]
        held.update(tuple(None if v is None else getattr(v, "item", lambda v=v: v)() for v in state_dict(state).values()))
        yield pd.DataFrame(rows, columns=["key", "seq", "outcome", "reasons", "retry_us"]).astype({"retry_us": "Int64"})

    wanted = stream.select(*OBSERVATION)
    return wanted.groupBy("key").applyInPandasWithState(fold, DECISIONS, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_triggers(observations: DataFrame, policy: Policy | None = None, files: int = 1, files_per_batch: int = 1) -> DataFrame:
    """Run a table of observations through the stream, and read its decisions back.

    The observations are written in time order to ``files`` files, which the
    file source hands out in the order of their writing; the sink commits each
    batch once, and the checkpoint lets a lost driver go on.
    """
    spark = observations.sparkSession
    base = folder(spark, "stream")
    wanted = observations.select(*OBSERVATION)
    if files == 1:
        wanted.write.parquet(f"{base}/in")
    else:
        cuts = wanted.approxQuantile("at_us", [k / files for k in range(1, files)], 0.0)
        for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
            part = wanted if low is None else wanted.where(wanted.at_us > int(low))
            part = part if high is None else part.where(part.at_us <= int(high))
            part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(wanted.schema).option("maxFilesPerTrigger", files_per_batch if files > 1 else 100_000).parquet(f"{base}/in")
    sink = decisions(source, policy).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    sink.awaitTermination()
    return spark.read.schema(DECISIONS).parquet(f"{base}/out")
