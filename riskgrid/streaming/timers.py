"""Replanning as a stream with event-time timers: files may come in any order within a delay.

A key's observations are held until the watermark has passed them, then taken
in (at_us, seq) order; so whatever the order of the files, decisions are those
of ``replan.timed``. A decision that waits has a timer at its retry time, and
fires when the watermark gets there although no observation comes; a later
generation clears baseline and timer. State of a key is one value (baseline,
waiting decision, the observations held and the time of its timer), in the
RocksDB store. A call reads and writes it once, whatever it holds, and takes
and gives plain rows; a key has one timer. So the store is asked by key and
batch, not by row, and no frame is made for a key. What a key holds is bounded by its
observations within the delay and a batch.

Defined cases: an observation that comes later than the delay is not decided
(Spark counts it in ``numRowsDroppedByWatermark``); one that comes twice
within it, by at_us and seq, is decided once; one that lacks a needed field is
left out (``replan.complete``); what the watermark has not passed yet stays in the state, over restarts too.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskgrid.operators.replan import TIMED, TIMED_OBSERVATION, Baseline, Held, Policy, Timed, complete, state_dict
from riskgrid.operators.shared import folder, written
from riskgrid.streaming.triggers import STATE

#: The state store that timers and maps need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "seq bigint, retry_us bigint, held_valid_us bigint, held_data_revision bigint, held_risk_revision string, held_avg_risk double, held_max_risk double, held_event string, published boolean, reasons string"
ORDER = "at_us bigint, seq bigint"
REST = tuple(c for c in TIMED_OBSERVATION if c not in ("key", "at_us", "seq"))
WAITING = "valid_us bigint, data_revision bigint, risk_revision string, avg_risk double, max_risk double, deviation_km double, event string, manual boolean, hard boolean, published boolean, generation int"


class _Observation:
    def __init__(self, at_us: int, seq: int, rest: tuple) -> None:
        self.at_us, self.seq = at_us, seq
        self.__dict__.update(zip(REST, rest, strict=True))


class Decider(StatefulProcessor):
    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = f"{ORDER}, {WAITING}".replace(", ", ",").replace(" ", ":")
        self.state = handle.getValueState("state", f"{STATE}, {HELD}, due_ms bigint, waiting array<struct<{fields}>>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(o[c] for c in ("at_us", "seq", *REST)) for o in rows]
        own, due, waiting = self._read()
        waiting += new
        self._write(own, self._due(due, min((at for at, *_ in new), default=None)), waiting)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        own, _, held = self._read()
        # of one that came twice the later counts
        waiting = {(at, seq): rest for at, seq, *rest in held}
        out, left = [], []
        for at, seq in sorted(waiting):
            if at > now:
                left.append((at, seq, *waiting[at, seq]))
            else:
                out += own.take(_Observation(at, seq, tuple(waiting[at, seq])))
        out += own.ring(now)
        times = [left[0][0]] if left else []
        times += [own.held.at_us] if own.held else []
        self._write(own, self._due(None, min(times, default=None)), left)
        yield from (Row(key=key[0], seq=seq, at_us=at, outcome=outcome, reasons=reasons, retry_us=retry) for seq, at, outcome, reasons, retry in out)

    def _read(self) -> tuple[Timed, int | None, list[tuple]]:
        """A key's baseline and waiting decision, the time of its timer, and the observations held."""
        own, value = Timed(self.policy, Baseline()), self.state.get()
        if value is None:
            return own, None, []
        n = len(state_dict(own.baseline))
        own.baseline = Baseline(*value[:n])
        own.held = None if value[n] is None else Held(*value[n : n + len(Held._fields)])
        return own, value[-2], [tuple(o) for o in value[-1]]

    def _write(self, own: Timed, due: int | None, waiting: list[tuple]) -> None:
        self.state.update((*state_dict(own.baseline).values(), *(own.held or (None,) * len(Held._fields)), due, waiting))

    def _due(self, before: int | None, at_us: int | None) -> int | None:
        """Call again when the watermark has passed a time, if the key's timer doesn't ring ``before`` it."""
        at = None if at_us is None else -(-at_us // 1000)
        if at is None or (before is not None and before <= at):
            return before
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        return at

    def close(self) -> None:
        pass


def timed_decisions(stream: DataFrame, delay: str, policy: Policy | None = None) -> DataFrame:
    """A streaming DataFrame of decisions for one of observations (TIMED_OBSERVATION), which may come up to ``delay`` behind the newest."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    wanted = complete(stream).withColumn("__rg_at", F.timestamp_micros("at_us")).withWatermark("__rg_at", delay)
    return wanted.groupBy("key").transformWithState(statefulProcessor=Decider(policy or Policy()), outputStructType=TIMED, outputMode="Append", timeMode="EventTime")


def stream_timed(observations: DataFrame, delay_us: int, policy: Policy | None = None, files: int = 4) -> DataFrame:
    """Run a table of observations through the stream, out of order by less than ``delay_us``, and read its decisions back.

    The rows come in ``files`` batches, cut by their time plus a part of the
    delay that follows from their seq; each is written by all tasks, and the
    stream goes on from its checkpoint when it is there. A last one has one
    observation of the greatest key, so much later that all others are decided.
    """
    spark = observations.sparkSession
    base = folder(spark, "timers")
    wanted = written(complete(observations), f"{base}/all")
    come = F.col("at_us") + F.pmod(F.xxhash64("seq"), F.lit(delay_us // 2))
    cuts = wanted.select(come.alias("c")).approxQuantile("c", [k / files for k in range(1, files)], 0.01)
    last = wanted.agg(F.max("at_us").alias("at"), F.max("key").alias("key")).first()
    if last.at is None:
        return spark.createDataFrame([], TIMED)

    def come_in(part: DataFrame) -> None:
        part.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(wanted.schema).parquet(f"{base}/in")
        sink = timed_decisions(source, f"{delay_us} microseconds", policy).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        sink.awaitTermination()

    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = wanted if low is None else wanted.where(come > int(low))
        come_in(part if high is None else part.where(come <= int(high)))
    end = last.at + 2 * delay_us + 10 * (policy or Policy()).min_interval_us
    closing = wanted.limit(1).withColumns({"key": F.lit(last.key + 1), "at_us": F.lit(end), "valid_us": F.lit(end)})
    come_in(closing.select(*wanted.columns))
    return spark.read.schema(TIMED).parquet(f"{base}/out").where(F.col("key") <= last.key)
