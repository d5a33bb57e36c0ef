"""Sharding by histogram sort: shards of near equal bytes, in one exchange.

Rows are ordered by (hash of the text, id), so equal texts are neighbours.
Boundaries are probed on this key: every round counts the exact bytes and rows
between all probes over all partitions (one small row for each interval), and
only intervals that hold a cut, or too many rows, get new probes. Probes fall
between different texts; ids are probed only inside one text, so the copies of
a text stay together unless they hold more bytes than the tolerance at a cut.
When every cut is within the tolerance, or its interval cannot be parted, each
row's interval is known from its key alone, rows are exchanged once by
interval, and a row's slot is its rank in the interval plus the exact count of
rows before it in its shard. Intervals are many more than shards and bounded
in rows, so no task holds a shard or all copies of a text; only rows that
agree in text and id (and, if the id is null, in all columns) can't be parted.

Rounds read a written table of keys (24 bytes a row), not the texts.

Defined cases: a null text counts as empty (size 1); very long texts count as
they are; repeated rows share a key and stand next to each other, in the order
of a hash of the whole row; among the copies of a text a null id stands where
that hash puts it; an empty table gives no rows; extra columns stay, and those
called size, text_crc32, shard or slot are renamed to input_<name>.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.llm.common import frozen

#: Share of a shard's bytes by which a cut may miss its target.
TOLERANCE = 0.001
#: Intervals that rows are dealt into at least, and probes for one cut and round.
INTERVALS, PROBES = 1024, 64
LOWEST = -(2**63)


@dataclass
class Interval:
    """Keys from ``start`` (inclusive) to the next interval's; exact figures of its rows."""

    start: tuple[int, int]
    bytes: int = 0
    rows: int = 0
    low: tuple[int, int] = (0, 0)
    high: tuple[int, int] = (0, 0)


def place(h: np.ndarray, d: np.ndarray, starts: list[tuple[int, int]]) -> np.ndarray:
    """Index of the interval of each key (h, d); ``starts`` ascend, the first is below all keys."""
    sh = np.array([s[0] for s in starts], np.int64)
    sd = np.array([s[1] for s in starts], np.int64)
    lo, hi = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
    out = hi - 1
    inside = np.flatnonzero(hi > lo)  # some start has the same hash: its ids decide
    for first in np.unique(lo[inside]):
        own = inside[lo[inside] == first]
        out[own] = first + np.searchsorted(sd[first : hi[own[0]]], d[own], "right") - 1
    return out


def counted(keys: DataFrame, starts: list[tuple[int, int]]) -> list[Interval]:
    """Exact bytes, rows and extreme keys of all intervals."""
    shared = keys.sparkSession.sparkContext.broadcast(starts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(shared.value)
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least = np.full((2, n), np.iinfo(np.int64).max)
        most = np.full((2, n), np.iinfo(np.int64).min)
        for pdf in batches:
            h, d = pdf["h"].to_numpy(np.int64), pdf["d"].to_numpy(np.int64)
            at = place(h, d, shared.value)
            np.add.at(size, at, pdf["size"].to_numpy(np.int64))
            np.add.at(rows, at, 1)
            for k, x in enumerate((h, d)):
                np.minimum.at(least[k], at, x)
                np.maximum.at(most[k], at, x)
        at = np.flatnonzero(rows)
        yield pd.DataFrame({"i": at, "size": size[at], "n": rows[at], "h0": least[0][at], "h1": most[0][at], "d0": least[1][at], "d1": most[1][at]})

    parts = keys.mapInPandas(count, "i long, size long, n long, h0 long, h1 long, d0 long, d1 long")
    found = parts.groupBy("i").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("h0").alias("h0"), F.max("h1").alias("h1"), F.min("d0").alias("d0"), F.max("d1").alias("d1")).collect()
    out = [Interval(s) for s in starts]
    for r in found:
        out[r.i] = Interval(starts[r.i], r["size"], r.n, (r.h0, r.d0), (r.h1, r.d1))
    return out


def probes(x: Interval, parts: int) -> list[tuple[int, int]]:
    """New starts inside an interval: between texts, or between ids if it holds one text."""
    k = 0 if x.low[0] < x.high[0] else 1
    lo, hi = x.low[k], x.high[k]
    values = {lo + 1 + (hi - lo - 1) * j // parts for j in range(parts)} if hi > lo else set()
    return [(v, LOWEST) if k == 0 else (x.low[0], v) for v in values]


def plan(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE, intervals: int = INTERVALS) -> tuple[list[Interval], list[int]]:
    """Intervals with exact figures, and for each the shard it belongs to."""
    step = 2**64 // intervals
    starts = [(LOWEST, LOWEST), *((LOWEST + step * j, LOWEST) for j in range(1, intervals))]
    while True:
        found = counted(keys, starts)
        total, rows = sum(x.bytes for x in found), sum(x.rows for x in found)
        most = max(4 * rows // intervals, 1000)
        ends = np.cumsum([x.bytes for x in found])
        new: set[tuple[int, int]] = set()
        cuts = []
        for j in range(1, n_shards):
            target = total * j / n_shards
            i = int(np.searchsorted(ends, target))
            below = int(ends[i]) - found[i].bytes if i < len(found) else total
            miss, cut = min((abs(target - below), i), (abs(target - int(ends[min(i, len(found) - 1)])), i + 1))
            more = probes(found[i], PROBES) if i < len(found) and miss > tolerance * total / n_shards else []
            new.update(more)
            cuts.append(cut)
        for x in found:
            if x.rows > most:
                new.update(probes(x, 2 * x.rows // most + 1))
        new -= set(starts)
        if not new:
            shard = np.searchsorted(np.array(sorted(cuts)), np.arange(len(found)), "right")
            return found, shard.tolist()
        starts = sorted({*starts, *new})


def with_free_names(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with every column of one of ``names`` called input_<name> instead (with more underscores if that is taken too)."""
    for name in names:
        if name in docs.columns:
            new = f"input_{name}"
            while new in docs.columns:
                new += "_"
            docs = docs.withColumnRenamed(name, new)
    return docs


def sharded(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """All rows and columns, and size, text_crc32, shard and slot (gapless from 0 in each shard, ordered by text hash, id and a hash of the row)."""
    docs = with_free_names(docs, ("size", "text_crc32", "shard", "slot"))
    text = F.coalesce("text", F.lit(""))
    whole = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    keyed = docs.withColumns({"__rg_h": F.xxhash64(text), "__rg_r": whole, "__rg_d": F.coalesce("doc_id", whole), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    keys = frozen(keyed.select(F.col("__rg_h").alias("h"), F.col("__rg_d").alias("d"), "size"), "shard-keys")
    found, shard = plan(keys, n_shards, tolerance)
    before, rows = 0, []
    for i, x in enumerate(found):
        if i and shard[i] != shard[i - 1]:
            before = 0
        rows.append((i, int(shard[i]), before))
        before += x.rows
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([x.start for x in found])

    @F.pandas_udf("long")
    def interval(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(place(h.to_numpy(np.int64), d.to_numpy(np.int64), shared.value))

    offsets = spark.createDataFrame(rows, "__rg_i long, shard int, __rg_before long")
    order = Window.partitionBy("__rg_i").orderBy("__rg_h", "__rg_d", "text", "__rg_r")
    ranked = keyed.withColumn("__rg_i", interval("__rg_h", "__rg_d")).withColumn("__rg_n", F.row_number().over(order))
    # one row for each interval: bounded by the number of probes
    return ranked.join(F.broadcast(offsets), "__rg_i").withColumn("slot", F.col("__rg_before") + F.col("__rg_n") - 1).drop("__rg_h", "__rg_d", "__rg_r", "__rg_i", "__rg_n", "__rg_before")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """The shards as folders shard=k of Parquet files."""
    sharded(docs, n_shards).write.partitionBy("shard").parquet(path)
