"""How far sources of a language are apart in their words, and by which words.

A term is a run of letters (ASCII letters and all non-ASCII characters, only
A-Z folded). A language keeps the terms that stand in at least ``LEAST_DOCS``
of its documents. Every (language, source) group has for each kept term a
smoothed share of 10**9 parts; two groups are apart by the sum of their
differences over all kept terms, and a group's own terms are those whose share
exceeds the language's. All figures are whole numbers.

The method is a systolic rotation. A language's terms are cut into blocks of
about ``BLOCK``, its groups into seats; a task owns (language, block, seat) and
keeps the dense shares of the seat's few groups for that block. The seats of a
language play a round-robin tournament (circle method): in every round each
seat meets one other, each pair of seats once, and for every meeting one of
both travels to the other as packed vectors (term positions and counts). A
task takes its visitors in the order of the rounds, one vector at a time, and
evaluates both directions; it holds no more than its residents and one
visitor. The language's own vector visits every seat first, and a heap for
each resident keeps the ``RANKS`` best terms of the block. Sums over blocks
and the last ranking of heaps are small aggregations.

All of this is one shuffle of packed vectors. It grows with the square of the
number of seats, as the result does with the square of the number of sources;
neither documents nor terms are in it more than once for a group.

Every task counts the terms of its texts into one table and hands on sums, so
a source with a third of all documents is dealt by its terms. A row of the exchange is one
group's part of one block, at most some tens of kilobytes.

Defined cases: null text, lang and source are the empty string; a text without
a term only makes its group occur; very long texts are counted whole; repeated
rows count each; a language without kept terms has pairs of value 0 and no
terms; equal values are ranked by the item's UTF-8 bytes; a language of one
source has no pairs; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskgrid.llm.common import BATCH_ROWS, frozen, perhaps_broadcast, short_batches

LEAST_DOCS = 30
RANKS = 50
#: Terms of a block, on average; seats that a language's groups are dealt into, and groups of a seat at most.
BLOCK, SEATS, SEAT_GROUPS = 4096, 8, 256
#: Parts of a share, and what every count is raised by.
PARTS, RAISED = 1_000_000_000, 5
#: Terms that a task counts before it hands them on (some 100 bytes each).
HELD = 400_000


_TERM = re.compile(rb"[a-z\x80-\xff]+")
COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, in order, as UTF-8: ``lower`` of bytes folds A-Z only, and no character is cut, since all bytes of the others are in a term."""
    return _TERM.findall((text or "").encode("utf-8", "replace").lower())


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term by group, summed over a task's rows as long as they fit in ``HELD`` entries."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = list(n)
            for a in range(0, max(1, len(names)), BATCH_ROWS):
                own = names[a : a + BATCH_ROWS] or [None]
                columns = [[lang] * len(own), [source] * len(own), pa.array(own, pa.binary()).cast(pa.string()), [n[t] for t in own], [docs[t] for t in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema, strict=True)], schema=schema)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            own = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            found = Counter(terms(text))
            own[0].update(found)
            own[1].update(found.keys())
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from told()
    yield from told()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a group without terms has one row of a null term."""
    schema = to_arrow_schema(StructType.fromDDL(COUNTED))
    parts = docs.select("lang", "source", "text").mapInArrow(lambda batches: _counted(batches, schema), COUNTED)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """A sparse vector of ascending positions and counts: gaps and counts as bytes of seven bits."""
    values = np.stack([np.diff(at, prepend=-1) - 1, n], axis=1).ravel().astype(np.uint64)
    size = np.maximum(1, -(-np.frexp(values.astype(np.float64))[1] // 7))
    size += values >> (7 * size.astype(np.uint64)) > 0  # a float may round the last bit away
    end = np.cumsum(size)
    k = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
    out = (np.repeat(values, size) >> (7 * k).astype(np.uint64)).astype(np.uint8) & 127
    out[k < np.repeat(size, size) - 1] |= 128
    return out.tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(packed, np.uint8)
    last = np.flatnonzero(raw < 128)
    begin = np.r_[0, last[:-1] + 1][: len(last)]
    k = np.arange(len(raw)) - np.repeat(begin, last - begin + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * k).astype(np.uint64)
    values = np.add.reduceat(parts, begin).astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    return np.cumsum(values[::2] + 1) - 1, values[1::2]


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(PARTS * n / total) for 0 <= n <= total < 2**53, exactly: three digits of the division at a time, so nothing exceeds 64 bits."""
    out, rest = np.divmod(np.asarray(n, np.int64), total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def dense(packed: bytes, n_terms: int, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of all ``size`` terms of a block, and counts."""
    at, n = unpack(packed)
    counts = np.zeros(size, np.int64)
    counts[at] = n
    return shares(counts + RAISED, total + RAISED * n_terms), counts


@dataclass
class Seat:
    """A task's residents for one (lang, block, seat), with their dense shares."""

    key: tuple
    size: int = 0
    names: list = field(default_factory=list)
    share: list = field(default_factory=list)
    counts: list = field(default_factory=list)

    def settle(self, row: dict) -> Iterator[tuple]:
        """A resident comes in and meets those of its seat that came before."""
        p, n = dense(row["packed"], row["n_terms"], row["total"], row["size"])
        yield from self.meet(row["source"], p)
        self.names.append(row["source"])
        self.share.append(p)
        self.counts.append(n)

    def meet(self, name: str, q: np.ndarray) -> Iterator[tuple]:
        """Both directions of every resident's meeting with a visitor."""
        if self.share:
            apart = np.abs(np.stack(self.share) - q).sum(axis=1)
            for own, value in zip(self.names, apart.tolist(), strict=True):
                yield own, name, None, value
                yield name, own, None, value

    def heaps(self, q: np.ndarray, ranks: int) -> Iterator[tuple]:
        """The best terms of each resident against the language, positions in the order of their bytes."""
        for own, p, n in zip(self.names, self.share, self.counts, strict=True):
            at = np.flatnonzero((n > 0) & (p > q))
            for less, k in heapq.nsmallest(ranks, zip((q[at] - p[at]).tolist(), at.tolist(), strict=True)):
                yield own, None, k, -less


FOUND = "lang string, block int, source string, peer string, pos int, value bigint"


def _rotated(batches: Iterator[pa.RecordBatch], ranks: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by (lang, block, seat, round): residents, the language's vector, then visitors by their round."""
    seat = Seat(())
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            key = row["lang"], row["block"], row["seat"]
            if seat.key != key:
                seat = Seat(key)
            if row["round"] == 0 and row["source"] is not None:
                found = seat.settle(row)
            else:
                q, _ = dense(row["packed"], row["n_terms"], row["total"], row["size"])
                found = seat.heaps(q, ranks) if row["source"] is None else seat.meet(row["source"], q)
            out.extend((key[0], key[1], *x) for x in found)
        yield pa.RecordBatch.from_pydict({c: [x[k] for x in out] for k, c in enumerate(schema.names)}, schema=schema)


def seats(groups: DataFrame, n_seats: int, most: int) -> DataFrame:
    """(lang, source, seat, n_seats): the groups of a language dealt in order into seats, as many as ``n_seats`` or as ``most`` groups a seat ask for."""
    w = Window.partitionBy("lang")
    n = F.count("*").over(w)
    many = F.least(n, F.greatest(F.lit(n_seats), F.ceil(n / most))).cast("int")
    order = (F.row_number().over(w.orderBy("source")) - 1).cast("long")
    return groups.withColumns({"n_seats": many, "__rg_k": order}).withColumn("seat", F.pmod("__rg_k", F.col("n_seats")).cast("int")).drop("__rg_k")


def visits(seat: Column, n_seats: Column) -> Column:
    """Array of (round, seat) where a seat travels to: of the two that meet in a round, the smaller stays in odd rounds, the larger in even ones.

    Circle method over n seats (one more that is empty if their number is
    odd): in round r, of n - 1, seats i and j < n - 1 meet if i + j leaves r
    modulo n - 1, and who would meet itself meets seat n - 1.
    """
    n = n_seats + n_seats % 2
    last = n - 1

    def met(r: Column) -> Column:
        # the last seat meets the one that is half of r modulo the odd n - 1
        half = F.pmod(r * F.shiftright(n, 1), last)
        peer = F.pmod(r - seat, last)
        return F.when(seat == last, half).when(peer == seat, last).otherwise(peer).cast("int")

    every = F.when(n_seats > 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    games = F.transform(every, lambda r: F.struct(r.alias("round"), met(r).alias("seat")))
    return F.filter(games, lambda g: (g["seat"] < n_seats) & ((g["seat"] < seat) == (g["round"] % 2 == 1)))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, block: int = BLOCK, n_seats: int = SEATS, most: int = SEAT_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group its distance to each other source of its language, and its own terms."""
    spark = docs.sparkSession
    short_batches(spark)
    counts = frozen(term_counts(docs), "divergence-counts")
    groups = counts.select("lang", "source").distinct()
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = frozen(kept, "divergence-kept")
    per_lang = frozen(kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n").alias("total")), "divergence-langs")
    # a block holds about as many terms as asked for; a term's position in it is its rank by bytes
    blocks = F.ceil(F.col("n_terms") / block)
    placed = kept.join(perhaps_broadcast(per_lang), "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int"))
    w = Window.partitionBy("lang", "block")
    placed = placed.withColumns({"pos": (F.row_number().over(w.orderBy("term")) - 1).cast("int"), "size": F.count("*").over(w).cast("int")})
    placed = frozen(placed, "divergence-terms")

    @F.pandas_udf("binary")
    def packed(at: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pack(a.astype(np.int64), b.astype(np.int64)) for a, b in zip(at, n, strict=True)])

    vector = F.sort_array(F.collect_list(F.struct("pos", "n")))
    here = placed.select("lang", "term", "block", "pos")
    own = counts.where("n > 0").join(here, ["lang", "term"]).groupBy("lang", "source", "block").agg(vector.alias("x"), F.sum("n").alias("n"))
    own = frozen(own.select("lang", "source", "block", packed("x.pos", "x.n").alias("packed"), "n"), "divergence-vectors")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seated = seats(groups.join(per_lang.select("lang", "n_terms"), "lang", "left"), n_seats, most).join(totals, ["lang", "source"], "left")
    seated = frozen(seated.select("lang", "source", "seat", "n_seats", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("total", F.lit(0)).alias("total")), "divergence-seats")
    sizes = placed.groupBy("lang", "block").agg(F.first("size").alias("size"), F.first("n_terms").alias("n_terms"), F.first("total").alias("total"), vector.alias("x"))
    sizes = frozen(sizes.select("lang", "block", "size", "n_terms", "total", packed("x.pos", "x.n").alias("packed")), "divergence-blocks")
    # every group has a vector in every block of its language, if an empty one
    whole = seated.join(perhaps_broadcast(sizes.select("lang", "block", "size")), "lang").join(own.drop("n"), ["lang", "source", "block"], "left").withColumn("packed", F.coalesce("packed", F.lit(b"")))
    columns = ["lang", "block", "seat", "round", "source", "n_terms", "total", "size", "packed"]
    at_home = F.array(F.struct(F.lit(0).alias("round"), F.col("seat").alias("seat")))
    dealt = whole.withColumn("game", F.explode(F.concat(at_home, visits(F.col("seat"), F.col("n_seats"))))).withColumns({"round": F.col("game.round"), "seat": F.col("game.seat")}).select(columns)
    language = sizes.join(perhaps_broadcast(seated.select("lang", "seat").distinct()), "lang").withColumns({"round": F.lit(0), "source": F.lit(None).cast("string")}).select(columns)
    order = F.when(F.col("round") > 0, F.col("round") + 1).when(F.col("source").isNull(), 1).otherwise(0)
    met = dealt.unionByName(language).repartition("lang", "block", "seat").sortWithinPartitions("lang", "block", "seat", order, "source")
    schema = to_arrow_schema(StructType.fromDDL(FOUND))
    found = frozen(met.mapInArrow(lambda batches: _rotated(batches, ranks, schema), FOUND), "divergence-found")
    pairs = found.where("peer is not null").groupBy("lang", "source", F.col("peer").alias("item")).agg(F.sum("value").alias("value"))
    alone = seated.where("n_terms = 0").select("lang", "source")
    pairs = pairs.unionByName(alone.join(alone.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long")))
    named = found.where("pos is not null").join(placed.select("lang", "block", "pos", F.col("term").alias("item")), ["lang", "block", "pos"]).select("lang", "source", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", rank)
    named = named.withColumn("rank", rank).where(F.col("rank") <= ranks)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(named.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


#: The same rows in DuckDB; HUGEINT divisions are exact.
SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
e AS (SELECT g.lang, g.source, term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total, sum(n) OVER (PARTITION BY lang, term)::HUGEINT AS ln, sum(n) OVER (PARTITION BY lang)::HUGEINT AS ltotal FROM e),
p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (ln + 5) // (ltotal + 5 * v))::BIGINT AS q FROM t JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""
