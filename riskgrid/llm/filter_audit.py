"""Interaction of filters: what each would remove after any set of the others.

n filters have n * 2**(n-1) lattice edges (subset already applied, next
filter): 80 for five. Documents are counted once by part and by the set of
filters they fail, each such count contributes to every edge, and edges are
summed by part. An order of the filters is a path through the lattice, so its
steps (600 for five filters) are looked up among the summed edges: no
document is filtered more than once, whatever the number of orders. An edge
lies on |S|! (n - 1 - |S|)! paths, which gives the sum over all orders.

Texts are read in one pass of built-in functions and never move: what is
shuffled is a row of about 60 bytes a document (id, part, failed filters, a
SHA-256 of the text). Copies of a text meet by partial minima on the digest,
and documents find out whether they are the first of their text by a join on
(digest, id), so a text that a third of all rows share is no hot key. Rows
repeated whole are counted before the joins.

Defined cases: a null text is empty and a null part is the empty string; a
text without words fails the word count alone (and, if it has a smaller
copy, as a duplicate); very long texts are read whole; a null id is smaller
or larger than none, so such a row never fails as a duplicate and has no
label; rows with the same id count each, and none is the smaller; an id with
several labels has each that one of them tells; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.llm.common import frozen

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
#: Hundredths: distinct words of all, and capitals of all code points.
LEAST_DISTINCT, MOST_CAPITALS = 65, 5
SYMBOLS = r"[#$%&*|]"
#: The filter that looks for a smaller copy of the whole text.
DUPLICATE = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def rules(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides, by name."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n_words = F.size(words)
    return {
        "A": n_words < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n_words,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> tuple[DataFrame, list[str]]:
    """(part, failed, quality, toxic, n): rows counted by the bits of the filters they fail and by their labels; and the filters' names in the order of their bits."""
    text = F.coalesce("text", F.lit(""))
    own = rules(text)
    bits = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(own.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(part, F.lit("")).alias("part"), bits.cast("int").alias("failed"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = frozen(rows.groupBy("id", "part", "failed", "digest").agg(F.count("*").alias("n")), "audit-rows")
    known = rows.where("id is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("id"))
    said = said.agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("quality"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    joined = known.join(first, ["digest", "id"], "left").join(said, "id", "left")
    again = F.when(F.col("first").isNull(), 1 << len(own)).otherwise(0)
    no = F.lit(False)
    joined = joined.select("part", (F.col("failed") + again).alias("failed"), F.coalesce("quality", no).alias("quality"), F.coalesce("toxic", no).alias("toxic"), "n")
    rest = rows.where("id is null").select("part", "failed", no.alias("quality"), no.alias("toxic"), "n")
    counts = joined.unionByName(rest).groupBy("part", "failed", "quality", "toxic").agg(F.sum("n").alias("n"))
    return counts, [*own, DUPLICATE]


def lattice_edges(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, before, filter, paths, and COUNTS): every edge of every part; ``before`` holds the bits of the filters already applied."""
    every = ((s, f) for f in range(n_filters) for s in range(1 << n_filters) if not s >> f & 1)
    edges = F.expr("array(" + ", ".join(f"named_struct('before', {s}, 'filter', {f}, 'bit', {1 << f}, 'paths', {factorial(s.bit_count()) * factorial(n_filters - 1 - s.bit_count())})" for s, f in every) + ")")
    met = counts.withColumn("edge", F.explode(edges)).select("part", "failed", "quality", "toxic", "n", "edge.*")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("before")) != 0
    gone = fails & ~earlier
    alone = F.col("failed") == F.col("bit")

    def total(of: Column) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(0))

    of = {"kept": ~fails & ~earlier, "removed": gone, "redundant": fails & earlier, "unique_fails": alone, "good_lost": gone & F.col("quality"), "toxic_lost": gone & F.col("toxic")}
    return met.groupBy("part", "before", "filter", "paths").agg(*(total(of[c]).alias(c) for c in COUNTS))


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley): every step of every order of the filters, in every part."""
    edges = lattice_edges(counts, len(names))
    # paths x removed, over the edges of a filter: n * 2**(n-1) rows a part
    edges = edges.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy("part", "filter")))
    steps = [("".join(names[f] for f in order), k + 1, sum(1 << f for f in order[:k]), f) for order in permutations(range(len(names))) for k, f in enumerate(order)]
    # n! * n rows, fixed by the number of filters
    paths = F.broadcast(counts.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int"))
    return edges.join(paths, ["before", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over documents and their labels, for each value of a column."""
    return audit(*failures(docs, labels, part))


#: The same rows in DuckDB.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
m AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(w.doc_id > first_id, false) THEN 16 ELSE 0 END AS failed FROM w JOIN m USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, failed, good, bad, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM k a, k b, k c, k d, k e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own, list_sum([0] || bits[1:step - 1])::INT AS before FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, own, sum(n) FILTER (failed & (own | before) = 0) AS kept, sum(n) FILTER (failed & own <> 0 AND failed & before = 0) AS removed,
    sum(n) FILTER (failed & own <> 0 AND failed & before <> 0) AS redundant, sum(n) FILTER (failed = own) AS unique_fails,
    sum(n) FILTER (good AND failed & own <> 0 AND failed & before = 0) AS good_lost, sum(n) FILTER (bad AND failed & own <> 0 AND failed & before = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM x"""
