"""Quality rules: hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Words and word pairs of every text are hashed to ``BUCKETS`` buckets (a pair by
the 64-bit hashes of its words). Two
multinomials over the buckets are counted: one over all texts, one over the
trusted ones. Equal texts count once in both, however many copies there are,
and a text is trusted if any copy is, so copies cannot move the ratio. A
text's score is the mean, over its n-grams, of the log of the
ratio of the two (add-one smoothed); a text is rejected if that mean is below
``THRESHOLD``, or if a base rule fails. Log ratios are whole micro-units, so a
score is a sum of integers and does not depend on order or partitioning.

DataFrame functions only. Counting shuffles the 64-bit hash of every text, then
one row for each bucket and task; scoring needs no shuffle: the ratios are one
literal array of ``BUCKETS`` integers in the plan. Texts move nowhere unless
trusted ids or hashes of copied texts are too many to broadcast.

Defined cases: a null text counts as empty; a text without words has no
n-grams, score 0 and fails the base rule; repeated rows count once and are
scored each time; texts, and windows of words, whose 64-bit hashes agree count as copies; with no trusted row (or an empty table) all ratios are 0, so the
method rejects nothing. Columns besides doc_id and text are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import frozen, perhaps_broadcast

BUCKETS = 10_000
#: Mean log ratio for each n-gram below which a text goes.
THRESHOLD = -0.05
MICRO = 1_000_000
UNIT = 1 << 31
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D, in order."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _hashes(words: str) -> str:
    """SQL: the 64-bit hash of every word; pairs and windows of words are hashed by those of their words."""
    return f"transform({words}, w -> xxhash64(w))"


def _pair(h: str, i: str) -> str:
    """SQL: bucket of the pair of words that ends at place ``i``."""
    return f"cast(pmod(xxhash64({h}[{i} - 1], {h}[{i}]), {BUCKETS}) as int)"


def _grams(h: str) -> str:
    """SQL: buckets of all words and neighbouring word pairs, from the words' hashes."""
    return f"""concat(transform({h}, x -> cast(pmod(x, {BUCKETS}) as int)),
        if(size({h}) < 2, cast(array() as array<int>), transform(sequence(1, size({h}) - 1), i -> {_pair(h, "i")})))"""


def fit(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Log ratios of all buckets in micro-units; ``trusted`` has the doc_id of trusted rows.

    Ids, and hashes of texts with copies, are broadcast if a count finds them
    few enough, else both sides are joined by a shuffle. Each of a text's n
    copies counts 1 / n, in units of 1 / ``UNIT``: rounding the sum gives back
    the whole number as long as a bucket has fewer than ``UNIT`` n-grams in
    copies.
    """
    ids = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("__rg_t", F.lit(1))
    flagged = docs.select("doc_id", "text").join(perhaps_broadcast(ids), "doc_id", "left")
    flagged = flagged.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("__rg_t", F.lit(0)).alias("t"), "text")
    copied = frozen(flagged.groupBy("h").agg(F.count("*").alias("n"), F.max("t").alias("any_t")).where("n > 1"), "quality-copies")
    once = flagged.join(perhaps_broadcast(copied, 48), "h", "left")
    share = F.when(F.col("n").isNull(), F.lit(UNIT)).otherwise(F.round(UNIT / F.col("n"))).cast("long")
    grams = once.select(share.alias("s"), F.coalesce("any_t", "t").alias("t"), words_of(F.col("text")).alias("w")).select("s", "t", F.expr(_hashes("w")).alias("h")).select("s", "t", F.explode(F.expr(_grams("h"))).alias("g"))
    counts = grams.groupBy("g").agg(F.sum("s").alias("raw"), F.sum(F.col("s") * F.col("t")).alias("target")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.g], target[r.g] = (r.raw + UNIT // 2) // UNIT, (r.target + UNIT // 2) // UNIT
    if not sum(target):
        return [0] * BUCKETS
    of_raw, of_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return [round(MICRO * (math.log((t + 1) / of_target) - math.log((r + 1) / of_raw))) for r, t in zip(raw, target, strict=True)]


def judged(docs: DataFrame, ratios: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs``, with one struct column ``__rg_q`` of the rules' figures."""
    n_grams = "greatest(0, 2 * size(__rg_w) - 1)"
    step = docs.withColumn("__rg_w", words_of(F.col("text")))
    step = step.withColumn("__rg_r", F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>"))
    step = step.withColumn("__rg_x", F.expr(_hashes("__rg_w")))
    # 64-bit hashes of the three-word windows
    step = step.withColumn("__rg_h", F.expr("if(size(__rg_x) < 3, cast(array() as array<bigint>), transform(sequence(2, size(__rg_x) - 1), i -> xxhash64(__rg_x[i - 2], __rg_x[i - 1], __rg_x[i])))"))
    # equal windows become neighbours, each with its place
    step = step.withColumn("__rg_s", F.expr("if(size(array_distinct(__rg_h)) = size(__rg_h), null, sort_array(transform(__rg_h, (h, i) -> struct(h, i))))"))
    step = step.withColumn("__rg_p", F.expr("""array_sort(transform(filter(sequence(0, size(__rg_s) - 1), j ->
        (j > 0 and __rg_s[greatest(j - 1, 0)].h = __rg_s[j].h) or (j < size(__rg_s) - 1 and __rg_s[least(j + 1, size(__rg_s) - 1)].h = __rg_s[j].h)), j -> __rg_s[j].i))"""))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    step = step.withColumn("__rg_l", lines)
    step = step.withColumn(
        "__rg_q",
        F.struct(
            F.size("__rg_w").cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("__rg_l") - F.size(F.array_distinct("__rg_l"))).cast("long").alias("n_dup_lines"),
            # each repeated window adds its words that the one before did not cover
            F.expr("if(__rg_s is null, 0L, aggregate(__rg_p, struct(-3 as at, 0L as n), (a, p) -> struct(p as at, a.n + least(3, p - a.at) as n), a -> a.n))").alias("n_repeat_words"),
            F.expr(n_grams).cast("long").alias("n_grams"),
            F.expr(f"aggregate(__rg_x, 0L, (a, x) -> a + __rg_r[cast(pmod(x, {BUCKETS}) as int)]) + if(size(__rg_x) < 2, 0L, aggregate(sequence(1, size(__rg_x) - 1), 0L, (a, i) -> a + __rg_r[{_pair('__rg_x', 'i')}]))").alias("ratio_micro"),
        ),
    ).drop("__rg_w", "__rg_x", "__rg_r", "__rg_h", "__rg_s", "__rg_p", "__rg_l")
    q = F.col("__rg_q")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    low = q["ratio_micro"] < F.lit(round(threshold * MICRO)) * q["n_grams"]
    # a caller's filter is not pushed below a generator; pushed to the scan, it
    # would repeat every step above inside the next one
    return step.withColumn("__rg_q", F.explode(F.array(q.withField("base_failed", failed).withField("kept", ~failed & ~low))))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Figures and verdict of every row: doc_id, the base figures, base_failed, kept, score."""
    out = judged(docs.select("doc_id", "text"), fit(docs, trusted), threshold)
    q = F.col("__rg_q")
    return out.select(
        "doc_id",
        *(q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
        F.when(q["n_grams"] > 0, q["ratio_micro"] / (q["n_grams"] * MICRO)).otherwise(0.0).alias("score"),
    )


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that all rules keep, columns as they are."""
    return judged(docs, fit(docs, trusted), threshold).where("__rg_q.kept").drop("__rg_q")
