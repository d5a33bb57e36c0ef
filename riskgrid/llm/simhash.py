"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has a bit set where more than half of its shingle hashes
have it. Equal fingerprints collapse first. The distinct ones are the leaves
of a binary trie, and the trie is joined with itself: pairs of nodes are
followed down together, each step adds one to the pair's error where the bits
differ, and a pair is dropped once its error exceeds the budget. The top of
the trie is walked on the driver over node counts only (at most a few thousand
nodes); every pair of subtrees that survives becomes one task. Inside a task
links are merged into components at once: a pair of subtrees whose leaves are
all in one component already is not followed, so a group of copies costs no
more than its size, and at most one link for each leaf leaves the task. The
links are joined to components over all tasks by star operations.

A subtree holds at most about ``LEAVES`` fingerprints; where more share the
first ``TOP_BITS`` bits they are cut into parts that are joined with each
other. With ever more fingerprints a subtree grows so that the top stays small.

Defined cases: a null or empty text, or one of white space only, has
fingerprint zero and is linked as any other; fewer words than a shingle make
one shingle; repeated rows link with each other; a null id never names a
component, and a component of null ids only has a null id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from typing import Any, Tuple  # noqa: UP035

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import frozen, perhaps_broadcast, short_batches
from riskgrid.llm.components import components

SHINGLE = 3
BUDGET = 3
LEAVES = 1 << 16
#: Depth at which subtrees become tasks at least, and at most.
MIN_BITS, TOP_BITS = 2, 16
#: Node pairs that are followed at a time.
CHUNK = 1 << 14
#: Most differing bits of a pair of nodes, by their depth 0 to 64.
Budgets = tuple[int, ...]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_digest
    for a in range(0, n, 1 << 16):
        part = words[a : a + (1 << 16) + shingle - 1]
        grams = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        raw = np.frombuffer(b"".join([hashed(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_column(text: str = "text", shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(F.col(text))


def top_pairs(counts: dict[int, int], budgets: Budgets, leaves: int, bits: int = TOP_BITS, least_bits: int = MIN_BITS) -> list[tuple[int, int, int, int, int]]:
    """(prefix a, depth a, prefix b, depth b, error) of the subtrees to join; ``counts`` by the first ``bits`` bits."""
    levels = [counts]
    for _ in range(bits):
        up: dict[int, int] = {}
        for k, n in levels[-1].items():
            up[k >> 1] = up.get(k >> 1, 0) + n
        levels.append(up)
    levels.reverse()  # levels[d]: node counts at depth d

    def split(p: int, d: int) -> list[tuple[int, int]]:
        """The node, or its children if it is too large."""
        if d < bits and (d < least_bits or levels[d][p] > leaves):
            return [(q, d + 1) for q in (2 * p, 2 * p + 1) if q in levels[d + 1]]
        return [(p, d)]

    out, stack = [], [(0, 0, 0, 0, 0)] if counts else []
    while stack:
        p, dp, q, dq, error = stack.pop()
        a = split(p, dp) if dp <= dq else [(p, dp)]
        b = split(q, dq) if dq <= dp else [(q, dq)]
        if a == [(p, dp)] and b == [(q, dq)]:
            out.append((p, dp, q, dq, error))
            continue
        for i, (x, dx) in enumerate(a):
            for y, dy in b[i:] if p == q and dp == dq else b:
                d = min(dx, dy)
                e = (x >> (dx - d) ^ y >> (dy - d)).bit_count()
                if e <= budgets[d]:
                    stack.append((x, dx, y, dy, e))
    return out


def dealt(rows: DataFrame, budgets: Budgets, leaves: int = LEAVES, bits: int = TOP_BITS, least_bits: int = MIN_BITS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``rows`` (trie, fp, and more) dealt to the tasks of pairs of subtrees of each trie, with ``task`` and ``side`` (0 or 1); and the depth, error and trie of each task.

    Subtrees have about ``leaves`` rows at most. One that has more within the
    first ``bits`` bits is cut into parts by a hash, and the parts are joined
    with each other, so no task grows with a group of like fingerprints. The
    subtrees are a few thousand whatever the input: ``leaves`` grows with it
    beyond that.
    """
    spark = rows.sparkSession
    prefix = F.shiftrightunsigned("fp", 64 - bits)
    counts: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("trie", prefix.alias("p")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.trie, {})[r.p] = r.n
    leaves = max(leaves, sum(sum(c.values()) for c in counts.values()) // 4096)
    tasks: list[tuple[int, int, int]] = []
    where = []
    for trie, own in counts.items():
        of: dict[tuple[int, int], list[list[int]]] = {}  # by subtree and part: task and side in one number

        def parts(p: int, d: int, own=own, of=of) -> list[list[int]]:
            if (p, d) not in of:
                of[p, d] = [[] for _ in range(-(-own[p] // (2 * leaves)) if d == bits else 1)]
            return of[p, d]

        for p, dp, q, dq, error in top_pairs(own, budgets, leaves, bits, least_bits):
            left, right, alone = parts(p, dp), parts(q, dq), (p, dp) == (q, dq)
            for i in range(len(left)):
                for j in range(i if alone else 0, len(right)):
                    left[i].append(2 * len(tasks))
                    if not alone or i != j:
                        right[j].append(2 * len(tasks) + 1)
                    # sides of unequal depth agree only in the shorter prefix
                    tasks.append((min(dp, dq), error, trie))
        where += [(trie, p << (bits - d) | x, ks) for (p, d), ks in of.items() for x in range(1 << (bits - d)) if p << (bits - d) | x in own]
    table = spark.createDataFrame(where, "trie int, prefix bigint, codes array<array<int>>")
    part = F.pmod(F.xxhash64(*rows.columns), F.size("codes")).cast("int")
    met = rows.withColumn("prefix", prefix.cast("bigint")).join(F.broadcast(table), ["trie", "prefix"])
    code = met.select(*rows.columns, F.explode(F.element_at("codes", part + 1)).alias("code"))
    return code.select(*rows.columns, F.shiftright("code", 1).alias("task"), (F.col("code") % 2).cast("tinyint").alias("side")), tasks


def sides(batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, int]:
    """A task's rows with the left side first, each side in the order of its words; and the size of the left side."""
    pdf = pd.concat(list(batches), ignore_index=True)
    right = pdf["side"].to_numpy()
    return pdf.iloc[np.lexsort((pdf["fp"].to_numpy(np.int64).view(np.uint64), right))], int((right == 0).sum())


class Forest:
    """Components over positions 0..n-1, labelled by their smallest position."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.run = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
        self.run = np.cumsum(np.r_[0, label[1:] != label[:-1]])


def binding(budgets: Budgets) -> list[int]:
    """Depths at which a budget tells more than that of the next depth, the deepest first."""
    return [d for d in range(64, 0, -1) if d == 64 or budgets[d] < budgets[d + 1]]


def node_pairs(words: np.ndarray, cut: int, depth: int, error: int, budgets: Budgets, joined: Callable[[tuple[np.ndarray, ...]], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of leaves that meet, in chunks, of the sorted ``words[:cut]`` with the sorted ``words[cut:]``, or of one trie with itself if there are none.

    All words of a side agree in the first ``depth`` bits, in which the sides
    differ ``error`` times; a pair of nodes at depth d is dropped once its
    error is over ``budgets[d]``, and when ``joined`` says so of its four
    bounds. A leaf is one word, or a run of equal ones of which the first stands.
    """
    n = len(words)
    first = [0, cut, cut, n, error] if cut < n else [0, n, 0, n, 0]
    same = np.r_[True, words[1:] != words[:-1]] if n else np.zeros(0, bool)
    if 0 < cut < n:
        same[cut] = True
    begin = np.flatnonzero(same)
    run = np.cumsum(same) - 1  # index of a word's run
    deep = binding(budgets)
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, np.array([first], np.int64))]
    while stack:
        d, pairs = stack.pop()
        if len(pairs) > CHUNK:
            stack.append((d, pairs[CHUNK:]))
            pairs = pairs[:CHUNK]
        pairs = pairs[~joined(tuple(pairs.T[:4]))]
        a, b, p, q, e = pairs.T
        leaf = (run[a] == run[b - 1]) & (run[p] == run[q - 1])
        if leaf.any():
            i, j = begin[run[a[leaf]]], begin[run[p[leaf]]]
            for at in deep:
                near = np.bitwise_count((words[i] ^ words[j]) >> np.uint64(64 - at)) <= budgets[at]
                i, j = i[near], j[near]
            if len(i):
                yield i, j
            a, b, p, q, e = (x[~leaf] for x in (a, b, p, q, e))
        if not len(a):
            continue
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum((words >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)]
        s, t = b - (ones[d][b] - ones[d][a]), q - (ones[d][q] - ones[d][p])
        own = a == p
        parts = [(a, s, p, t, e), (s, b, t, q, e), (a, s, t, q, e + 1), (s, b, p, t, e + 1)]
        new = np.concatenate([np.stack(x, axis=1)[~own] if k == 3 else np.stack(x, axis=1) for k, x in enumerate(parts)])
        new = new[(new[:, 0] < new[:, 1]) & (new[:, 2] < new[:, 3]) & (new[:, 4] <= budgets[d + 1])]
        if len(new):
            stack.append((d + 1, new))


def join_tries(words: np.ndarray, cut: int, depth: int, error: int, budgets: Budgets | int = BUDGET) -> Forest:
    """Components over all pairs within the budget (see ``node_pairs``); a pair of nodes in one component already is not followed."""
    budgets = (budgets,) * 65 if isinstance(budgets, int) else budgets
    forest = Forest(len(words))
    equal = np.flatnonzero(words[1:] == words[:-1])
    if len(equal):
        forest.link(equal, equal + 1)

    def joined(bounds: tuple[np.ndarray, ...]) -> np.ndarray:
        a, b, p, q = bounds
        run, label = forest.run, forest.label
        return (run[a] == run[b - 1]) & (run[p] == run[q - 1]) & (label[a] == label[p])

    for i, j in node_pairs(words, cut, depth, error, budgets, joined):
        forest.link(i, j)
    return forest


def links(distinct: DataFrame, budget: int = BUDGET, leaves: int = LEAVES) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` as all pairs within ``budget`` bits would."""
    spark = distinct.sparkSession
    budgets = (budget,) * 65
    rows, tasks = dealt(distinct.select(F.lit(0).alias("trie"), "fp"), budgets, leaves)
    if not tasks:
        return spark.createDataFrame([], "u bigint, v bigint")
    shared = spark.sparkContext.broadcast(tasks)

    def join(key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf, cut = sides(batches)
        signed = pdf["fp"].to_numpy(np.int64)
        depth, error, _ = shared.value[key[0]]
        label = join_tries(signed.view(np.uint64), cut, depth, error, budgets).label
        moved = np.flatnonzero(label != np.arange(len(signed)))
        yield pd.DataFrame({"u": signed[moved], "v": signed[label[moved]]})

    return rows.select("fp", "side", "task").groupBy("task").applyInPandas(join, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row."""
    short_batches(docs.sparkSession)
    prints = frozen(docs.select("doc_id", fingerprint_column("text", shingle).alias("fp")), "simhash-prints")
    distinct = frozen(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = components(frozen(links(distinct, budget), "simhash-links"), "simhash-components")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, that with the smallest id; columns as they are."""
    return one_of_each(docs, near_duplicates(docs, budget, shingle))


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest id of each component; ``named`` has doc_id and component_id of every row.

    Ids of dropped rows are broadcast if a count finds them few enough, else
    joined by a shuffle. Of rows that repeat an id one stays, the least by its
    JSON text; rows with a null id stay.
    """
    found = frozen(named.where("doc_id is not null"), "simhash-found")
    gone = perhaps_broadcast(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    repeated = perhaps_broadcast(repeated)
    # of rows that repeat an id the least stays, in the order of all columns
    every = F.struct(*docs.columns)
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(every, F.to_json(every)).alias("__rg_row")).select("__rg_row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
