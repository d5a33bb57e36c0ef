"""Near copies of whole texts: SimHash tries find them, their shingles settle it.

A text is the set of its shingles of ``SHINGLE`` words (ASCII case folded).
Equal sets collapse first. Of every other set a fingerprint of ``TRIES`` words
of 64 bits is taken, a bit being set where more than half of the set's hashes
have it. Two sets of Jaccard similarity 0.8 differ in 15 % of the bits, so one
budget over a whole word would have to be so wide that no trie prunes: each
word has a trie of its own, joined with itself under a budget that is narrow
for the first ``NARROW`` bits (``BUDGETS``). A pair at 0.8 passes one of them
with probability 0.26, one of all with 0.99; unlike pairs do with 2e-8.

A pair found is a link if its sets' similarity is ``SIMILARITY`` or more,
counted on 32-bit hashes of the shingles; pairs that differ in more than
``FAR`` of all 1024 bits are not counted (a pair at 0.8 does with probability
0.02, one at 0.83 with 0.001). Links are sought in three rounds, so that a
group of near copies costs in proportion to its size: first only the words are
joined, and keys that meet none are done. Then, of the others, near pairs
that would make one of all parts that meet are checked; at last all pairs that
meet and are still apart, each in the first trie that has it. Only this one
leaves nothing out; the second spares it the inside of groups. What is left
are the pairs of a group whose members are close to ``SIMILARITY``, but below.

Defined cases: a null or empty text, or one of white space only, has the empty
set, and these are copies of each other; fewer words than a shingle make one
shingle; repeated rows are copies; very long texts are taken whole; a null id
never names a component, and a component of null ids only has a null id; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Tuple  # noqa: UP035

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import Columns, by_rows, frozen, semi_by_id
from riskgrid.llm.components import components
from riskgrid.llm.simhash import Forest, binding, dealt, node_pairs, sides

SHINGLE = 5
SIMILARITY = 0.8
TRIES = 16
NARROW = 24
#: Differing bits by depth: 2 in the first 24, then one more every four bits.
BUDGETS = tuple(2 if d <= NARROW else 2 + (d - NARROW) // 4 for d in range(65))
#: Words that share a task, and the depth at which tries are cut at most.
LEAVES, BITS = 1 << 17, 10
#: Differing bits of all words of a pair at most: the mean at SIMILARITY and two standard errors.
FAR = 178

_ODD = np.random.default_rng(20).integers(0, 2**63, TRIES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(min(size, len(words)))), strict=False))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams)), ">u8").astype(np.uint64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """TRIES words of 64 bits of a set of hashes."""
    ones = np.zeros(64 * TRIES, np.int64)
    for a in range(0, len(own), 1 << 11):
        mixed = own[a : a + (1 << 11), None] * _ODD
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(own)).view(">u8").astype(np.uint64)


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the set), words of the fingerprint, and the set in 32-bit hashes."""

    def make():
        def work(rows: Columns) -> Iterator[dict]:
            sets = [shingles(t) for t in rows["text"]]
            yield {
                "doc_id": rows["doc_id"],
                "key": [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in sets],
                "words": [fingerprint(s).view(np.int64) for s in sets],
                "hashes": [np.unique(s.astype(np.uint32)).view(np.int32) for s in sets],
            }

        return work

    return by_rows(docs.select("doc_id", "text"), make, "doc_id bigint, key bigint, words array<bigint>, hashes array<int>")


def _same(pdf: pd.DataFrame) -> Forest:
    """Rows of one root as linked already."""
    forest = Forest(len(pdf))
    root = pdf["root"].to_numpy()
    order = np.argsort(root, kind="stable")
    equal = root[order][1:] == root[order][:-1]
    forest.link(order[:-1][equal], order[1:][equal])
    return forest


def spanning(forest: Forest, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) those by which every part reaches a nearest other one, in turns until all are one; they are linked. No more than a few for each part, however many pairs."""
    order = np.argsort(far, kind="stable")
    i, j = i[order], j[order]
    out = [(i[:0], j[:0])]
    while True:
        a, b = forest.label[i], forest.label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        _, first = np.unique(np.concatenate([a, b]), return_index=True)
        taken = np.unique(first % len(a))
        out.append((i[taken], j[taken]))
        forest.link(i[taken], j[taken])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _meets(differ: np.ndarray) -> np.ndarray:
    """Which rows of differing words meet in one of the words' tries."""
    out = np.ones(differ.shape, bool)
    for d in binding(BUDGETS):
        out &= np.bitwise_count(differ >> np.uint64(64 - d)) <= BUDGETS[d]
    return out.any(axis=1)


def _pairs(tries: DataFrame, kind: str) -> DataFrame:
    """Pairs (u, v) of keys that meet in ``tries`` (trie, fp, key, root, and words but for ``stars``) and are not of one root.

    kind: ``stars`` links every key with the smallest position of all that
    meet, directly or not; ``parts`` gives near pairs that join all roots that
    meet, and takes these for one from there; ``all`` gives every pair once.
    """
    spark = tries.sparkSession
    rows, tasks = dealt(tries, BUDGETS, LEAVES, BITS, 1)
    if not tasks:
        return spark.createDataFrame([], "u bigint, v bigint")
    shared = spark.sparkContext.broadcast(tasks)

    def found(key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        depth, error, trie = shared.value[key[0]]
        pdf, cut = sides(batches)
        words, keys = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["key"].to_numpy(np.int64)
        forest = _same(pdf)
        prints = None if kind == "stars" else np.stack(pdf["words"].to_numpy()).view(np.uint64)
        del pdf

        def joined(bounds: tuple[np.ndarray, ...]) -> np.ndarray:
            a, b, p, q = bounds
            run, label = forest.run, forest.label
            return (run[a] == run[b - 1]) & (run[p] == run[q - 1]) & (label[a] == label[p])

        def meeting() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Equal words of a side first, each with the first of them, then the tries' leaves."""
            same = np.r_[True, words[1:] != words[:-1]]
            same[cut if cut < len(words) else 0] = True
            begin, run = np.flatnonzero(same), np.cumsum(same) - 1
            rest = np.flatnonzero(~same)
            if kind != "all":
                yield begin[run[rest]], rest
                yield from node_pairs(words, cut, depth, error, BUDGETS, joined)
                return
            size = np.diff(np.r_[begin, len(words)])
            for k in np.flatnonzero(size > 1):
                own = np.arange(begin[k], begin[k] + size[k])
                for i in own[:-1]:
                    yield np.full(own[-1] - i, i), np.arange(i + 1, own[-1] + 1)
            for i, j in node_pairs(words, cut, depth, error, BUDGETS, joined):
                one = (size[run[i]] == 1) & (size[run[j]] == 1)
                yield i[one], j[one]
                for x, y in zip(i[~one], j[~one], strict=True):
                    for z in range(x, x + size[run[x]]):
                        yield np.full(size[run[y]], z), np.arange(y, y + size[run[y]])

        for i, j in meeting():
            label = forest.label
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if kind == "stars":
                forest.link(i, j)
                continue
            differ = prints[i] ^ prints[j]
            far = np.bitwise_count(differ).sum(axis=1)
            near = far <= FAR
            if kind == "all":
                near &= ~_meets(differ[:, :trie])
            i, j, far = i[near], j[near], far[near]
            if kind == "parts" and len(i):
                i, j = spanning(forest, i, j, far)
            if len(i):
                yield pd.DataFrame({"u": np.minimum(keys[i], keys[j]), "v": np.maximum(keys[i], keys[j])})
        if kind == "stars":
            moved = np.flatnonzero(forest.label != np.arange(len(words)))
            yield pd.DataFrame({"u": keys[moved], "v": keys[forest.label[moved]]})

    words = [] if kind == "stars" else ["words"]
    return rows.select("fp", "key", "root", *words, "side", "task").groupBy("task").applyInPandas(found, "u bigint, v bigint").where("u <> v")


def _similar(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= SIMILARITY * (F.size(a) + F.size(b) - both)


def _checked(pairs: DataFrame, prints: DataFrame, name: str) -> DataFrame:
    """The pairs whose sets are similar enough; only sets of keys that stand in a pair move."""
    pairs = frozen(pairs.distinct(), f"{name}-met")
    found = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key")))
    sets = semi_by_id(prints.select("key", "hashes"), found, "key").groupBy("key").agg(F.first("hashes").alias("hashes"))
    for side in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("hashes").alias(f"of_{side}")), side)
    return frozen(pairs.where(_similar("of_u", "of_v")).select("u", "v"), name)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest id reachable) of every row."""
    prints = frozen(_prints(docs), "near-prints")
    distinct = frozen(prints.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("words").alias("words")), "near-distinct")

    def tries(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("key", "root", *more, F.posexplode("words").alias("trie", "fp"))

    alone = distinct.select("key", F.col("key").alias("root"), "words")
    met = frozen(_pairs(tries(alone), "stars"), "near-stars")
    keys = met.select(F.col("u").alias("key")).unionByName(met.select(F.col("v").alias("key")))
    some = frozen(semi_by_id(alone, keys, "key"), "near-some")
    links = _checked(_pairs(tries(some, "words"), "parts"), prints, "near-parts")
    roots = components(links, "near-parts-roots").select(F.col("node").alias("key"), F.col("root").alias("found"))
    rooted = some.join(roots, "key", "left").withColumn("root", F.coalesce("found", "root"))
    links = links.unionByName(_checked(_pairs(tries(rooted, "words"), "all"), prints, "near-all"))
    roots = components(links, "near-components")
    named = distinct.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("key", "component_id")
    return prints.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")
