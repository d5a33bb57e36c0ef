"""Benchmark decontamination by spaced seeds.

Every window of ``SPAN`` words of a benchmark item is hashed under a few fixed
masks, each of which looks at eight of the positions and ignores the others; so a window with replaced words still meets its copy under a mask that
skips them. The windows of all documents are hashed alike and joined with the
item windows. Items of ``SPAN`` to ``SHORT`` words have few such windows, so
runs of four words (three in items of 15) are seeds too: whatever fifth of the
words is replaced, such a run is left. A hit fixes which item word stands at
which document word, a diagonal; its overlap is the longest span on it that is
alike enough (``MIN_SHARE``), cut back to equal words at both ends, and it
counts if it is long enough (``MIN_WORDS``). An item that stands there whole
counts whole. Of all overlaps of a text and an item the best is given.

The items are a stated query set: their seeds travel to the executors in
blocks of at most ``BLOCK_WORDS`` words (about 90 MB with four masks), one
pass over the documents for each block, so neither side is shuffled and no
task or driver holds more than a block. Each document is matched whole.

Defined cases: a null or empty text has no window and no overlap; a null or
empty item matches nothing; an item with a null id is matched as any other and
reported with a null item_id; an item shorter than a window matches where all
its words stand in a row; words that repeat in an item or a text are matched
as any others; very long texts are matched whole; repeated rows are matched
each time; ids of any size stay exact; an empty benchmark leaves every
document clean. Columns besides doc_id and text
(documents), item_id and text (items) are never read, and may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import Columns, by_rows, short_batches
from riskgrid.llm.tokens import batch_hashes, groups_of

#: 1: the position counts; 0: any word may stand there.
MASKS = ("110110110111", "111010011011", "101101111001", "111111110000")
SPAN = 12
#: An overlap has at least as many words, or the whole item if that is shorter.
MIN_WORDS = 13
#: Share of equal words in an overlap.
MIN_SHARE = 0.8
#: Items of up to so many words have runs of words as further seeds.
SHORT = 30
BLOCK_WORDS = 1_000_000
#: Hits that are made at a time.
HITS = 1 << 20

SCHEMA = "doc_id bigint, item_id bigint, doc_start int, doc_end int, item_start int, n_equal int, share double"


def window_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k, used in enumerate(mask):
            if used == "1":
                out += words[k : k + n] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 % 2**64 | 1)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
    return out


class Seeds:
    """The seed index of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.words, self.first = batch_hashes([t for _, t in items])
        lengths = np.diff(self.first)
        self.masks = [*MASKS, *("1" * int(n) for n in sorted(set(lengths.tolist())) if 0 < n < SPAN)]
        self.tables = []
        every = [(mask, lengths >= SPAN if len(mask) == SPAN else lengths == len(mask)) for mask in self.masks]
        short = (lengths >= SPAN) & (lengths <= SHORT)
        every += [("1111", short), ("111", short & (lengths == 15))]
        item = np.repeat(np.arange(len(lengths)), lengths)
        for mask, meant in every:
            n = len(mask)
            h = window_hashes(self.words, mask)
            at = np.arange(len(h))
            own = item[at] == item[at + n - 1] if len(h) else np.zeros(0, bool)
            own &= meant[item[at]]
            h, at = h[own], at[own]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            filled = np.zeros(1 << 20, bool)
            filled[h >> np.uint64(44)] = True
            self.tables.append((mask, h, at, filled))
        self.item = item

    def diagonals(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shift, item word) of the distinct diagonals on which windows agree: shift is the document's word less the item's, item word the first word of the item.

        Repeated words make as many hits as windows times windows, but no more
        diagonals than windows; so hits are made ``HITS`` at a time and only
        their diagonals are kept.
        """
        out = np.zeros(0, np.int64)
        width = len(self.words) + 1
        for mask, h, at, filled in self.tables:
            own = window_hashes(words, mask)
            found = np.flatnonzero(filled[own >> np.uint64(44)])
            lo, n = np.searchsorted(h, own[found], "left"), np.searchsorted(h, own[found], "right")
            n -= lo
            found, lo, n = found[n > 0], lo[n > 0], n[n > 0]
            begin = 0
            total = np.cumsum(n)
            while begin < len(found):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS, "right")))
                m = n[begin:end]
                doc = np.repeat(found[begin:end], m)
                q = at[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[begin:end], m)]
                out = np.union1d(out, (doc - q + len(self.words)) * width + self.first[self.item[q]])
                begin = end
        return out // width - len(self.words), out % width


def longest(equal: np.ndarray) -> tuple[int, int]:
    """The longest span (end exclusive, the leftmost of equally long ones) of which a share of ``MIN_SHARE`` is equal."""
    total = np.r_[0, np.cumsum(np.where(equal, 1, -4))]  # equal to 0.8 or more: the sum is not negative
    after = np.maximum.accumulate(total[::-1])  # best sum at an end so far right or farther
    ends = len(equal) - np.searchsorted(after, total, "left")
    s = int((ends - np.arange(len(total))).argmax())
    return s, int(ends[s])


def overlaps(seeds: Seeds, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, first word, word after the last, first item word, equal words) of the best overlap of every text and item that have one.

    The best has most equal words, then fewest others, then starts first.
    """
    words, first = batch_hashes(texts)
    shift, begin = seeds.diagonals(words)
    if not len(shift):
        return
    best: dict[tuple[int, int], tuple] = {}
    item = np.searchsorted(seeds.first, begin, "right") - 1
    # a diagonal runs through every text that the item reaches on it
    low, high = shift + begin, shift + seeds.first[item + 1]
    from_, to = np.searchsorted(first, np.maximum(low, 0), "right") - 1, np.searchsorted(first, np.minimum(high, len(words)), "left")
    for k, move, t0, t1 in zip(item.tolist(), shift.tolist(), from_.tolist(), to.tolist(), strict=True):
        start, end = int(seeds.first[k]), int(seeds.first[k + 1])
        n_item = end - start
        for t in range(t0, t1):
            lo, hi = max(int(first[t]), start + move), min(int(first[t + 1]), end + move)
            if hi <= lo:
                continue
            equal = words[lo:hi] == seeds.words[lo - move : hi - move]
            n_equal = int(equal.sum())
            if n_equal < MIN_SHARE * min(MIN_WORDS, n_item) or n_equal <= best.get((t, k), (0,))[0] - 1:
                continue
            s, e = (0, hi - lo) if hi - lo == n_item and n_equal >= MIN_SHARE * n_item else longest(equal)
            inner = np.flatnonzero(equal[s:e])
            if not len(inner):
                continue
            if inner[-1] + 1 - inner[0] >= min(MIN_WORDS, n_item) or e - s < n_item:
                s, e = s + int(inner[0]), s + int(inner[-1]) + 1
            if e - s < min(MIN_WORDS, n_item):
                continue
            found = (int(equal[s:e].sum()), s - e, -(s + lo), e + lo, s + lo - move - start)
            best[t, k] = max(found, best.get((t, k), found))
    for (t, k), (n_equal, _, s, e, at) in sorted(best.items()):
        yield t, k, -s - int(first[t]), e - int(first[t]), at, n_equal


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks, streamed to the driver one partition at a time."""
    now, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        n = len((r.text or "").split())
        if now and size + n > block_words:
            yield now
            now, size = [], 0
        now.append((r.item_id, r.text))
        size += n
    if now:
        yield now


def contaminated(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document row and item that overlap, with their best overlap; positions count words from 0, ends are exclusive."""
    spark = docs.sparkSession
    out = None
    for block in blocks(items, block_words):
        shared = spark.sparkContext.broadcast(Seeds(block))

        def make(shared=shared):
            seeds = shared.value

            def match(rows: Columns) -> Iterator[dict]:
                ids, texts = rows["doc_id"], rows["text"]
                found = [(ids[a + t], seeds.ids[k], s, e, i, n, n / (e - s)) for a, b in groups_of(texts) for t, k, s, e, i, n in overlaps(seeds, texts[a:b])]
                yield dict(zip((x.split()[0] for x in SCHEMA.split(", ")), zip(*found, strict=True), strict=True)) if found else {x.split()[0]: [] for x in SCHEMA.split(", ")}

            return match

        part = by_rows(docs.select("doc_id", "text"), make, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows without any overlap, columns as they are; decided row by row, so nothing is shuffled."""
    spark = docs.sparkSession
    short_batches(spark)
    for block in blocks(items, block_words):
        docs = docs.where(_clean(spark.sparkContext.broadcast(Seeds(block)))("text"))
    return docs


def _clean(shared: Broadcast):
    """A boolean function of a text column: no overlap with an item of the block."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeds = shared.value
        for column in batches:
            texts = column.tolist()
            keep = np.ones(len(texts), bool)
            for a, b in groups_of(texts):
                for found in overlaps(seeds, texts[a:b]):
                    keep[a + found[0]] = False
            yield pd.Series(keep)

    return clean
