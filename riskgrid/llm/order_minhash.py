"""Order MinHash fingerprints of whole texts, sensitive to edit distance.

A text is the sequence of its k-mers of ``K`` code points, each numbered by
how often it stood before (its occurrence), so repeats count. For each of
``SKETCHES`` hash functions the ``TUPLE`` numbered k-mers of least hash are
taken, put back in the order of the text, and hashed as a tuple: two texts
agree there only if they share the k-mers, as often, and in the same order.
The likeness of two fingerprints is the share of functions in which they
agree.

Hash functions are odd multiples (modulo 2**32) of one mixed hash of k-mer and
occurrence, evaluated for a whole text at once in numpy.

``edited`` also fingerprints every document after its last quarter gave way to
the beginning of the next one. Documents are dealt once by ranges of (id,
hash of the text) and sorted; a task streams its range and holds two texts.
A range's first and last rows are written beside its results, and the last row
of each range meets the first one of the next by a join on the ranges'
numbers: two texts a task, not a table.

Defined cases: a null text is empty; an empty text has the fingerprint of
zeros; a text shorter than a k-mer is one k-mer, and fewer k-mers than a tuple
make a shorter tuple; very long texts are taken whole, a few functions at a
time; equal texts have equal fingerprints; null ids come first, rows of one id
are ordered by a hash of their text; the next of the last document is the
first, of a single document it is itself; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskgrid.llm.common import AT_ONCE, by_rows, frozen, short_batches

#: Code points of a k-mer, hash functions, and k-mers of a tuple.
K, SKETCHES, TUPLE = 10, 64, 2
#: Hashes that are held at a time.
HELD = 1 << 21

_BASE, _MIX, _OCCURRENCE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _functions(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _OCCURRENCE).astype(np.uint32) | np.uint32(1)


def kmers(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of all k-mers in order; a shorter text is one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return codes
    out = np.zeros(max(1, len(codes) - k + 1), np.uint64)
    for i in range(min(k, len(codes))):
        out = out * _BASE + (codes[i : i + len(out)] + np.uint64(1))
    return _mixed(out)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes stand before each."""
    order = np.argsort(hashes, kind="stable")
    run = hashes[order]
    new = np.r_[True, run[1:] != run[:-1]]
    at = np.arange(len(run))
    out = np.empty(len(run), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def signature(text: str | None, k: int = K, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """One 16-bit hash for every function."""
    grams = kmers(text or "", k)
    if not len(grams):
        return np.zeros(sketches, np.uint16)
    own = _mixed(grams + occurrences(grams) * _OCCURRENCE).astype(np.uint32)
    each, size = _functions(sketches), min(size, len(grams))
    least = np.empty((sketches, size), np.int64)
    step = max(1, HELD // len(own))
    for a in range(0, sketches, step):
        values = each[a : a + step, None] * own
        rows = np.arange(len(values))
        for j in range(size):
            # the first of equal values; what is taken is put above all others
            least[a : a + step, j] = found = values.argmin(axis=1)
            if j + 1 < size:
                values[rows, found] = np.uint32(0xFFFFFFFF)
    least.sort(axis=1)
    out = np.full(sketches, np.uint64(size))
    for j in range(size):
        out = _mixed(out * _BASE + grams[least[:, j]])
    return (out >> np.uint64(13)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written_out(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the following one (or all of it)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, k: int = K, sketches: int = SKETCHES, size: int = TUPLE) -> DataFrame:
    """(doc_id, fingerprint) of every row, in one pass without a shuffle."""

    def make():
        def work(rows: dict) -> Iterator[dict]:
            yield {"doc_id": rows["doc_id"], "fingerprint": [written_out(signature(t, k, sketches, size)) for t in rows["text"]]}

        return work

    return by_rows(docs.select("doc_id", "text"), make, "doc_id bigint, fingerprint string")


ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: A range's results, and its ends: ``first`` or ``last`` with the text.
STREAMED = f"{ROW}, kind string, part int, text string, hash bigint"


def _made(doc_id: int | None, text: str, sign: np.ndarray, following: str, next_sign: np.ndarray) -> dict:
    new = edit(text, following)
    new_sign = signature(new)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": written_out(sign),
        "edited_fingerprint": written_out(new_sign),
        "near_edited": likeness(sign, new_sign),
        "near_next": likeness(sign, next_sign),
    }


def _streamed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    empty = dict.fromkeys(schema.names)
    part = TaskContext.get().partitionId()
    before = None
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            out = []
            for row in batch.slice(a, AT_ONCE).to_pylist():
                text = row["text"] or ""
                sign = signature(text)
                if before is None:
                    out.append(empty | row | {"kind": "first", "part": part})
                else:
                    out.append(empty | _made(before["doc_id"], before["text"] or "", before_sign, text, sign) | {"kind": "row", "part": part})
                before, before_sign = row, sign
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if before is not None:
        yield pa.RecordBatch.from_pylist([empty | before | {"kind": "last", "part": part}], schema=schema)


def edited(docs: DataFrame) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and their likeness to it and to the next document's."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    schema = to_arrow_schema(StructType.fromDDL(STREAMED))
    found = frozen(ordered.mapInArrow(lambda batches: _streamed(batches, schema), STREAMED), "order-minhash")
    names = [x.split()[0] for x in ROW.split(", ")]
    # a row for each range of the exchange: their number doesn't grow with the rows in it
    ranges = sorted((r.doc_id is not None, r.doc_id, r.hash, r.part) for r in found.where("kind = 'first'").select("doc_id", "hash", "part").collect())
    follows = [(ranges[i - 1][3], ranges[i][3]) for i in range(len(ranges))]
    turn = spark.createDataFrame(follows, "part int, next_part int")
    heads = found.where("kind = 'first'").select(F.col("part").alias("next_part"), F.coalesce("text", F.lit("")).alias("following"))
    ends = found.where("kind = 'last'").select("part", "doc_id", "text").join(turn, "part").join(heads, "next_part").select("doc_id", "text", "following")

    def make():
        def work(rows: dict) -> Iterator[dict]:
            made = []
            for i, t, f in zip(rows["doc_id"], rows["text"], rows["following"], strict=True):
                made.append(_made(i, t or "", signature(t), f, signature(f)))
            yield {c: [m[c] for m in made] for c in names}

        return work

    return found.where("kind = 'row'").select(names).unionByName(by_rows(ends, make, ROW))
