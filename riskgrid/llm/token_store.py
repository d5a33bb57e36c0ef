"""Token ids in directly addressable codes, and a store of them.

Every id is split into chunks of eight bits, lowest first. Level 0 holds the
first chunk of every id; level k holds the next chunk of those ids that go on,
in order. A bitmap for each level marks the ids that go on, and a directory
holds the number of marks before each 512 bits, so the place of an id's next
chunk is found by one look-up and one popcount. Any id is read without
decoding its neighbours.

One block (``encode_block``) has this layout, all numbers little-endian:

    4 bytes   magic ``DAC1``
    3 x u64   documents, ids, levels
    u64       ids of the shard before this block
    i64[d]    document ids (a null id is the smallest i64)
    u64[d+1]  ids of the block before each document
    for each level: u64 entries; u8[entries] chunks;
                    u8[ceil(entries / 8)] bitmap, low bit first;
                    u32[ceil(entries / 512) + 1] marks before each 512 bits

A store is a Parquet table of such blocks (shard, block, n_docs, n_ids,
payload) in ascending order of the document ids: the rows are dealt out by
ranges of the id (and of a hash of the text, so that a repeated id can be parted), sorted, encoded and written in one stage. So a lost executor
repeats its ranges only, any store that Spark writes will do, and blocks are
read back in any order. Blocks hold about ``BLOCK_IDS`` ids; a longer document
is a block of its own.

Texts are encoded with the tokenizers library. Its pre-tokenizer never joins
characters across white space, so each piece of text between white space is
encoded once and kept in a table of the worker. Arrow cuts texts into pieces,
numbers the different ones and puts their ids in the order of the texts, so
Python sees each different piece of a run of texts once, and not every word.
A text that may hold a special token, and any tokenizer without that property,
goes the plain way.

Documents are read back through the rank directories alone (``Block.span``),
so a reader of some documents touches nothing else of their block.

Defined cases: a null text counts as empty and has only the end id; repeated
ids keep all their rows, ordered by the text's hash, then the text, and may
lie in several shards; null ids come first; ids of any size stay exact but
the smallest 64-bit one, which reads back as null; an empty table
gives an empty store; extra columns are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskgrid.llm.common import AT_ONCE, Columns, by_rows, fresh_path, perhaps_broadcast, short_batches
from riskgrid.llm.tokens import runs_of

MAGIC = b"DAC1"
BLOCK_IDS = 1 << 18
RANK_BITS = 512
NULL_ID = -(2**63)
#: Entries that a worker's table of encoded pieces may have: about 120 MB.
KNOWN = 600_000

#: Bytes of texts that are encoded together.
TOGETHER = 1 << 22

#: Stands between pieces that are encoded together: a control character that is no white space, and a token of its own.
GAP = "\x01"
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,!*#$%&|")] = True
_LETTER[97:123] = True
#: Letters that neither NFC nor the folding of case changes.
_SMALL = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: How the pieces of the pattern become characters of the vocabulary.
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


# --- codes ---------------------------------------------------------------


def encode_block(doc_ids: list[int], lengths: list[int], ids: np.ndarray, before: int) -> bytes:
    out = [MAGIC]
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        levels.append((rest.astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out.append(np.array([len(doc_ids), len(ids), len(levels), before], "<u8").tobytes())
    out.append(np.array(doc_ids, "<i8").tobytes())
    out.append(np.cumsum([0, *lengths]).astype("<u8").tobytes())
    for chunks, more in levels:
        bitmap = np.packbits(more, bitorder="little")
        marks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, int)
        out += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes(), bitmap.tobytes(), np.cumsum([0, *marks]).astype("<u4").tobytes()]
    return b"".join(out)


class Block:
    """Random access to an encoded block."""

    def __init__(self, raw: bytes):
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a token block")
        self.n_docs, self.n_ids, levels, self.before = (int(x) for x in np.frombuffer(raw, "<u8", 4, 4))
        at = 36
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            chunks = np.frombuffer(raw, np.uint8, n, at + 8)
            at += 8 + n
            bitmap = np.frombuffer(raw, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            marks = np.frombuffer(raw, "<u4", -(-n // RANK_BITS) + 1, at)
            at += 4 * len(marks)
            self.levels.append((chunks, bitmap, marks))

    def _rank(self, level: int, i: int) -> int:
        """Marks of a level before its i-th entry: a directory entry and a popcount of at most 512 bits."""
        _, bitmap, marks = self.levels[level]
        at = i // RANK_BITS
        rank = int(marks[at]) + int(np.bitwise_count(bitmap[at * RANK_BITS // 8 : i >> 3]).sum(dtype=np.int64))
        return rank + (int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else rank

    def id_at(self, i: int) -> int:
        """The i-th id of the block."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def span(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` (exclusive).

        The further chunks of neighbouring ids are neighbours on the next
        level, from the rank of the first to the rank of the end: two
        look-ups a level, and nothing outside the span is read.
        """
        if not 0 <= first <= end <= self.n_ids:
            raise IndexError((first, end))
        out = np.zeros(end - first, np.uint32)
        where = np.arange(end - first)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(where):
                break
            if k:
                out[where] |= chunks[first:end].astype(np.uint32) << np.uint32(8 * k)
            else:
                out[:] = chunks[first:end]
            more = np.unpackbits(bitmap[first >> 3 : -(-end // 8)], bitorder="little")[first & 7 :][: end - first].astype(bool)
            where = where[more]
            first, end = self._rank(k, first), self._rank(k, end)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, first: int, end: int) -> list[np.ndarray]:
        """The documents ``first`` to ``end`` (exclusive), from one span."""
        cuts = self.starts[first : end + 1]
        found = self.span(int(cuts[0]), int(cuts[-1]))
        return [found[a:b] for a, b in itertools.pairwise((cuts - cuts[0]).tolist())]


# --- encoding ------------------------------------------------------------


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as the library's encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"].encode().lower() for x in spec["added_tokens"]]
        self.opening = os.path.commonprefix(self.special)
        steps = spec.get("normalizer") or {}
        kinds = [x["type"] for x in steps.get("normalizers", [steps])]
        split, *then = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        #: White space is dropped by a pattern that never matches it, and case is folded before.
        folded = kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True and "\\s\\p{L}\\p{N}" in split["pattern"]["Regex"]
        gap = self.library.encode(GAP, add_special_tokens=False).ids
        self.by_piece = folded and len(gap) == 1
        self.gap_id = gap[0] if gap else None
        #: For pieces of small letters, which neither the normalizer nor the pattern changes: the same model without both.
        self.letters = self.library
        if self.by_piece and "[\\p{L}]+" in split["pattern"]["Regex"] and then == [BYTES]:
            self.letters = Tokenizer(self.library.model)
            self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(**{k: v for k, v in BYTES.items() if k != "type"})])
        self.known: dict[bytes, bytes] = {b"": b""}

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, texts: pa.Array) -> list[bytes]:
        if not self.by_piece:
            return [self.plain(t) for t in texts.to_pylist()]
        folded = pc.ascii_lower(texts)
        cut = pc.ascii_split_whitespace(_apart(folded))
        pieces = cut.flatten().dictionary_encode()
        ids = pa.array(self._pieces(pieces.dictionary.cast(pa.large_binary()).to_pylist()), pa.large_binary()).take(pieces.indices)
        _, ends, raw = ids.buffers()
        cuts = np.frombuffer(ends, np.int64, len(ids) + 1)[cut.offsets.to_numpy()].tolist()
        raw = memoryview(raw or b"")
        out = [bytes(raw[a:b]) for a, b in itertools.pairwise(cuts)]
        for i in np.flatnonzero(pc.match_substring(folded, self.opening).to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            if any(x in text.encode().lower() for x in self.special):
                out[i] = self.plain(text)
        return out

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces; those not in the table are encoded together."""
        known = self.known
        out = list(map(known.get, pieces))
        missing = [i for i, raw in enumerate(out) if raw is None]
        spare = self._encode([pieces[i] for i in missing])
        for i in missing:
            out[i] = spare[pieces[i]]
        known.update(itertools.islice(spare.items(), max(0, KNOWN - len(known))))
        return out

    def _encode(self, pieces: list[bytes], at_once: int = 256) -> dict[bytes, bytes]:
        """The ids of pieces without white space. One that holds a special token stands in texts that go the plain way only."""
        found, small, other = {}, [], []
        for text in b" ".join(pieces).decode("utf-8").split(" ") if pieces else []:
            if _SMALL.fullmatch(text):
                small.append(text)
            elif GAP in text:
                found[text.encode()] = self.plain(text)
            else:
                other.append(text)
        for library, own in (self.letters, small), (self.library, other):
            for a in range(0, len(own), at_once):
                part = own[a : a + at_once]
                ids = np.array(library.encode_batch_fast([f" {GAP} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = (4 * np.flatnonzero(ids == self.gap_id)).tolist()
                raw = ids.tobytes()
                for text, s, e in zip(part, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True):
                    found[text.encode()] = raw[s:e]
        return found


def _apart(folded: pa.Array) -> pa.Array:
    """The texts with a space before each run of marks after a small letter: the run is a token of its own, so it may stand apart."""
    _, ends, raw = folded.buffers()
    ends = np.frombuffer(ends, np.int32)[folded.offset :][: len(folded) + 1].astype(np.int64)
    raw = np.frombuffer(raw or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    places = np.flatnonzero(_LETTER[raw[:-1]] & _MARK[raw[1:]]) + 1
    ends += np.searchsorted(places, ends)
    return pa.LargeStringArray.from_buffers(len(folded), pa.py_buffer(ends), pa.py_buffer(np.insert(raw, places, 32)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


BLOCKS = "shard int, block int, n_docs bigint, n_ids bigint, payload binary"


def blocks(docs: DataFrame, tokenizer: str, end_id: int | None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The encoded blocks, dealt out by ranges of (doc_id, hash of the text)."""
    short_batches(docs.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        doc_ids, raws, size, before, block = [], [], 0, 0, 0

        def cut() -> pa.RecordBatch:
            nonlocal doc_ids, raws, size, before, block
            ids = np.frombuffer(b"".join(raws), "<u4")
            payload = encode_block(doc_ids, [len(r) // 4 for r in raws], ids, before)
            out = pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "payload": [payload]}, schema=schema)
            before, block = before + len(ids), block + 1
            doc_ids, raws, size = [], [], 0
            return out

        for batch in batches:
            names = [NULL_ID if v is None else v for v in batch.column("doc_id").to_pylist()]
            texts = batch.column("text")
            # the more texts are encoded together, the fewer pieces are encoded again
            for a, b in runs_of(pc.binary_length(texts).to_pylist(), TOGETHER):
                for k, raw in zip(names[a:b], own.texts(texts.slice(a, b - a)), strict=True):
                    raw += end
                    if doc_ids and size + len(raw) // 4 > block_ids:
                        yield cut()
                    doc_ids.append(k)
                    raws.append(raw)
                    size += len(raw) // 4
        if doc_ids:
            yield cut()

    text = F.coalesce("text", F.lit(""))
    order = F.col("doc_id").asc_nulls_first(), F.col("h").asc()
    dealt = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(encode, BLOCKS)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode all documents into a new store at ``path``."""
    blocks(docs, tokenizer, end_id, block_ids).write.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard: one number for each shard, from the block sizes alone."""
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    out, total = {}, 0
    for r in sorted(sizes, key=lambda r: r.shard):
        out[r.shard] = total
        total += r.n
    return out


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with_ids) the ids of every document of a store, each looked up by its place."""
    starts = shard_starts(spark, path)
    fields = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def make():
        def decode(rows: Columns) -> Iterator[dict]:
            for shard, payload in zip(rows["shard"], rows["payload"], strict=True):
                b = Block(payload)
                for a in range(0, b.n_docs, AT_ONCE):
                    own = range(a, min(a + AT_ONCE, b.n_docs))
                    found = b.documents(own.start, own.stop)
                    out = {
                        "doc_id": [None if b.doc_ids[k] == NULL_ID else int(b.doc_ids[k]) for k in own],
                        "start": [starts[shard] + b.before + int(b.starts[k]) for k in own],
                        "n_tokens": [len(x) for x in found],
                        "ids_crc32": [zlib.crc32(x.astype("<u4", copy=False)) for x in found],
                    }
                    yield out | ({"ids": [x.astype(np.int32) for x in found]} if with_ids else {})

        return decode

    return by_rows(spark.read.parquet(path).select("shard", "payload"), make, fields, at_once=1)


def token_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, id) for places (``place``: ids before it in the whole store) that lie in the store.

    Places and blocks meet in an equi-join on stretches of ``BLOCK_IDS``
    places, of which a block touches two or a few; the id is then read by
    ``Block.id_at``, and no block is decoded. A place that is asked repeatedly
    is answered once.
    """
    starts = shard_starts(spark, path)
    table = spark.createDataFrame(list(starts.items()), "shard int, first bigint")
    sizes = spark.read.parquet(path).where("n_ids > 0").select("shard", "block", "n_ids").join(perhaps_broadcast(table), "shard")
    order = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bounds = sizes.select("shard", "block", "n_ids", (F.col("first") + F.coalesce(F.sum("n_ids").over(order), F.lit(0))).alias("low"))
    stretch = bounds.select("*", F.explode(F.expr(f"sequence(low div {BLOCK_IDS}, (low + n_ids - 1) div {BLOCK_IDS})")).alias("stretch"))
    asked = places.select("place").distinct().withColumn("stretch", F.expr(f"place div {BLOCK_IDS}"))
    wanted = asked.join(stretch, "stretch").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.col("n_ids")))
    grouped = wanted.groupBy("shard", "block").agg(F.collect_list("place").alias("places"), F.first("low").alias("low"))
    met = spark.read.parquet(path).select("shard", "block", "payload").join(grouped, ["shard", "block"])

    def make():
        def look(rows: Columns) -> Iterator[dict]:
            for payload, at, low in zip(rows["payload"], rows["places"], rows["low"], strict=True):
                b = Block(payload)
                yield {"place": at, "id": [b.id_at(p - low) for p in at]}

        return look

    return by_rows(met.select("payload", "places", "low"), make, "place bigint, id bigint", at_once=1)


def stored(docs: DataFrame, tokenizer: str, end_id: int | None, path: str | None = None) -> DataFrame:
    """Write a store (to the shared folder unless a path is given) and read its documents back, without their ids."""
    path = path or fresh_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, end_id)
    return read_store(docs.sparkSession, path, with_ids=False)
