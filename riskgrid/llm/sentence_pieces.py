"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

All distinct words of a batch lie in one flat array of symbols. In a round
every pair of neighbours in a word gets the rank of the piece it would make,
each word's smallest rank is found by a segmented minimum, and its pairs of
that rank are merged at once from the left, without overlap; words without a
pair leave, and the array is compacted. A merge may make a pair of a rank that
is not larger than that of the pairs still to be merged in its word; then the
library would take it first, so such a word merges its leftmost pair only in
that round. The rounds end when no pair is left in any word.

No piece has a space mark after another character, so merges never cross the
start of a word, and a word's ids do not depend on its neighbours: each worker
keeps the ids of short words it has met.

Characters that no piece has become their UTF-8 bytes. Decoding is the
library's.

Defined cases: a null text counts as empty; an empty text has only the end id
and decodes to an empty text; repeated rows are encoded each time; ids of any
size stay exact, and a null id stays null; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from riskgrid.llm.common import Columns, by_rows

#: Entries of a worker's table of words, and the longest word in it: about 30 MB.
KNOWN, LONGEST = 150_000, 48
MARK = "▁"
_NONE = np.int64(1) << 40


class Pieces:
    """A model's merge table, and encoding with it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("  a b ") != f"{MARK * 3}a{MARK}b{MARK}":
            raise ValueError("the model changes more of a text than its spaces")
        usable = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in usable}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space after another character")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        scores = sorted({sp.get_score(i) for i in usable}, reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, sp.vocab_size() + len(symbols))
        self.size = max(symbols.values()) + 1
        self.n_pieces = sp.vocab_size()
        self.char = {c: k for c, k in symbols.items() if len(c) == 1}
        self.back = {k: c for c, k in self.char.items()}
        table = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    table[a * self.size + b] = (rank_of[sp.get_score(i)], i)
        self.keys = np.array(sorted(table), np.int64)
        self.ranks = np.array([table[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([table[k][1] for k in self.keys.tolist()], np.int64)
        self.text = [str(i) for i in range(sp.vocab_size())]
        self.known: dict[str, bytes] = {}

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each symbol with the next one of its word."""
        rank = np.full(len(sym), _NONE)
        piece = np.zeros(len(sym), np.int64)
        at = np.flatnonzero((word[:-1] == word[1:]) & (sym[:-1] < self.size) & (sym[1:] < self.size))
        key = sym[at] * self.size + sym[at + 1]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[k] == key
        rank[at[hit]], piece[at[hit]] = self.ranks[k[hit]], self.made[k[hit]]
        return rank, piece

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of words, each with its own leading space marks."""
        out: list[bytes] = [b""] * len(words)
        flat = "".join(words)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        distinct, inverse = np.unique(code, return_inverse=True)
        sym = np.array([self.char.get(chr(c), self.size + c) for c in distinct.tolist()], np.int64)[inverse] if len(code) else code
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        while len(sym):
            rank, piece = self._pairs(sym, word)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.r_[first, len(sym)])
            done = least == _NONE
            if done.any():
                gone = np.repeat(done, lengths)
                self._finish(sym[gone], word[gone], out)
                sym, word, rank, piece = sym[~gone], word[~gone], rank[~gone], piece[~gone]
                lengths, least = lengths[~done], least[~done]
            if not len(sym):
                break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # pairs that overlap follow each other: every second one of such a run stays
            start = np.r_[True, np.diff(at) != 1]
            place = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            at = at[place % 2 == 0]
            new_sym, new_word, spot = self._merge(sym, word, piece, at)
            owner = word[at]
            several = np.r_[False, owner[1:] == owner[:-1]]
            if several.any():
                again, _ = self._pairs(new_sym, new_word)
                limit = np.repeat(least, lengths)[at]
                near = again[spot] <= limit
                near |= (spot > 0) & (again[spot - 1] <= limit)
                risky = np.unique(owner[near])
                drop = several & np.isin(owner, risky)
                if drop.any():
                    new_sym, new_word, _ = self._merge(sym, word, piece, at[~drop])
            sym, word = new_sym, new_word
        return out

    @staticmethod
    def _merge(sym: np.ndarray, word: np.ndarray, piece: np.ndarray, at: np.ndarray):
        sym = sym.copy()
        sym[at] = piece[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        return sym[keep], word[keep], at - np.arange(len(at))

    def _finish(self, sym: np.ndarray, word: np.ndarray, out: list[bytes]) -> None:
        odd = sym >= self.n_pieces
        if odd.any():
            ids, owner = [], []
            for s, w in zip(sym.tolist(), word.tolist(), strict=True):
                own = [s] if s < self.n_pieces else self.byte[list((self.back[s] if s < self.size else chr(s - self.size)).encode("utf-8", "replace"))].tolist()
                ids += own
                owner += [w] * len(own)
            sym, word = np.array(ids, np.int64), np.array(owner)
        raw = sym.astype("<i4").tobytes()
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        for w, s, e in zip(word[first].tolist(), (4 * first).tolist(), [*(4 * first[1:]).tolist(), len(raw)], strict=True):
            out[w] = raw[s:e]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library's encode(text)."""
        known = self.known
        split = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        missing = list({w for ws in split for w in ws if w not in known})
        spare: dict[str, bytes] = {}
        first = size = 0
        for i, w in enumerate(missing):
            size += len(w)
            if size > 1 << 18 or i == len(missing) - 1:
                part = missing[first : i + 1]
                spare.update(zip(part, self.encode_words([x.replace(" ", MARK) for x in part]), strict=True))
                first, size = i + 1, 0
        room = KNOWN - len(known)
        if room > 0:
            known.update([(w, x) for w, x in spare.items() if len(w) <= LONGEST][:room])

        def look(w):
            found = spare.get(w)
            return known[w] if found is None else found

        return [np.frombuffer(b"".join(map(look, ws)), "<i4") for ws in split]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_WORD = re.compile(" +[^ ]*")
_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's model of a file, made once."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encoded(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (with_ids) ids and decoded text of every row; an end id closes each text."""
    fields = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def make():
        own = pieces(model)
        end = own.library.eos_id()

        def work(rows: Columns) -> Iterator[dict]:
            ids = [[*x.tolist(), end] for x in own.encode([t or "" for t in rows["text"]])]
            texts = [own.decode(x) for x in ids]
            out = {
                "doc_id": rows["doc_id"],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(" ".join(map(own.text.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
            }
            yield out | ({"ids": ids, "decoded": texts} if with_ids else {})

        return work

    return by_rows(docs.select("doc_id", "text"), make, fields)
