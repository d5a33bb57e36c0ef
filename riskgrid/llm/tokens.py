"""Whole-batch word hashing in numpy: no Python loop over words.

A word is a run of ASCII letters and digits and of any non-ASCII bytes, with
A-Z folded. Its hash is a polynomial over its bytes modulo 2**64, taken for
all words at once from running sums, then mixed. Words longer than a chunk
only make that chunk longer; texts are never cut inside a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = np.uint64(0x9E3779B97F4A7C15)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0][:n], _powers[1][:n]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _WORD[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a byte array."""
    out_h, out_s = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):
        end = min(len(raw), at + chunk)
        while end < len(raw) and _WORD[raw[end]]:
            end += 1
        part = raw[at:end]
        s, e = word_spans(part)
        up, down = _power(max(len(part), chunk))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_FOLD[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        out_h.append(h)
        out_s.append(s + at)
        at = end
    return np.concatenate(out_h), np.concatenate(out_s)


def batch_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a list of texts, and the first word of each text (one more at the end)."""
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    h, s = word_hashes(np.frombuffer(b" ".join([*raws, b""]), np.uint8))
    return h, np.searchsorted(s, starts)


def runs_of(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of items of about ``limit`` together; a larger item is a run of its own."""
    first = size = 0
    i = -1
    for i, n in enumerate(sizes):
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first <= i:
        yield first, i + 1


def groups_of(texts: list, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts of about ``limit`` characters together; a longer text is a run of its own."""
    return runs_of((len(t) if t is not None else 0 for t in texts), limit)
