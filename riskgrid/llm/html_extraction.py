"""Main text of pages: a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks (html_blocks). A block's features come from
the tags above it, the words of their names, its length, links, punctuation
and service words, and its place in the page. A chain with two labels (article
or not) scores a labelling by these features and by each step between
neighbours; weights maximise the likelihood of labelled pages (html_training:
a fixed, bounded set), by full-batch gradient steps with the exact gradient
from the forward-backward sums. Pages are decoded by Viterbi.

Each page is one row and is decoded in one pass; nothing is shuffled. The fit
takes ``PAGES`` pages whatever the input and is made once per session.

Defined cases: a null or empty page, or one without an article block, gives an
empty text and 0; white space (any Unicode space) inside a block becomes one
space, ``<br>`` counts as one; repeated rows are read each time; a page of any
length is read whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from riskgrid.llm.common import Columns, by_rows
from riskgrid.llm.html_blocks import ROOT, Block, Element, blocks
from riskgrid.llm.html_training import labelled_pages

PAGES, STEPS, RATE, DECAY = 900, 150, 0.15, 1e-3


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    words = b.text.split(" ", 40)
    out = [f"length={min(n.bit_length(), 10)}", f"words={min(len(words), 40) // 4}", f"linked={4 * b.linked // n}", f"ends={b.text[-1] if not b.text[-1].isalnum() else 'w'}"]
    if "©" in b.text:
        out.append("copyright")
    if len(words) <= 16:
        out += [f"word={w.lower().strip('.,:!?')}" for w in words]
    return out


def place_features(k: int, n: int) -> list[str]:
    return [f"place={5 * k // n}", *(["first"] if k == 0 else []), *(["last"] if k == n - 1 else [])]


class Chain:
    """Weights of the two-label chain: one score for each feature, steps, and a start."""

    def __init__(self, weight: dict[str, float], step: np.ndarray, bias: float):
        self.weight, self.step, self.bias = weight, step.tolist(), bias

    def unary(self, page: list[Block]) -> list[float]:
        """Score of label 1 for each block; an element's part is its parent's and that of its own features."""
        get, out = self.weight.get, []
        known: dict[Element, float] = {ROOT: self.bias}
        for k, b in enumerate(page):
            at, chain = b.above, []
            while at not in known:
                chain.append(at)
                at = at.parent
            score = known[at]
            for at in reversed(chain):
                score += sum(get(f, 0.0) for f in at.fresh)
                known[at] = score
            out.append(score + sum(get(f, 0.0) for f in b.above.place()) + sum(get(f, 0.0) for f in text_features(b)) + sum(get(f, 0.0) for f in place_features(k, len(page))))
        return out

    def labels(self, page: list[Block]) -> list[int]:
        """The best labelling, by Viterbi."""
        if not page:
            return []
        (t00, t01), (t10, t11) = self.step
        scores = self.unary(page)
        v0, v1, back = 0.0, scores[0], []
        for s in scores[1:]:
            a0, a1 = v0 + t00 >= v1 + t10, v0 + t01 > v1 + t11
            v0, v1 = (v0 + t00 if a0 else v1 + t10), (v0 + t01 if a1 else v1 + t11) + s
            back.append((0 if a0 else 1, 0 if a1 else 1))
        now = int(v1 > v0)
        out = [now]
        for b in reversed(back):
            now = b[now]
            out.append(now)
        return out[::-1]


def marginals(unary: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of label 1 of every block, expected number of each step, and log partition sum of each chain, by forward and backward sums over all chains at once."""
    n, longest, log = len(sizes), int(sizes.max()), np.logaddexp
    begin = np.cumsum(sizes) - sizes
    cell = np.arange(longest)[None, :] < sizes[:, None]
    u = np.where(cell, unary[np.where(cell, begin[:, None] + np.arange(longest)[None, :], 0)], 0.0)
    fwd = np.zeros((longest, n, 2))
    fwd[0, :, 1] = u[:, 0]
    for t in range(1, longest):
        nxt = log(fwd[t - 1][:, :1] + step[0], fwd[t - 1][:, 1:] + step[1])
        nxt[:, 1] += u[:, t]
        fwd[t] = np.where(cell[:, t : t + 1], nxt, fwd[t - 1])
    total = log(fwd[-1][:, 0], fwd[-1][:, 1])
    bwd = np.zeros((longest, n, 2))
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        ahead = bwd[t + 1] + np.stack([np.zeros(n), u[:, t + 1]], axis=1)
        pair = step[None] + ahead[:, None, :]
        bwd[t] = np.where(cell[:, t + 1 : t + 2], log(pair[:, :, 0], pair[:, :, 1]), 0.0)
        joint = np.exp(fwd[t][:, :, None] + pair - total[:, None, None])
        expected += joint[cell[:, t + 1]].sum(axis=0)
    return np.exp(fwd[:, :, 1] + bwd[:, :, 1] - total[None]).T[cell], expected, total


def fit(pages: list[list[tuple[Block, int]]], steps: int = STEPS) -> Chain:
    """Maximise the penalised likelihood of labelled pages."""
    index: dict[str, int] = {}
    rows, cols = [], []
    count: dict[str, int] = {}
    listed = []
    for page in pages:
        for k, (b, _) in enumerate(page):
            fs = list(dict.fromkeys(b.above.features() + text_features(b) + place_features(k, len(page))))
            listed.append(fs)
            for f in fs:
                count[f] = count.get(f, 0) + 1
    for r, fs in enumerate(listed):
        for f in fs:
            if count[f] >= 4:
                rows.append(r)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    y = np.array([v for page in pages for _, v in page])
    sizes = np.array([len(p) for p in pages])
    gold_steps = np.zeros((2, 2))
    for page in pages:
        for (_, a), (_, b) in zip(page, page[1:], strict=False):
            gold_steps[a, b] += 1
    theta = np.zeros(len(index) + 5)  # weights, bias, steps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, steps + 1):
        w, bias, step = theta[: len(index)], theta[len(index)], theta[len(index) + 1 :].reshape(2, 2)
        p1, expected, _ = marginals(np.bincount(rows, w[cols], len(y)) + bias, step, sizes)
        rest = y - p1
        gradient = np.concatenate([np.bincount(cols, rest[rows], len(index)), [rest.sum()], (gold_steps - expected).ravel()]) / len(y)
        gradient -= DECAY * theta / len(y) * len(pages)
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Chain({f: float(theta[k]) for f, k in index.items()}, theta[len(index) + 1 :].reshape(2, 2), float(theta[len(index)]))


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The chain fitted on the fixed set of labelled pages."""
    return fit(labelled_pages(PAGES))


def main_text(page: str | None, chain: Chain) -> str:
    read = blocks(page)
    return "\n\n".join(b.text for b, v in zip(read, chain.labels(read), strict=True) if v)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def make():
        chain = shared.value

        def work(rows: Columns) -> Iterator[dict]:
            texts = [main_text(h, chain) for h in rows["html"]]
            yield {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return by_rows(pages.select("page_id", "url", "html"), make, "page_id bigint, url string, text string, n_chars bigint", at_once=64)
