"""Linear text classifiers on n-gram indicators scaled by naive Bayes ratios.

Both classifiers of this subpackage are made here. A text becomes the set of
its hashed n-grams (indicators, not counts). For every feature the log of the
ratio of its smoothed share among positive and negative training rows gives
``r`` (drawn towards 0 by some standard errors, if asked); a row is ``r`` on its
features, divided by its length in the Euclidean norm. A linear model with hinge loss is fitted to these rows by dual
coordinate descent, one dual variable at a time, each kept in [0, C]. The
margin becomes a score in 0..1 by a logistic curve fitted on training rows
that the model did not see.

The fit takes at most ``limit`` labelled rows (those with the smallest hash of
their id, so the choice does not depend on partitioning), and collects their
feature sets, packed to about a byte for each feature, to the driver. Scoring
covers every row, in one pass without a shuffle; it carries the weights (8
bytes for each hashed feature, 8 MB at 20 bits) to the executors.

Defined cases: a null text counts as empty; an empty text has only the bias
feature and gets a score as any other; rows without a label, or with a null
id, never train; of several labels of one id the greatest counts; repeated ids
train once per row; no labelled rows at all, or
one class only, give the same constant score for every row (the share of label
1, or 0.5 when there is no label).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm.common import Columns, by_rows, semi_by_id, short_batches

#: 64-bit odd multiplier (2**64 / golden ratio) for multiplicative hashing.
GOLDEN = 0x9E3779B97F4A7C15


#: Odd base of the rolling hash of code points.
BASE = 0x5851F42D4C957F2D


@dataclass(frozen=True)
class Features:
    """What indicators are taken from a text.

    orders: lengths of the n-grams of characters (code points; a space stands
    before and after the text). bits: log2 of the number of hashed features.
    lower: fold the case of all letters first. runs: add one more kind of
    n-gram, a word two to ``runs`` times in a row (whatever the word): an
    indicator for each length that occurs; 0 leaves them out.
    """

    orders: tuple[int, ...]
    bits: int = 18
    lower: bool = False
    runs: int = 0

    @property
    def size(self) -> int:
        return (1 << self.bits) + self.runs + 1  # hashed, runs, bias

    def of(self, text: str | None, seen: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Sorted distinct features of a whole text.

        seen: an all-false array of ``size``; left all false. only: true for
        features that matter; others are left out.
        """
        text = text or ""
        if self.lower:
            text = text.lower()
        code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        shift = np.uint64(64 - self.bits)
        used = [np.array([self.size - 1])]
        gram = code if text else code[:0]
        for n in range(1, min(max(self.orders), len(gram)) + 1):
            if n > 1:
                gram = gram[:-1] * np.uint64(BASE) + code[n - 1 :]
            if n in self.orders:
                used.append((((gram + np.uint64(n * GOLDEN % 2**64)) * np.uint64(GOLDEN)) >> shift).astype(np.int64))
        if self.runs:
            longest = longest_run(text.split())
            used.append((1 << self.bits) + np.arange(min(longest, self.runs + 1) - 1))
        if only is not None:
            used = [x[only[x]] for x in used]
        if sum(map(len, used)) < 2048:  # sorting is cheaper than a pass over all flags
            return np.unique(np.concatenate(used))
        for x in used:
            seen[x] = True
        out = np.flatnonzero(seen)
        seen[out] = False
        return out


def longest_run(words: list[str]) -> int:
    """Most times that one word stands in a row (1 if none repeats, or no word)."""
    best = now = 1
    before = None
    for w in words:
        if w == before:
            now += 1
            if now > best:
                best = now
        else:
            now = 1
            before = w
    return best


@dataclass(frozen=True)
class Model:
    features: Features
    weights: np.ndarray  # float32, one for each feature
    scale: np.ndarray  # float32, squares of the ratios, for a row's length
    slope: float
    offset: float

    def margins(self, texts: Iterable[str | None]) -> np.ndarray:
        seen, only = np.zeros(self.features.size, bool), self.scale > 0
        return np.array([self.margin(self.features.of(t, seen, only)) for t in texts], dtype=np.float64)

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum(dtype=np.float64) / np.sqrt(self.scale[x].sum(dtype=np.float64) + 1e-12))

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60)))


def log_count_ratio(rows: Iterable[np.ndarray], y: np.ndarray, size: int, errors: float = 0.0, alpha: float = 1.0) -> np.ndarray:
    """Log of the ratio of a feature's smoothed share of rows of label 1 and of label 0.

    Every ratio is drawn towards 0 by ``errors`` times its standard error
    sqrt(1 / p + 1 / q), and to 0 at most: a ratio that chance explains
    counts for nothing.
    """
    p, q = np.full(size, alpha), np.full(size, alpha)
    for x, positive in zip(rows, y, strict=True):
        (p if positive else q)[x] += 1
    n1 = float(np.sum(y))
    ratio = np.log(p / (n1 + 2 * alpha)) - np.log(q / (len(y) - n1 + 2 * alpha))
    return np.sign(ratio) * np.maximum(0.0, np.abs(ratio) - errors * np.sqrt(1 / p + 1 / q))


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, c: float, epochs: int, seed: int = 0) -> np.ndarray:
    """Weights of the linear hinge-loss model on rows with value ratio[x] / |ratio[x]| at their features x.

    The weights are held times ``ratio``, as they are used, so that a row needs
    no values of its own besides its length. The box of each class is scaled so
    that both weigh alike.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    share = max(1, y.sum()) / len(y), max(1, len(y) - y.sum()) / len(y)
    box = np.where(y > 0, c / (2 * share[0]), c / (2 * share[1]))
    square = ratio * ratio
    total = np.array([float(square[x].sum()) for x in rows])
    length, norm = np.sqrt(total + 1e-12), total / (total + 1e-12) + 1e-12
    dual, scaled = np.zeros(len(y)), np.zeros(len(ratio))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            gradient = sign[i] * float(scaled[rows[i]].sum()) / length[i] - 1.0
            new = min(max(dual[i] - gradient / norm[i], 0.0), box[i])
            if new != dual[i]:
                scaled[rows[i]] += (new - dual[i]) * sign[i] / length[i] * square[rows[i]]
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3 * c:
            break
    return scaled


def logistic_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.c_[margin, np.ones(len(margin))]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = x.T @ (p - target)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = float(np.abs(step).max())
        step = step * min(1.0, 5.0 / max(size, 1e-12))
        a, b = a - step[0], b - step[1]
        if size < 1e-6:
            break
    return float(a), float(b)


def fit(features: Features, rows: list[bytes], y: np.ndarray, errors: float = 0.0, c: float = 1.0, epochs: int = 30) -> Model:
    """Every fifth row calibrates the curve, the others fit the weights.

    Rows come packed and are unpacked one at a time; what is kept of a row are
    its features whose ratio is not 0.
    """
    y = np.asarray(y, dtype=np.int64)
    keep = np.arange(len(y)) % 5 != 4
    if len(y) == 0 or y.min() == y.max() or len(set(y[keep])) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        none = np.zeros(features.size, np.float32)
        return Model(features, none, none, 1.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratio((unpacked(r) for r, k in zip(rows, keep, strict=True) if k), y[keep], features.size, errors)
    told = ratio != 0
    own = [x[told[x]] for x in map(unpacked, rows)]
    scaled = dual_coordinate_descent([x for x, k in zip(own, keep, strict=True) if k], ratio, y[keep], c, epochs)
    raw = Model(features, scaled.astype(np.float32), (ratio * ratio).astype(np.float32), 1.0, 0.0)
    held = ~keep if len(set(y[~keep])) == 2 else np.ones(len(y), bool)
    slope, offset = logistic_curve(np.array([raw.margin(x) for x, h in zip(own, held, strict=True) if h]), y[held])
    return replace(raw, slope=slope, offset=offset)


def packed(x: np.ndarray) -> bytes:
    """A sorted feature set as compressed gaps, about a byte for each feature."""
    return zlib.compress(np.diff(x, prepend=0).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, features: Features, limit: int) -> tuple[list[bytes], np.ndarray]:
    """Packed feature sets and labels of at most ``limit`` labelled rows, in an order fixed by the ids and features."""
    told = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = told.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    if not picked:
        return [], np.zeros(0, int)
    y = {r.doc_id: r.y for r in picked}
    ids = docs.sparkSession.createDataFrame([(k,) for k in y], "doc_id bigint")

    def make():
        seen = np.zeros(features.size, bool)

        def take(rows: Columns) -> Iterator[dict]:
            yield {"doc_id": rows["doc_id"], "x": [packed(features.of(t, seen)) for t in rows["text"]]}

        return take

    found = by_rows(semi_by_id(docs.select("doc_id", "text"), ids), make, "doc_id bigint, x binary").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    order = np.random.default_rng(0).permutation(len(found))
    return [bytes(found[i].x) for i in order], np.array([y[found[i].doc_id] for i in order], dtype=int)


def score_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The score of a text column, as a column; the model travels as one broadcast."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series(model.score(model.margins(texts)))

    return score(F.col(text))


def scored(docs: DataFrame, model: Model, held_out: Column, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = docs.select("doc_id", held_out.alias("held_out"), score_column(docs.sparkSession, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
