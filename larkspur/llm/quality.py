"""A quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins.  Boosting goes round the features, fitting a shallow tree
over the bins of one of them to what the model still gets wrong, and adds the tree to that
feature's table; then it goes round the pairs of features that gain most.  A score is the
logistic of a sum of table entries, one for each feature and pair.

Defined results: a null text is an empty one, which has features like any other; documents
without a label are scored; a document with several labels counts with the highest; a training
set without rows scores 0.5 everywhere, one with a single class scores that class's smoothed
share; rows that repeat are scored alike; other columns pass through unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, as_bytes, held_out, slices, table, words

#: Labelled rows that the fit reads, at most, chosen by the hash of their id.
FIT_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.15

NAMES = ("bytes", "words", "word_bytes", "upper", "digits", "marks", "odd_marks", "newlines", "high", "distinct", "top_word", "repeats", "line_repeats", "line_words", "marked_words", "capital_words", "long_words", "ends")
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGITS = np.arange(48, 58)
_SENTENCE = np.array([ord(c) for c in ".,;:?'\"-()"])
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_ODD = np.setdiff1d(_MARKS, _SENTENCE)


def features(text: bytes) -> list[float]:
    """Lengths, shares of kinds of bytes, and repetition of words and lines."""
    n = max(1, len(text))
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    raw = text.split()
    found = words(text)
    m = max(1, len(found))
    times = Counter(found)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, int(hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum()))
    odd = set(_ODD.tolist())
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(found))),
        sum(map(len, found)) / m,
        int(hist[_UPPER].sum()) / letters,
        int(hist[_DIGITS].sum()) / n,
        int(hist[_MARKS].sum()) / n,
        int(hist[_ODD].sum()) / n,
        int(hist[10]) / n,
        int(hist[128:].sum()) / n,
        len(times) / m,
        max(times.values(), default=0) / m,
        sum(map(eq, found, found[1:])) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(found) / max(1, len(lines)))),
        sum(1 for w in raw if w[-1] in odd) / m,
        sum(1 for w in raw if w.isupper()) / m,
        sum(1 for w in found if len(w) > 30) / m,
        sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / max(1, len(lines)),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(NAMES))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2, floor: float = 5.0) -> np.ndarray:
    """A regression tree over ordered bins, as the value of each bin (Newton steps)."""
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + 1.0))
    if depth and len(gradient) > 1:
        g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        total, whole = gradient.sum(), weight.sum()
        gain = g**2 / (h + 1.0) + (total - g) ** 2 / (whole - h + 1.0) - total**2 / (whole + 1.0)
        gain[(h < floor / 4) | (whole - h < floor / 4)] = -np.inf
        at = int(np.argmax(gain))
        if gain[at] > 1e-9:
            out = np.concatenate((_tree(gradient[: at + 1], weight[: at + 1], depth - 1, floor), _tree(gradient[at + 1 :], weight[at + 1 :], depth - 1, floor)))
    return out


def _grid_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One cut on each side of a pair's grid: four leaves, the best of all cuts."""

    def fit(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        best, out = -np.inf, np.full(g.shape, g.sum() / (h.sum() + 1.0))
        a, b = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
        for i in range(g.shape[0] - 1):
            for j in range(g.shape[1] - 1):
                gs = np.array([a[i, j], a[i, -1] - a[i, j], a[-1, j] - a[i, j], a[-1, -1] - a[i, -1] - a[-1, j] + a[i, j]])
                hs = np.array([b[i, j], b[i, -1] - b[i, j], b[-1, j] - b[i, j], b[-1, -1] - b[i, -1] - b[-1, j] + b[i, j]])
                gain = (gs**2 / (hs + 1.0)).sum()
                if gain > best:
                    v, best = gs / (hs + 1.0), gain
                    out = np.empty(g.shape)
                    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
        return best - g.sum() ** 2 / (h.sum() + 1.0), out

    return fit(gradient, weight)


@dataclass
class Gam:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Gam:
        if not len(y):
            return Gam()
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        out = Gam(base=float(np.log(share / (1 - share))))
        if y.min() == y.max():
            return out
        f = x.shape[1]
        out.cuts = [_cuts(x[:, k], BINS) for k in range(f)]
        out.tables = [np.zeros(len(c) + 1) for c in out.cuts]
        bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(out.cuts)]
        margin = np.full(len(y), out.base)
        for _ in range(ROUNDS):
            for k in range(f):
                p = 1 / (1 + np.exp(-margin))
                size = len(out.tables[k])
                step = RATE * _tree(np.bincount(bins[k], weights=y - p, minlength=size), np.bincount(bins[k], weights=p * (1 - p), minlength=size))
                out.tables[k] += step
                margin += step[bins[k]]
        out.pair_cuts = [_cuts(x[:, k], PAIR_BINS) for k in range(f)]
        coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(out.pair_cuts)]

        def grid(a: int, b: int) -> tuple[float, np.ndarray]:
            p = 1 / (1 + np.exp(-margin))
            shape = (len(out.pair_cuts[a]) + 1, len(out.pair_cuts[b]) + 1)
            cell = coarse[a] * shape[1] + coarse[b]
            n = shape[0] * shape[1]
            return _grid_tree(np.bincount(cell, weights=y - p, minlength=n).reshape(shape), np.bincount(cell, weights=p * (1 - p), minlength=n).reshape(shape))

        gains = sorted(((grid(a, b)[0], a, b) for a in range(f) for b in range(a + 1, f) if len(out.pair_cuts[a]) and len(out.pair_cuts[b])), reverse=True)
        out.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
        out.pair_tables = [np.zeros((len(out.pair_cuts[a]) + 1, len(out.pair_cuts[b]) + 1)) for a, b in out.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), t in zip(out.pairs, out.pair_tables, strict=True):
                step = RATE * grid(a, b)[1]
                t += step
                margin += step[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for k, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            margin += t[np.searchsorted(c, x[:, k], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.pair_cuts)]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                margin += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", limit: int = FIT_ROWS) -> Gam:
    """Fit on the labelled documents, or the ``limit`` of them whose ids hash lowest."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = matrix(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.select("text", "y").mapInArrow(run, schema).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    y = np.array(got.column("y").to_pylist(), dtype=np.float64)
    # The order of rows differs between runs; sums of floats must not.
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, dtype=np.int64)
    return Gam.fit(x[order], y[order])


def rate(docs: DataFrame, model: Gam, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with each text's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(shared.value.score(matrix(as_bytes(part.column(text)))), pa.float64())]

    return add_columns(docs, text, [T.StructField(score, T.DoubleType())], make)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    out = rate(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
