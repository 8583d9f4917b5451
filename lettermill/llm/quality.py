"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete binary ones of one depth, flattened into arrays, so that a batch of documents
walks all of them level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lettermill.llm.labels import drawn, held_out, learning_rows, texts_of
from lettermill.llm.words import mix, space_words, word_hashes

#: Labelled rows at most that the trees are fitted on.
SAMPLE = 20_000
DEPTH, TREES, RATE, BINS = 4, 80, 0.15, 64
#: Least sum of second derivatives in a leaf, and the weight of the squared leaf values.
LEAF, RIDGE = 4.0, 1.0
#: Scores from here on are of good quality.
CUT = 0.3

_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128,
    np.isin(_BYTES, [32, 9, 11, 12, 13]), _BYTES == 10, np.isin(_BYTES, list(b".,;:'-")), np.isin(_BYTES, list(b"!?")), np.isin(_BYTES, list(b"|<>{}[]\\/_=~^`")),
    np.isin(_BYTES, list(b"#$%&*@+()\"")), np.isin(_BYTES, list(b"aeiouAEIOU")), _BYTES < 32,
]).astype(np.float64).T

FEATURES = 28


def statistics(text: bytes | None) -> np.ndarray:
    """FEATURES numbers about a whole text; all 0 for null and empty ones."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256).astype(np.float64)
    n = len(raw)
    share = counts / n
    out[:12] = share @ _CLASSES
    seen = share[share > 0]
    out[12] = -(seen * np.log2(seen)).sum()
    out[13] = np.log1p(n)
    size = np.concatenate([np.fromiter(map(len, w), np.int64, len(w)) for w in space_words(text)])
    if not len(size):
        return out
    h = word_hashes(text)
    m = len(h)
    distinct, times = np.unique(h, return_counts=True)
    out[14] = np.log1p(m)
    out[15], out[16], out[17] = size.mean(), size.std(), np.log1p(size.max())
    out[18], out[19] = len(distinct) / m, times.max() / m
    out[20] = len(distinct) / m**0.8
    if m > 1:
        out[21] = (h[1:] == h[:-1]).mean()
        with np.errstate(over="ignore"):
            out[22] = len(np.unique(mix(h[1:] * np.uint64(3) + h[:-1]))) / (m - 1)
    out[23], out[24] = (size == 1).mean(), (size > 14).mean()
    breaks = np.flatnonzero(raw == 10)
    out[25] = np.log1p(len(breaks))
    out[26] = n / (len(breaks) + 1.0) / 100
    out[27] = (counts[ord(".")] + counts[ord("!")] + counts[ord("?")]) / m
    return out


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes in level order, then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        trees, inner = self.feature.shape
        raw = np.full(len(x), self.base)
        if trees:
            at, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees)[None, :], np.arange(len(x))[:, None]
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
            raw = raw + self.leaf[tree, at - inner].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, trees: int = TREES, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boost trees on the logistic loss. Without both labels the score is a constant (0.5 without any)."""
    inner, leaves = 2**depth - 1, 2**depth
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], 1)
    place = binned + np.arange(width) * bins
    raw = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    value = lambda g, h: -g / (h + RIDGE)
    gain = lambda g, h: g * g / (h + RIDGE)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            key = ((node[:, None] * width * bins) + place).ravel()
            g = np.bincount(key, np.repeat(grad, width), wide * width * bins).reshape(wide, width, bins).cumsum(2)
            h = np.bincount(key, np.repeat(hess, width), wide * width * bins).reshape(wide, width, bins).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            better = gain(g, h) + gain(gt - g, ht - h) - gain(gt, ht)
            better[(h < LEAF) | (ht - h < LEAF)] = 0
            flat = better.reshape(wide, -1)
            best = flat.argmax(1)
            f, b = best // bins, best % bins
            split = flat[np.arange(wide), best] > 1e-9
            b = np.where(split, b, bins)  # no split: all go left
            feature[t, first : first + wide] = f
            threshold[t, first : first + wide] = [cuts[i][j] if s and j < len(cuts[i]) else np.inf for i, j, s in zip(f, b, split, strict=True)]
            node = 2 * node + (binned[np.arange(n), f[node]] > b[node])
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        leaf[t] = rate * value(g, h)
        raw += leaf[t][node]
    return Trees(feature, threshold, leaf, base)


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text], dtype="object")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most sample labelled rows that aren't held out, drawn by the hash of doc_id."""
    rows = drawn(learning_rows(labels, label, docs), sample, "doc_id", "y")
    got = texts_of(rows, docs, sample, _statistics).toPandas()
    got = got.assign(key=[np.asarray(x).tobytes() for x in got["x"]]).sort_values(["doc_id", "y", "key"])
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), FEATURES)
    return fit(x, got["y"].to_numpy(np.float64))


def scored(model: Trees, text: Column) -> Column:
    """The score of each whole text, 0 to 1. Null and empty texts get the score of no statistics."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            for at in range(0, len(part), 2048):
                x = np.array([statistics(t) for t in part.iloc[at : at + 2048]], np.float64).reshape(-1, FEATURES)
                out = model.score(x) if not at else np.concatenate([out, model.score(x)])
            yield pd.Series(out if len(part) else [], dtype="float64")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType()).asNondeterministic()(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, held_out, score (of good quality), predicted (1 from cut on).

    Labels are learned only from rows that aren't held out; statistics are of the whole text alone. With
    no label to learn from every score is 0.5. Repeated rows get the same score, an empty table none.
    """
    score = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(train(docs, labels), F.col("text")).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs, all columns, without those that classify would predict 0.

    Null and empty texts are judged by the score of no statistics, repeated rows alike; columns of any name
    pass. With no label to learn from every score is 0.5 and all stay. An empty table gives an empty one.
    """
    return docs.withColumn("__lm_score", scored(train(docs, labels), F.col("text"))).where(F.col("__lm_score") >= cut).select(*docs.columns)
