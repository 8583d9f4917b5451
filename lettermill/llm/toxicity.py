"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the distinct words and word beginnings of a text are trained from confirmed toxic examples and
unlabelled text. Their risk estimator weighs both by the share of toxic text, and its part for the
negatives, which an overfit would push below 0, is held there (Kiryo et al., 2017). The words to weigh are chosen
by counts over all documents that aren't held out, and the cut lies where the scores of all of them put it; only the gradient
steps work on samples.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from lettermill.llm.labels import drawn, held_out, learning_rows, texts_of
from lettermill.llm.words import alnum_words
from lettermill.session import count, materialize

#: Toxic examples and unlabelled texts at most that the gradient steps work on.
POSITIVES, UNLABELLED = 5_000, 15_000
#: Words, and their beginnings of so many bytes, are hashed to this many bits. Weighed are at most so many
#: of them, which this many examples have at least and a log-likelihood ratio sets apart this clearly.
BITS, STEMS = 20, (4, 5, 6, 7, 8)
WORDS, LEAST, APART = 512, 4, 15.0
EPOCHS, BATCH, RATE, RIDGE, SEEDS = 30, 512, 0.05, 1e-5, 5
#: Scores from here on are toxic.
CUT = 0.5
#: Steps of raw scores in which the cut is sought, and where they are cut off.
STEP, FAR = 1e-3, 40.0
#: Words whose places are remembered in a task.
REMEMBERED = 200_000

_MASK = (1 << BITS) - 1


def word_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct words, and beginnings of words, of a whole text."""
    seen: set[bytes] = set()
    for words in alnum_words(text):
        seen.update(words)
    seen |= {w[:k] for w in seen for k in STEMS}
    return np.unique(np.fromiter((zlib.crc32(w) & _MASK for w in seen), np.int32, len(seen)))


class Columns(dict):
    """What a text's words are among chosen hashes: their places, by word, remembered as words come by."""

    def __init__(self, hashes: np.ndarray) -> None:
        super().__init__()
        self.place = {int(h): i for i, h in enumerate(hashes)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        own = {zlib.crc32(w) & _MASK for w in (word, *(word[:k] for k in STEMS))}
        found = self[word] = tuple(self.place[h] for h in own if h in self.place)
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        """The sorted places of a whole text: of those hashes that word_set has too."""
        if len(self) > REMEMBERED:
            self.clear()
        seen: set[bytes] = set()
        for words in alnum_words(text):
            seen.update(words)
        found: set[int] = set()
        for places in map(self.__getitem__, seen):
            found.update(places)
        return np.array(sorted(found), np.int64)


@dataclass
class Classifier:
    """Averaged linear classifiers: hashes weighed, their weights, and a bias that puts the cut at 0."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, places: np.ndarray) -> float:
        """The raw score of a text with these places: 0 is the cut."""
        return float(self.weights[places].sum() + self.bias)


def matrix(places: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of 0 and 1, with ones in the places given."""
    x = np.zeros((len(places), width), np.float32)
    x[np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate([np.zeros(0, np.int64), *places])] = 1
    return x


def _loss(z: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray]:
    """The logistic loss of scores z for a label, and its slope."""
    m = sign * z
    return np.logaddexp(0, -m), -sign / (1 + np.exp(np.clip(m, -50, 50)))


def _apart(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratios: shares a of n against one share for all, and shares b of m likewise."""
    both = (a * n + b * m) / (n + m)
    part = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(y, 1e-300)), 0)
    return 2 * (n * (part(a, both) + part(1 - a, 1 - both)) + m * (part(b, both) + part(1 - b, 1 - both)))


def _cut(positive: dict[int, int], unlabelled: dict[int, int], prior: float) -> float:
    """The cut with the least share of errors as the prior lets examples and unlabelled scores tell it.

    Both count raw scores in steps of STEP. Errors are prior * missed + (1 - prior) * false alarms, and the
    latter are what unlabelled text has above the cut beyond its toxic share. The middle of the gap below
    the best score is taken.
    """
    levels = np.array(sorted({*positive, *unlabelled}))
    above = lambda c: np.cumsum(np.array([c.get(int(k), 0) for k in levels], np.float64)[::-1])[::-1] / sum(c.values())
    hit, over = above(positive), above(unlabelled)
    best = int(np.argmin(np.round(prior * (1 - hit) + np.maximum(0, over - prior * hit), 9)))
    return STEP * (float(levels[best] + levels[best - 1]) / 2 if best else float(levels[0]))


def choose(hashes: np.ndarray, a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """The hashes to weigh, of those with counts a among n examples and b among m unlabelled texts."""
    often = np.flatnonzero((a >= LEAST) & (a / max(n, 1) > b / max(m, 1)))
    apart = _apart(a[often] / max(n, 1), n, b[often] / max(m, 1), m)
    best = np.lexsort((hashes[often], -apart))[:WORDS]
    return hashes[often[best[apart[best] >= APART]]]


def risk(w: np.ndarray, c: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray, float]:
    """The non-negative risk of weights w and bias c on rows p of examples and u of unlabelled texts, with its descent.

    Returns the risk and the slopes for w and c. Where the part for the negatives is below 0 the slopes
    are those that bring it back.
    """
    lp, gp = _loss(p @ w + c, 1)
    ln, gn = _loss(p @ w + c, -1)
    lu, gu = _loss(u @ w + c, -1)
    negative = lu.mean() - prior * ln.mean()
    if negative >= 0:
        dp, du = prior * (gp - gn) / len(p), gu / len(u)
    else:  # step back from the negative part alone
        dp, du = prior * gn / len(p), -gu / len(u)
    return prior * lp.mean() + max(0.0, negative), dp @ p + du @ u, dp.sum() + du.sum()


def fit(xp: np.ndarray, xu: np.ndarray, hashes: np.ndarray, prior: float, seed: int = 0) -> Classifier:
    """Minimise the non-negative risk on rows of examples and unlabelled texts, a column for each hash.

    Without examples, or a share of them, no text is toxic.
    """
    if not len(xp) or not len(xu) or not len(hashes) or not 0 < prior < 1:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), -10.0)
    total, total_bias = np.zeros(len(hashes)), 0.0
    for s in range(SEEDS):
        rng = np.random.default_rng(seed + s)
        w, c = np.zeros(len(hashes)), float(np.log(prior / (1 - prior)))
        m1, m2, steps = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1), 0
        for _ in range(EPOCHS):
            order_p, order_u = rng.permutation(len(xp)), rng.permutation(len(xu))
            batches = max(1, len(xu) // BATCH)
            for pick_p, pick_u in zip(np.array_split(order_p, batches), np.array_split(order_u, batches), strict=True):
                _, dw, dc = risk(w, c, xp[pick_p if len(pick_p) else order_p], xu[pick_u], prior)
                grad = np.append(dw + RIDGE * w, dc)
                steps += 1
                m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
                move = RATE * (1 - steps / (EPOCHS * batches + 1)) * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)
                w, c = w - move[:-1], c - move[-1]
        total, total_bias = total + w / SEEDS, total_bias + c / SEEDS
    return Classifier(hashes, total, total_bias)


@F.pandas_udf(BinaryType())
def _word_set(text: pd.Series) -> pd.Series:
    return pd.Series([word_set(t).tobytes() for t in text], dtype="object")


def _places(hashes: np.ndarray):
    """A UDF for the places of whole texts, as bytes."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        columns = Columns(hashes)
        for part in parts:
            yield pd.Series([columns.of(t).tobytes() for t in part], dtype="object")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, BinaryType())


def _counted(texts: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """In how many texts (binary column text) each hash is. A task sends one row of counts for each hash it met."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, n = Columns(hashes), np.zeros(len(hashes), np.int64)
        for pdf in frames:
            for t in pdf["text"]:
                n[columns.of(t)] += 1
        met = np.flatnonzero(n)
        yield pd.DataFrame({"place": met, "n": n[met]})

    total = np.zeros(len(hashes), np.int64)
    for r in texts.mapInPandas(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row a hash at most
        total[r.place] = r.n
    return total


def scored(model: Classifier, text: Column) -> Column:
    """The raw score of each whole text; null and empty texts get that of no words."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        columns = Columns(model.hashes)
        for part in parts:
            yield pd.Series([model.margin(columns.of(t)) for t in part], dtype="float64")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType()).asNondeterministic()(text.cast("binary"))


def _steps(scores: DataFrame) -> dict[int, int]:
    """How many raw scores (column z) lie in each step; a bounded number of rows."""
    z = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("z")))
    return {r.k: r.n for r in scores.groupBy(F.round(z / STEP).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Classifier, float, DataFrame]:
    """A classifier whose cut is still to be set, the prior, and the examples ((doc_id), which aren't held out).

    The prior is the share of toxic ones among the labels of the documents given. Examples and unlabelled
    texts for the gradient steps are bounded samples by hash.
    """
    known = learning_rows(labels, label, docs)
    prior = float(known.agg(F.avg("y")).first()[0] or 0.0)
    toxic = drawn(known.where("y = 1").select("doc_id"), positives, "doc_id")
    got = texts_of(toxic, docs, positives, _word_set).toPandas().sort_values(["doc_id", "x"])
    examples = [np.frombuffer(x, np.int32) for x in got["x"]]
    own = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("binary").alias("text"))
    n = np.bincount(np.concatenate([np.zeros(0, np.int32), *examples]), minlength=1 << BITS)
    hashes = np.flatnonzero(n >= LEAST)
    chosen = choose(hashes, n[hashes], len(examples), _counted(own, hashes), count(own)) if len(hashes) else hashes
    others = drawn(own.select("doc_id", F.xxhash64("text").alias("h"), _places(chosen)(F.col("text")).alias("x")), unlabelled, "doc_id", "h")
    others = [np.frombuffer(x, np.int64) for x in others.toPandas().sort_values(["doc_id", "h"])["x"]]
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    examples = [own[own >= 0] for own in (column[x] for x in examples)]
    return fit(matrix(examples, len(chosen)), matrix(others, len(chosen)), chosen, prior), prior, toxic


def calibrated(model: Classifier, prior: float, scores: DataFrame, toxic: DataFrame) -> Classifier:
    """The classifier with its cut where the scores (doc_id, z) of all documents that aren't held out put it."""
    own = scores.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    examples = _steps(own.join(F.broadcast(toxic), "doc_id", "left_semi"))
    return replace(model, bias=model.bias - _cut(examples, _steps(own), prior)) if examples and len(model.hashes) else model


def _judged(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs with __lm_score, 0 to 1: raw scores are written once, then the cut is set from them."""
    model, prior, toxic = train(docs, labels)
    raw = materialize(docs.select(*(F.col(f"`{c}`") for c in columns), scored(model, F.col("text")).alias("__lm_z")), "scores")
    final = calibrated(model, prior, raw.select("doc_id", F.col("__lm_z").alias("z")), toxic)
    z = F.greatest(F.lit(-500.0), F.col("__lm_z") + F.lit(final.bias - model.bias))
    return raw.withColumn("__lm_score", 1 / (1 + F.exp(-z))).drop("__lm_z")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, held_out, score (toxic), predicted (1 from cut on).

    Labels are learned only from rows that aren't held out and whose document is there. With no confirmed
    toxic example, or none but toxic ones, no text is toxic. Null and empty texts have the score of no words;
    repeated rows get the same score, an empty table none.
    """
    score = _judged(docs.select("doc_id", "text"), labels, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lm_score").alias("score"))
    return score.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs, all columns, without those that classify would predict 1.

    Nulls, empty texts, repeats and empty tables as there; columns of any name pass.
    """
    return _judged(docs, labels, docs.columns).where(F.col("__lm_score") < cut).select(*(F.col(f"`{c}`") for c in docs.columns))
