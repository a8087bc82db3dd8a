"""Toxicity by cumulative-link ordinal regression on sparse words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import least_hashes, stored, text_or_empty

SAMPLE = 8_000  # labelled rows that are learned from, at most
PARTS = 8  # tasks that write the sample's word sets; each file written starts processes beside the executor's
FEATURES = 2048  # words with a weight, at most
LEAST_DOCS = 5  # labelled documents that hold a word, at least
LEAST_Z = 5.0  # how far a word's shares among toxic and other texts must differ, in standard errors
LEVELS = 3  # grades of toxic texts, one for each like part of their order
FOLDS = 5  # parts of the labelled rows, each ordered by a model of the others
STEPS = 400
PLAIN = 32  # bytes of the longest words that stand for themselves; a longer one is known by its digest

#: White space and ASCII punctuation part words; ASCII letters are lower-cased.
_PARTS = bytes.maketrans(bytes(range(65, 91)) + bytes(b for b in range(128) if not chr(b).isalnum()), bytes(range(97, 123)) + b" " * sum(not chr(b).isalnum() for b in range(128)))


def words(text: bytes) -> list[bytes]:
    return [w if len(w) <= PLAIN else hashlib.blake2b(w, digest_size=PLAIN).digest() for w in text.translate(_PARTS).split()]


@dataclass
class Model:
    """One weight a word and thresholds in rising order: P(grade > k) = logistic(sum of weights - threshold k)."""

    weights: dict[bytes, float]
    thresholds: np.ndarray
    cut: float = 0.5

    def margin(self, text: bytes) -> float:
        """The sum of weights over a text's distinct words, each counted once."""
        found = self.weights.keys() & set(words(text))
        return sum(self.weights[w] for w in sorted(found))

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, a row each."""
        return _logistic(np.asarray(margin)[:, None] - self.thresholds[None, :])

    def rejects(self, texts: list[bytes]) -> np.ndarray:
        """Whether P(grade > 0) reaches the cut, by text."""
        return self.above(np.array([self.margin(t) for t in texts], dtype=float))[:, 0] >= self.cut


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _climb(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, features: int, levels: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a cumulative-link model of ``grade`` in 0..levels, given each row's words (rows, cols).

    The likelihood, with an L1 share on the weights, is climbed with Adam steps
    over all rows; thresholds keep their order as sums of positive gaps.
    """
    w, base, gaps = np.zeros(features), 2.0, np.zeros(levels - 1)
    scale, n = 1 / len(grade), len(grade)
    state = [np.zeros(features + levels), np.zeros(features + levels)]
    for step in range(1, steps + 1):
        theta = base + np.r_[0, np.cumsum(np.log1p(np.exp(gaps)))]
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        x = np.bincount(rows, weights=w[cols], minlength=n)
        high, low = _logistic(edges[grade + 1] - x), _logistic(edges[grade] - x)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_x = (d_high - d_low) * scale  # of the negative log-likelihood
        g_theta = np.array([(d_low[grade == k + 1].sum() - d_high[grade == k].sum()) * scale for k in range(levels)])
        g_gaps = np.cumsum(g_theta[::-1])[::-1][1:] / (1 + np.exp(-gaps))
        g = np.concatenate((np.bincount(cols, weights=g_x[rows], minlength=features) + 1e-5 * np.sign(w), [g_theta.sum()], g_gaps))
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = 0.1 * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w, base, gaps = w - move[:features], base - move[features], gaps - move[features + 1 :]
    return w, base + np.r_[0, np.cumsum(np.log1p(np.exp(gaps)))]


def grades(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, features: int, steps: int = STEPS) -> np.ndarray:
    """Severity grades 0 to LEVELS of labelled rows: 0 for those not toxic, else by the order of what others say of a row.

    Labels only tell toxic from not. Each of FOLDS parts, in which both labels
    are dealt evenly, is ordered by a model of the other parts, so no row's own
    label or words set its place; like parts of that order are the grades of the
    toxic rows, ties in the lower one.
    """
    fold = np.zeros(len(toxic), dtype=np.int64)
    for label in (False, True):
        at = np.flatnonzero(toxic == label)
        fold[at] = np.arange(len(at)) % FOLDS
    place_of = np.zeros(len(toxic))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        place = np.full(len(toxic), -1)
        place[rest] = np.arange(len(rest))
        held = place[rows] >= 0
        w, _ = _climb(place[rows[held]], cols[held], toxic[rest].astype(int), features, 1, steps // 4)
        own = np.bincount(rows, weights=w[cols], minlength=len(toxic))
        at = np.flatnonzero((fold == k) & toxic)  # models differ in scale, so places within the part count
        place_of[at] = np.searchsorted(np.sort(own[at]), own[at], side="left") / max(1, len(at))
    return np.where(toxic, 1 + np.minimum((place_of * LEVELS).astype(int), LEVELS - 1), 0)


def fit_rows(names: list[bytes], rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, steps: int = STEPS) -> Model:
    """Fits weights shared by all thresholds, and the thresholds, to the rows' severity grades.

    ``rows`` and ``cols`` say which text holds which of ``names``. The cut on
    P(grade > 0) is the middle of the widest gap that separates the training
    labels best. Without both labels or telling words nothing is rejected.
    """
    if not names or toxic.all() or not toxic.any():
        return Model({}, 20.0 + np.arange(LEVELS))
    w, theta = _climb(rows, cols, grades(rows, cols, toxic, len(names), steps), len(names), LEVELS, steps)
    model = Model({n: float(v) for n, v in zip(names, w, strict=True)}, theta)
    model.cut = _cut(model.above(np.bincount(rows, weights=w[cols], minlength=len(toxic)))[:, 0], toxic)
    return model


def _cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The middle between the neighbouring probabilities that part the labels with fewest errors, the widest such gap."""
    values = np.unique(p)
    if len(values) < 2:
        return 0.5
    n1 = np.searchsorted(np.sort(p[toxic]), values[1:], side="left")
    n0 = (~toxic).sum() - np.searchsorted(np.sort(p[~toxic]), values[1:], side="left")
    wrong = n1 + n0
    best = np.flatnonzero(wrong == wrong.min())
    i = best[np.argmax(values[best + 1] - values[best])]
    return float((values[i] + values[i + 1]) / 2)


def labelled(docs: DataFrame, labels: DataFrame, sample: int, doc_id: str, text: str, toxic: str) -> DataFrame:
    """(doc_id, toxic boolean, body) of at most ``sample`` labelled ids, those of smallest hash; of rows that share one that of least text digest."""
    named = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    picked = least_hashes(named.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")), "doc_id", sample, "doc_id")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("body")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("body", F.sha2("body", 256)).alias("body"))


def word_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, words): the distinct words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted(set(words(x.as_py()))) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.binary()))], names=["doc_id", "toxic", "words"])

    return rows.mapInArrow(run, "doc_id long, toxic boolean, words array<binary>")


def telling_words(sets: DataFrame, toxic: int, other: int, limit: int = FEATURES) -> list[bytes]:
    """Words whose share among toxic and other texts differs most, by the z-score of the difference, counted on the executors."""
    n1, n0 = float(max(1, toxic)), float(max(1, other))
    counts = sets.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("toxic").alias("c1"), F.count_if(~F.col("toxic")).alias("c0"))
    pooled = (F.col("c1") + F.col("c0")) / (n0 + n1)
    z = F.abs(F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)
    kept = counts.where(F.col("c1") + F.col("c0") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") > LEAST_Z)
    return [bytes(r.word) for r in kept.orderBy(F.desc("z"), "word").limit(limit).collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", steps: int = STEPS) -> Model:
    """Learns from at most ``sample`` labelled documents, those of smallest hash of the id; ids and labels must not be null.

    Texts stay on the executors: their words are counted there, and the driver
    gets at most FEATURES words, and of each sampled text the numbers of those
    that it holds.
    """
    sets = stored(word_sets(labelled(docs, labels, sample, doc_id, text, toxic).coalesce(PARTS)), "word-sets")
    n = {r.toxic: r.n for r in sets.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = telling_words(sets, n.get(True, 0), n.get(False, 0))
    index = {w: i for i, w in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [sorted(index[w] for w in index.keys() & set(x.as_py())) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(held, pa.list_(pa.int32()))], names=["doc_id", "toxic", "held"])

    found = sets.mapInArrow(run, "doc_id long, toxic boolean, held array<int>").orderBy("doc_id").collect()
    rows = np.repeat(np.arange(len(found)), [len(r.held) for r in found]).astype(np.int64)
    cols = np.array([i for r in found for i in r.held], dtype=np.int64)
    return fit_rows(names, rows, cols, np.array([r.toxic for r in found], dtype=bool), steps)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) of every row.

    ``severity`` is the expected grade, the sum of P(grade > k); ``grade`` the
    likeliest one; ``toxic`` whether P(grade > 0) reaches the model's cut. Null
    and empty texts have no words and get the base rate. Each distinct word
    counts once in a text of any length. Repeated rows and null ids stay; an
    empty table gives an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = model.above(np.array([model.margin(x.as_py()) for x in b.column(1)], dtype=float))
            steps = np.concatenate((np.ones((len(b), 1)), above, np.zeros((len(b), 1))), axis=1)
            grade = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1).astype(np.int32)
            columns = [b.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade), pa.array(above[:, 0] >= model.cut)]
            yield pa.record_batch(columns, names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def rejected(model: Model, text: str = "text") -> Column:
    """Whether the model rejects a row's text, as a column; null counts as empty."""
    @F.pandas_udf("boolean")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series(model.rejects(list(bodies)) if len(bodies) else np.zeros(0, bool))

    return run(text_or_empty(text).cast("binary"))
