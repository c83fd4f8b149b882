"""Toxicity by non-negative positive-unlabelled learning.

Positives are the confirmed toxic rows of the training folds, unlabelled rows are documents of the training folds, whatever their
label. The risk is prior * E_P[loss(f, 1)] + max(0, E_U[loss(f, 0)] - prior * E_P[loss(f, 0)]) with the logistic loss; where the second
term falls below zero its gradient is turned round. f is linear in the presence of hashed words and parts of words; bias and weights are learned with an
absolute penalty on the weights that weakens with the number of positives, by accelerated proximal gradients over an active set that
grows until no weight outside it wants to move: every bucket of the training texts is in the program, none is picked by its labels
beforehand. The prior is the share of toxic rows among the training labels. Both samples are bounded (MOST_POSITIVE, MOST_UNLABELLED,
the smallest ids by hash; linear.MOST_FEATURES); every document is scored over its whole text.

Null and empty texts get the score of a text without words. Rows that repeat an id are scored one by one (one of them can be in the
sample); a null id is in no held-out fold. Labels that are null, or whose id is null, are not learned from. Without a positive label, or
without documents, every score is 0. A very long text is one row. Other columns are not read and pass through `clean`, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, linear

MOST_POSITIVE, MOST_UNLABELLED, CUT = 3_000, 6_000, 0.3
#: The penalty in standard errors of a weight's gradient; proximal steps of an active set; active sets; relative change that ends a set.
PENALTY, STEPS, SETS, CHANGE = 0.6, 300, 6, 1e-3


def words_once(text: str | None) -> list[bytes]:
    return list(set(common.word_list(text)))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Risk:
    """The risk's gradient by the scores z of rows, of which the first n_p are positives and the others unlabelled."""

    def __init__(self, n_p: int, n_u: int, prior: float):
        self.is_p, self.n_p, self.n_u, self.prior = np.arange(n_p + n_u) < n_p, n_p, n_u, prior
        self.share = np.where(self.is_p, prior / n_p, 1 / n_u)  # at most this much curvature, times a quarter

    def __call__(self, z: np.ndarray) -> np.ndarray:
        f, softplus = linear.sigmoid(z), np.logaddexp(0, z)
        negative = softplus[~self.is_p].mean() - self.prior * softplus[self.is_p].mean()
        d = np.where(self.is_p, -self.prior * f / self.n_p, f / self.n_u)
        return d - np.where(self.is_p, self.prior * (1 - f) / self.n_p, 0) if negative >= 0 else -d


def _proximal(row: np.ndarray, col: np.ndarray, w: np.ndarray, bias: float, risk: Risk, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias after accelerated proximal steps from the ones given."""
    n, k = len(risk.is_p), len(w)
    v = np.random.default_rng(0).random(k + 1)
    for _ in range(8):  # the largest curvature, by power iteration
        u = (np.bincount(row, v[col], n) + v[-1]) * risk.share * 0.25
        v = np.append(np.bincount(col, u[row], k), u.sum())
        top = float(np.linalg.norm(v))
        v /= top
    step, y, y_bias, t = 1 / top, w, bias, 1.0
    for _ in range(STEPS):
        d = risk(np.bincount(row, y[col], n) + y_bias)
        moved = y - step * np.bincount(col, d[row], k)
        moved, moved_bias = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), y_bias - step * float(d.sum())
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, y_bias = moved + (was - 1) / t * (moved - w), moved_bias + (was - 1) / t * (moved_bias - bias)
        change = np.abs(moved - w).max(initial=0) / max(1e-6, np.abs(moved).max(initial=0))
        w, bias = moved, moved_bias
        if change < CHANGE:
            break
    return w, bias


def fit(x: linear.Sparse, pos: np.ndarray, unl: np.ndarray, prior: float, buckets: int = linear.BUCKETS) -> np.ndarray:
    """Weights and a bias, from rows of x that are positives and rows that stand for all texts. Only the active buckets' places are held
    beside x; the others are passed over a few rows at a time."""
    rows = np.concatenate([pos, unl])
    risk, penalty = Risk(len(pos), len(unl), prior), PENALTY * prior / (2 * np.sqrt(len(pos)))
    w, bias, active = np.zeros(buckets), float(np.log(prior / (1 - prior))), np.zeros(buckets, bool)
    z = np.full(len(rows), bias)

    def parts() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for low in range(0, len(rows), 256):
            row, col, _ = x.take(rows[low : low + 256])
            yield low, row, col

    for _ in range(SETS):
        d, g = risk(z), np.zeros(buckets)
        for low, row, col in parts():
            g += np.bincount(col, d[low : low + 256][row], buckets)
        wanted = (np.abs(g) > penalty) | (w != 0)
        if not (wanted & ~active).any():
            break
        active |= wanted
        place = np.full(buckets, -1, np.int32)
        place[active] = np.arange(active.sum())
        held = [(row[m] + np.int32(low), place[col[m]]) for low, row, col in parts() for m in (place[col] >= 0,)]
        row, col = (np.concatenate(c) for c in zip(*held, strict=True))
        w[active], bias = _proximal(row, col, w[active], bias, risk, penalty)
        z = np.bincount(row, w[active][col], len(rows)) + bias
    return np.append(w, bias).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> np.ndarray | None:
    known = labels.select("doc_id", "toxic").filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return None
    positive = linear.first_ids(known.filter("toxic = 1").select("doc_id").distinct(), most_positive)
    unlabelled = linear.first_ids(docs.filter(~held_out()), most_unlabelled)
    # unlabelled rows stand for all texts: a positive that is drawn among them (2) is on both sides
    drawn = set(unlabelled)
    ids = dict.fromkeys(unlabelled, 0.0) | {i: 2.0 if i in drawn else 1.0 for i in positive}
    y, x = linear.examples(docs, ids, words_once, None)
    pos, unl = np.flatnonzero(y >= 1), np.flatnonzero(y != 1)
    if not len(pos) or not len(unl):
        return None
    return fit(x, pos, unl, min(0.9, max(0.001, toxic / n)))


class Scorer(dict):
    """word -> its buckets of non-zero weight, for up to `most` words of at most 80 bytes."""

    def __init__(self, weights: np.ndarray, most: int = 200_000):
        self.weights, self.most = weights, most
        self.bias = float(weights[-1])

    def __missing__(self, w: bytes) -> tuple[int, ...]:
        held = tuple(k for k in linear.word_buckets(w) if self.weights[k])
        if len(self) < self.most and len(w) <= 80:
            self[w] = held
        return held

    def __call__(self, text: str | None) -> float:
        held = set(chain.from_iterable(map(self.__getitem__, words_once(text))))
        return float(linear.sigmoid(np.float64(self.bias + sum(float(self.weights[k]) for k in sorted(held)))))


def _scores(weights) -> Callable[[Iterator], list[float]]:
    """Scores of texts under broadcast weights (None: 0)."""
    scorer = None if weights.value is None else Scorer(weights.value)
    return lambda texts: [0.0 if scorer is None else scorer(t) for t in texts]


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    schema = common.with_fields(docs.select("doc_id"), "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(sent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(common.values(b.column(1))), pa.float64())], names=schema.names)

    out = docs.select("doc_id", "text").mapInArrow(common.frugal(run), schema)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs below the cut, with their columns, whatever those are called."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(sent)
        for b in batches:
            yield b.filter(pa.array([s < cut for s in of(common.values(b.column(at)))], pa.bool_()))

    return docs.mapInArrow(common.frugal(run), docs.schema)
