"""Quality by weak labels: overlapping heuristics, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad or nothing on a whole text. Votes of all documents are counted by pattern (3 to the power of the
labellers, a fixed number), so expectation-maximisation on the driver sees every document and no text. Posteriors of a bounded
sample (MOST, the smallest ids by hash) are the soft targets of a linear model over hashed chunks, which then scores every text.

Null and empty texts are bad: every labeller that looks for words says so. Rows that repeat an id are scored one by one (one of
them can be in the sample); a null id is scored and not sampled. A very long text counts whole; one of more features than
linear.MOST_FEATURES is scored and not sampled. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, linear

MOST, CUT, POWER = 4_000, 0.5, 0.5
EPOCHS, BATCH, RATE, SEED, ROUNDS = 12, 256, 0.05, 5, 60
_MARK = re.compile(r"[#$%&*]{2,}")
_END = (".", "!", "?", ":", '"', "»", "”")

LABELLERS = ("marks", "length", "distinct_words", "repeated_lines", "sentence_ends", "word_length", "letters")


def votes(text: str | None) -> tuple[int, ...]:
    """1 good, -1 bad, 0 nothing, by LABELLERS."""
    text = text or ""
    ws = text.split()
    n, lines = len(ws), [x for x in text.split("\n") if x.strip()]
    if not n:
        return (0, -1, 0, 0, -1, -1, -1)
    marks = sum(1 for _ in _MARK.finditer(text)) / n
    distinct = len(set(ws)) / n
    same = 1 - len(set(lines)) / len(lines)
    ends = sum(x.rstrip().endswith(_END) for x in lines) / len(lines)
    mean = (len(text) - n) / n
    letters = sum(map(str.isalpha, text)) / len(text)
    pick = lambda x, bad, good: -1 if bad(x) else 1 if good(x) else 0
    return (
        pick(marks, lambda x: x > 0.1, lambda x: x < 0.01),
        pick(n, lambda x: x < 5, lambda x: x >= 20),
        pick(distinct, lambda x: n > 30 and x < 0.12, lambda x: n <= 30 or x > 0.25),
        pick(same, lambda x: x > 0.3, lambda x: x < 0.1),
        pick(ends, lambda x: x < 0.2, lambda x: x > 0.7),
        pick(mean, lambda x: x < 2 or x > 14, lambda x: 3 <= x <= 10),
        pick(letters, lambda x: x < 0.55, lambda x: x > 0.72),
    )


def _code(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def expectation_maximisation(count: dict[int, int], k: int = len(LABELLERS), rounds: int = ROUNDS) -> dict[int, float]:
    """Pattern -> posterior of good. Labellers are independent given the class; each has its own vote rates in each class."""
    code = np.array(sorted(count), np.int64)
    n = np.array([count[c] for c in code], float)
    v = (code[:, None] // 3 ** np.arange(k)) % 3
    q = np.clip(0.7 + 0.3 * ((v == 2).sum(1) - 2 * (v == 0).sum(1)) / k, 0.05, 0.95)  # a majority to start from
    for _ in range(rounds):
        side = np.stack([1 - q, q]) * n
        rate = np.stack([[(side * (v[:, i] == x)).sum(1) + 0.5 for x in range(3)] for i in range(k)])  # labeller, vote, class
        rate /= rate.sum(1, keepdims=True)
        prior = np.clip(side.sum(1) / side.sum(), 0.01, 0.99)
        z = np.log(prior)[:, None] + sum(np.log(rate[i][v[:, i]]).T for i in range(k))
        q = linear.sigmoid(z[1] - z[0])
    return dict(zip(code.tolist(), q.tolist(), strict=True))


def _voted(docs: DataFrame) -> DataFrame:
    schema = common.with_fields(docs.select("doc_id"), "code int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_code(votes(t)) for t in common.values(b.column(1))], pa.int32())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(common.frugal(run), schema)


def fit(y: np.ndarray, x: linear.Sparse, buckets: int = linear.BUCKETS) -> np.ndarray:
    rng, opt, order = np.random.default_rng(SEED), linear.Adam(buckets, RATE), np.arange(len(y))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for rows in np.array_split(order, max(1, len(order) // BATCH)):
            row, idx, val = x.take(rows)
            d = (linear.sigmoid(np.bincount(row, opt.w[idx] * val, len(rows)) + opt.w[-1]) - y[rows]) / len(rows)
            g = np.bincount(idx, d[row] * val, buckets + 1)
            g[-1] = d.sum()
            opt.step(g + 1e-5 * opt.w)
    return opt.w.astype(np.float32)


def scored(docs: DataFrame, most: int = MOST, cut: float = CUT) -> DataFrame:
    """doc_id, posterior, score, keep, a row for each row of docs."""
    spark = docs.sparkSession
    voted = common.spool(_voted(docs))
    posterior = expectation_maximisation({r[0]: r[1] for r in voted.groupBy("code").count().collect()}) if voted.take(1) else {}
    ids = linear.first_ids(voted, most)
    chosen = voted.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "doc_id long")), "doc_id").groupBy("doc_id").agg(F.min("code").alias("code")).collect()
    y, x = linear.examples(docs, {r["doc_id"]: posterior[r["code"]] for r in chosen}, linear.marked, POWER)
    sent = spark.sparkContext.broadcast((fit(y, x), posterior))
    schema = common.with_fields(docs.select("doc_id"), "posterior double, score double, keep boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, q = sent.value
        scorer = linear.WordScore(weights)
        for b in batches:
            texts = b.column(1).to_pylist()
            s = [scorer.score(linear.marked(t), POWER) for t in texts]
            p = [q[_code(votes(t))] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array([x >= cut for x in s])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(common.frugal(run), schema)
