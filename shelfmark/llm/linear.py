"""Hashed linear text models: features of whole texts, bounded training samples, and scoring with one weight a word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import common

BUCKETS = 1 << 18
LONG = 40


def word_buckets(w: bytes) -> list[int]:
    """A word's features: itself, its first four to six bytes, its last five."""
    parts = {w, *(b"^" + w[:k] for k in (4, 5, 6) if len(w) > k), *([w[-5:] + b"$"] if len(w) > 5 else [])}
    return [xxh3_64_intdigest(x) % BUCKETS for x in parts]


def marked(text: str | None) -> list[bytes]:
    """Blank-separated chunks in lower case, with their marks: junk shows in them. Chunks over LONG bytes are followed by their
    overlapping four-character parts, one every two characters: texts without blanks count with all they hold."""
    out = []
    for c in text.lower().encode("utf-8", "surrogatepass").split() if text else []:
        out.append(c)
        if len(c) > LONG:
            t = c.decode("utf-8", "surrogatepass")
            out += [t[i : i + 4].encode("utf-8", "surrogatepass") for i in range(0, len(t) - 2, 2)]
    return out


#: A sampled document of more features than this is not learned from: the driver's memory is bounded by sample size times this.
MOST_FEATURES = 60_000


def first_ids(frame: DataFrame, most: int) -> list[int]:
    """Up to `most` different ids, the smallest by hash: a fixed sample."""
    return [r[0] for r in frame.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


class Sparse:
    """Rows of (bucket, value) pairs; without values, each is 1."""

    def __init__(self, ends: np.ndarray, idx: np.ndarray, val: np.ndarray | None = None):
        self.starts, self.ends, self.idx, self.val = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends, idx, val

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        n = self.ends[rows] - self.starts[rows]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rows], n)
        return row, self.idx[at], None if self.val is None else self.val[at]


def examples(docs: DataFrame, ids: dict[int, float], tokens: Callable, power: float | None) -> tuple[np.ndarray, Sparse]:
    """(targets, rows) of the documents whose ids are given, as many as the caller's bound; of rows that repeat an id, the one with the
    least text hash. Values are counts by the number of tokens to `power`; None: presence alone. Sampled texts of more than
    MOST_FEATURES features are left out. The driver holds the buckets once, as they come."""
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(k), float(v)) for k, v in ids.items()], "doc_id long, y double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, idx, val = [], [], []
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = tokens(text)
                held: Counter = Counter()
                for w, n in Counter(ws).items():
                    for k in word_buckets(w):
                        held[k] += n
                if len(held) > MOST_FEATURES:
                    continue
                ys.append(y)
                idx.append(np.fromiter(held.keys(), "<i4", len(held)).tobytes())
                val.append(b"" if power is None else (np.fromiter(held.values(), "<f4", len(held)) / max(1, len(ws)) ** power).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.float64()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["y", "i", "v"])

    rows = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"), F.first("y").alias("y"))
    found = rows.orderBy("doc_id").select("y", "r.text").mapInArrow(common.frugal(run), "y double, i binary, v binary").toArrow()

    def joined(name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], []
        for chunk in found.column(name).chunks:
            at = np.frombuffer(chunk.buffers()[1], "<i4")[chunk.offset : chunk.offset + len(chunk) + 1]
            data = np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]] if len(chunk) and chunk.buffers()[2] is not None else np.empty(0, np.uint8)
            parts.append(data.view(kind)), sizes.append(np.diff(at) // 4)
        return (np.concatenate(parts) if parts else np.empty(0, kind)), (np.concatenate(sizes) if sizes else np.empty(0, np.int64))

    idx, sizes = joined("i", "<i4")
    return found.column("y").to_numpy().astype(float), Sparse(np.cumsum(sizes).astype(np.int64), idx, None if power is None else joined("v", "<f4")[0])


class Adam:
    def __init__(self, n: int, rate: float):
        self.w, self.m, self.v, self.t, self.rate = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0, rate

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        self.w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class WordScore(dict):
    """word -> the sum of its features' weights."""

    def __init__(self, weights: np.ndarray, most: int = 120_000):
        self.weights, self.most = weights, most

    def __missing__(self, w: bytes) -> float:
        s = sum(float(self.weights[k]) for k in word_buckets(w))
        if len(self) < self.most and len(w) <= 2 * LONG:
            self[w] = s
        return s

    def score(self, ws: list[bytes], power: float) -> float:
        z = float(self.weights[-1]) + sum(map(self.__getitem__, ws)) / max(1, len(ws)) ** power
        return float(sigmoid(np.float64(z)))
