"""Nearest neighbours by inner product with a hash-prefix forest.

Every tree gives a vector a string of hash bits (random directions, thresholds at a bounded sample's medians); a tree is the
vectors sorted by their strings. A query descends to the longest prefix it shares and ascends in all trees at once: its depth is
the largest at which the trees' subtrees together hold at least `share` candidates for each vector of the index, and k + 1 for
each tree, so that k other entries are found wherever the index holds them. Vectors and queries then meet by (tree, prefix), a
subtree of many vectors in blocks, and the candidates are scored in double precision. To make the largest inner product the
nearest angle, vectors get one more component that brings them to the longest norm.

Equal vectors are one entry of the forest with their k + 1 smallest ids, which is all that any query can return of them: a
vector with very many copies costs no more than another. Vectors that are null, zero, hold null or non-finite components, or have
another dimension than the most common one take no part; so do rows with a null id. Rows that repeat id and vector count once; of queries
that repeat an id one is asked. A task holds a block of vectors and a block of queries of one subtree. Other columns are not read.
No queries or no candidates give an empty result.

The descent counts subtrees to COUNTED bits; a query that wants `share` candidates a vector stops long before (at 1.25 of them over
20 trees, after four bits), so the cut loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TREES, SHARE, K = 20, 1.25, 20
#: Bits of a string; the bits to which subtrees are counted (2 ** COUNTED numbers a tree); vectors of a block; vectors of the sample.
BITS, COUNTED, BLOCK, SAMPLE, SEED = 24, 12, 16_384, 4_096, 17


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, as bytes of doubles, with -0 as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not x or any(c is None for c in x):
                    continue
                v = np.asarray(x, np.float64) + 0.0
                if np.isfinite(v).all() and v.any():
                    ids.append(i), out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(common.frugal(run), "vec_id long, v binary")


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids): equal vectors as one, with their k + 1 smallest ids. Tasks send at most that many a vector and batch."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[bytes, set] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(v, set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(x)[: k + 1] for x in held.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    met = rows.mapInArrow(common.frugal(send), "v binary, ids array<long>").groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    return met.select(F.col("ids")[0].alias("rep"), "v", "ids")


class Forest:
    """Directions, thresholds and the longest norm: what strings are made with."""

    def __init__(self, sample: np.ndarray, norm: float, trees: int, seed: int = SEED):
        self.trees, self.norm = trees, norm
        self.r = np.random.default_rng(seed).standard_normal((sample.shape[1] + 1, trees * BITS))
        self.cut = np.zeros(trees * BITS)
        self.cut = np.median(self._raw(self.lifted(sample)), axis=0)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1, keepdims=True), 0))])

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.r

    def strings(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(vector, tree) strings of BITS bits. Queries are scaled to the longest norm and get 0 as their last component."""
        x = np.hstack([x * (self.norm / np.sqrt((x * x).sum(1, keepdims=True))), np.zeros((len(x), 1))]) if query else self.lifted(x)
        bits = (self._raw(x) > self.cut).reshape(len(x), self.trees, BITS)
        return (bits * (1 << np.arange(BITS - 1, -1, -1))).sum(2)


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _score(k: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data, asked = pdf[pdf.depth < 0].sort_values(["hash", "id"]), pdf[pdf.depth >= 0].sort_values(["hash", "id"])
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(data) or not len(asked):
            return empty
        make = lambda f: np.frombuffer(b"".join(f.v), np.float64).reshape(len(f), -1)
        x, h, ids, q_all = make(data), data.hash.to_numpy(), data.id.to_numpy(), make(asked)
        # two sums of the same products differ by less than this, in whatever order they are added
        slack = 4 * np.finfo(np.float64).eps * x.shape[1] * np.sqrt((q_all * q_all).sum(1)) * np.sqrt((x * x).sum(1).max())
        shift = BITS - asked.depth.to_numpy()
        low = asked.hash.to_numpy() >> shift << shift
        lo, hi = np.searchsorted(h, low), np.searchsorted(h, low + (1 << shift))
        out = []
        for a, z in sorted(set(zip(lo.tolist(), hi.tolist(), strict=True))):
            if a == z:
                continue
            here = np.flatnonzero((lo == a) & (hi == z))
            for at in range(0, len(here), 512):
                some = here[at : at + 512]
                s = q_all[some] @ x[a:z].T
                most = min(k + 1, z - a)  # one may be the query itself
                cut = np.partition(s, z - a - most, axis=1)[:, z - a - most]
                for row, q in enumerate(some.tolist()):
                    near = np.flatnonzero(s[row] >= cut[row] - slack[q])
                    score = (x[a + near] * q_all[q]).sum(1)
                    near = near[np.lexsort((ids[a + near], -score))[:most]]
                    out.append((np.full(len(near), asked.id.iloc[q]), ids[a + near], (x[a + near] * q_all[q]).sum(1)))
        return pd.DataFrame(dict(zip(("query_id", "rep", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else empty

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of vectors (vec_id, embedding) for each row of queries (the same
    columns), without the query's own id."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.octet_length("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    entries = common.spool(_entries(rows.filter(F.octet_length("v") == sizes[0]), k))
    asked = usable(queries).filter(F.octet_length("v") == sizes[0]).dropDuplicates(["vec_id"])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1)).max()) if len(x) else 0.0])], names=["n"])

    norm = entries.select("v").mapInArrow(common.frugal(norms), "n double").agg(F.max("n")).first()[0]
    sample = np.stack([np.frombuffer(bytes(r[0]), np.float64) for r in entries.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()])
    sent = spark.sparkContext.broadcast(Forest(sample, norm, trees))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((trees, 1 << COUNTED), np.int64)
        for b in batches:
            if b.num_rows:
                s = sent.value.strings(_matrix(b.column(0))) >> (BITS - COUNTED)
                for t in range(trees):
                    n[t] += np.bincount(s[:, t], minlength=1 << COUNTED)
        t, p = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(n[t, p])], names=["t", "p", "n"])

    counts = np.zeros((trees, 1 << COUNTED), np.int64)
    for t, p, n in entries.select("v").mapInArrow(common.frugal(counted), "t int, p int, n long").groupBy("t", "p").agg(F.sum("n")).collect():  # trees * 2 ** COUNTED at most
        counts[t, p] = n
    wanted = max(share * counts[0].sum(), trees * (k + 1))  # so many with repeats: one tree has k + 1 entries, or the query's depth is 0
    by_depth = [counts.reshape(trees, 1 << d, -1).sum(2) for d in range(COUNTED + 1)]
    tree_counts = spark.sparkContext.broadcast(by_depth)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, by = sent.value, tree_counts.value
        for b in batches:
            if not b.num_rows:
                continue
            s = f.strings(_matrix(b.column(1)), query=True)
            held = np.stack([sum(by[d][t, s[:, t] >> (BITS - d)] for t in range(trees)) for d in range(COUNTED + 1)])
            depth = np.where(held >= wanted, np.arange(COUNTED + 1)[:, None], 0).max(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(s), pa.list_(pa.int64())), pa.array(depth.astype(np.int32))], names=["id", "v", "strings", "depth"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(sent.value.strings(_matrix(b.column(1)))), pa.list_(pa.int64()))], names=["id", "v", "strings"])

    placed = common.spool(asked.select("vec_id", "v").mapInArrow(common.frugal(descend), "id long, v binary, strings array<long>, depth int"))
    top = placed.agg(F.min("depth")).first()[0]
    if top is None:
        return spark.createDataFrame([], result)
    # a subtree's blocks of vectors and of queries: rows of a table of trees * 2 ** top subtrees
    spread = lambda f: f.select("*", F.posexplode("strings").alias("t", "hash")).withColumn("p", F.shiftright("hash", BITS - top))
    many = {(r[0], r[1]): r[2] for r in spread(placed.select("strings")).groupBy("t", "p").count().collect()}
    sizes = [(t, p, max(1, math.ceil(n / BLOCK)), max(1, math.ceil(many.get((t, p), 0) / BLOCK))) for t in range(trees) for p, n in enumerate(by_depth[top][t].tolist())]
    blocks = F.broadcast(spark.createDataFrame(sizes, "t int, p long, blocks int, query_blocks int"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = spread(entries.select(F.col("rep").alias("id"), "v").mapInArrow(common.frugal(grown), "id long, v binary, strings array<long>")).join(blocks, ["t", "p"])
    data = data.withColumn("block", dealt("id", "blocks")).withColumn("asking", each("query_blocks"))
    query = spread(placed).join(blocks, ["t", "p"]).withColumn("asking", dealt("id", "query_blocks")).withColumn("block", each("blocks"))
    cols = ["t", "p", "block", "asking", "id", "hash", "v"]
    both = data.select(*cols, F.lit(-1).alias("depth")).union(query.select(*cols, "depth"))
    found = both.groupBy("t", "p", "block", "asking").applyInPandas(_score(k), "query_id long, rep long, score double")
    once = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    best = once.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))).filter(F.col("_r") <= k + 1)
    out = best.join(entries.select("rep", "ids"), "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
