"""Benchmark decontamination by a prefix-filtered containment join.

A window is `width` consecutive words of an item (all of a shorter item). A window that occurs in a document holds all its
shingles there, so one necessary shingle is enough as its prefix: the one that is rarest over all documents. A first pass counts
the items' shingles in the documents; a second one finds the prefixes in each document and sends each with its place and the words
around it. They are joined with the windows that have this prefix by a shuffle (a prefix that very many documents hold, by
broadcast: common.lookup's bound), the window is placed around the hit (positional bound), windows that would not fit go (length
bound), and the words of the others are compared.

Windows, counts and prefixes are tables; what reaches the driver or all tasks is a filter of fixed size, which lets shingles pass
that may be an item's. A benchmark too large for it costs a larger join and loses nothing.

Null and empty texts have no words; items without words have no windows; a null item_id counts as an item named "" only if it has
windows. Rows that repeat an id are judged one by one (rows that repeat id and text alike), items that repeat an id count once.
A very long text is read as one row, its hits are rows of their own. Other columns are not read and pass through `clean`, whatever
their names. Without documents the result is empty, without items no document has hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WIDTH, SHINGLE, BITS = 13, 5, 1 << 23
#: Rows of prefixes that very many documents hold, to be broadcast at most; beyond them all is joined by shuffle.
MOST_HOT = 50_000


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(item, w): the windows of items, words joined by blanks; a row for each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = common.word_list(text)
                n = max(1, len(ws) - width + 1) if ws else 0
                for at in range(0, n, 4096):  # a long item's windows leave in parts
                    part = [b" ".join(ws[i : i + width]).decode("utf-8", "surrogatepass") for i in range(at, min(n, at + 4096))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.string())], names=["item", "w"])

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(common.frugal(run), "item string, w string").distinct()


def _keyed(windows: DataFrame, shingle: int) -> DataFrame:
    """(w, m, k, s, at): each window's shingle hashes s, of k words, with their places, and its number of words m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = common.WordHash()
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                w, m, k, s, at = [], [], [], [], []
                for text in b.column(0).slice(lo, 2048).to_pylist():
                    ws = text.encode("utf-8", "surrogatepass").split(b" ")
                    size = min(shingle, len(ws))
                    found = common.shingles(hashing.array(ws), size)
                    w += [text] * len(found)
                    m += [len(ws)] * len(found)
                    k += [size] * len(found)
                    s.append(found.view(np.int64)), at.append(np.arange(len(found), dtype=np.int32))
                cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0, t))
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(m, pa.int32()), pa.array(k, pa.int32()), cat(s, np.int64), cat(at, np.int32)], names=["w", "m", "k", "s", "at"])

    return windows.select("w").distinct().mapInArrow(common.frugal(run), "w string, m int, k int, s long, at int")


class _Found:
    """Places of a text's shingles that pass the filter."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes, self.hashing = bits, sizes, common.WordHash()

    def __call__(self, ws: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        h = self.hashing.array(ws)
        for k in self.sizes:
            s = common.shingles(h, k)
            at = np.flatnonzero(common.passes(self.bits, s))
            if len(at):
                yield k, at, s[at].view(np.int64)


def _counts(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(k, s, n): how often shingles that pass the filter occur over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Found(sent.value, sizes)
        for b in batches:
            held: dict[int, list] = {}
            for text in common.values(b.column(0)):
                for k, _, s in find(common.word_list(text)):
                    held.setdefault(k, []).append(s)
            for k, parts in held.items():
                s, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(s), pa.array(n.astype(np.int64))], names=["k", "s", "n"])

    return docs.select("text").mapInArrow(common.frugal(run), "k int, s long, n long").groupBy("k", "s").agg(F.sum("n").alias("n"))


def _read(docs: DataFrame, bits: np.ndarray, sizes: list[int], width: int) -> DataFrame:
    """(_r1, _r2, n_words, k, s, pos, low, near): a row with k null for each row of docs, and one for each shingle that passes the
    filter, at word pos, with the words around it, of which the first is word `low`."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    schema = "_r1 long, _r2 long, n_words long, k int, s long, pos long, low long, near string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Found(sent.value, sizes)
        for b in batches:
            rows: list[tuple] = []
            r1, r2 = (b.column(i).to_pylist() for i in (0, 1))
            pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
            for i, text in enumerate(common.values(b.column(2))):
                ws = common.word_list(text)
                rows.append((r1[i], r2[i], len(ws), None, None, None, None, None))
                for k, at, s in find(ws):
                    for p, x in zip(at.tolist(), s.tolist(), strict=True):
                        low = max(0, p - width + 1)
                        rows.append((r1[i], r2[i], len(ws), k, x, p, low, b" ".join(ws[low : p + width]).decode("utf-8", "surrogatepass")))
                        if len(rows) > 8192:
                            yield pack()
                            rows = []
            if rows:
                yield pack()

    fields = pa.schema([("_r1", pa.int64()), ("_r2", pa.int64()), ("n_words", pa.int64()), ("k", pa.int32()), ("s", pa.int64()), ("pos", pa.int64()), ("low", pa.int64()), ("near", pa.string())])
    return docs.select(*_row_key("doc_id", "text"), "text").mapInArrow(common.frugal(run), schema)


def _row_key(doc_id: str, text: str) -> list:
    """128 bits that a row goes by: rows that agree in them are copies and get one result."""
    return [F.xxhash64(doc_id, text).alias("_r1"), F.xxhash64(F.lit(1), doc_id, text).alias("_r2")]


def _judged(docs: DataFrame, items: DataFrame, width: int, shingle: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(read: n_words of each row; covered: n_hit of each row key with hits; held: row keys with the items whose windows they hold)."""
    windows = common.spool(_windows(items, width))
    keyed = common.spool(_keyed(windows, shingle))
    sizes = sorted(r[0] for r in keyed.select("k").distinct().collect())  # `shingle` at most
    counts = common.spool(_counts(docs, common.bit_filter(keyed, "s", bits), sizes))
    best = keyed.join(counts, ["k", "s"], "left").groupBy("w").agg(F.min(F.struct("n", "at", "k", "s", "m")).alias("p"), F.count("n").alias("found"), F.count("*").alias("parts"))
    # a window of a shingle that no text has cannot occur
    prefix = common.spool(best.filter("found = parts").select("w", "p.n", "p.at", "p.k", "p.s", "p.m"))
    read = common.spool(_read(docs, common.bit_filter(prefix, "s", bits), sizes, width))
    found = read.filter("k IS NOT NULL")
    total = found.count()
    cut = max(total // 1000, 1000)
    hot = prefix.filter(F.col("n") > cut).limit(MOST_HOT + 1).collect() if total > cut else []
    if 0 < len(hot) <= MOST_HOT:
        few = docs.sparkSession.createDataFrame(hot, prefix.schema)
        keys = few.select("k", "s").distinct()
        met = found.join(F.broadcast(keys), ["k", "s"], "left_anti").join(prefix, ["k", "s"]).unionByName(found.join(F.broadcast(few), ["k", "s"]))
    else:
        met = found.join(prefix, ["k", "s"])
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("m") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("near", " "), (start - F.col("low") + 1).cast("int"), F.col("m")), " ") == F.col("w")
    hits = common.spool(met.filter(fits).filter(same).select("_r1", "_r2", start.alias("start"), (start + F.col("m")).alias("end"), "w").distinct())
    before = F.max("end").over(Window.partitionBy("_r1", "_r2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("_r1", "_r2", "start", "end").distinct().withColumn("gain", F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0)))
    covered = spans.groupBy("_r1", "_r2").agg(F.sum("gain").alias("n_hit"))
    held = hits.select("_r1", "_r2", "w").distinct().join(windows, "w").groupBy("_r1", "_r2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return read.filter("k IS NULL"), covered, held


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), one row per row of docs."""
    read, covered, held = _judged(docs, items, width, shingle, bits)
    words = read.groupBy("_r1", "_r2").agg(F.first("n_words").alias("n_words"))
    known = words.join(covered, ["_r1", "_r2"], "left").join(held, ["_r1", "_r2"], "left")
    rows = docs.select("doc_id", *_row_key("doc_id", "text")).join(known, ["_r1", "_r2"])
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_hit: str, n_words: str):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    read, covered, _ = _judged(docs, items, width, shingle, bits)
    gone = read.select("_r1", "_r2", "n_words").distinct().join(covered, ["_r1", "_r2"]).filter(is_contaminated("n_hit", "n_words")).select("_r1", "_r2")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"), *_row_key("doc_id", "text"))
    return rows.join(common.spool(gone), ["_r1", "_r2"], "left_anti").select("_whole.*")
