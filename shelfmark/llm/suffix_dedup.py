"""Removal of repeated byte strings by difference-cover suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller id, or the same text, earlier start).

A suffix array of a whole corpus moves every suffix several times; only the first `length` bytes of a suffix matter here, so the
suffixes are dealt out first such that equal strings meet. Every string of `length` bytes has one anchor, the place of its
smallest hash of ANCHOR bytes: equal strings have equal anchors at equal places. Anchors that occur once in the corpus need no
more work. For the others, the bytes around an anchor that hold all strings it stands for go to the task that owns the anchor's
hash, where a difference-cover suffix array over them is built: triples at places 1 and 2 modulo 3 are sorted and named, the
names' suffixes are sorted by recursion, the remaining suffixes are sorted by their first character and the next one's rank, and
both orders are merged. Neighbours in the array with equal prefixes of `length` form the classes of equal strings; all but the
first of a class are removed. Surroundings that are the same in one task are sent once, so a text of many copies is no hot key.

Null and empty texts have no bytes. Rows that repeat both id and text are one place and get one result; a null id is the smallest.
A text is below 2**32 bytes (a longer one is an error) and is held whole by the task that reads it. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, ANCHOR = 100, 20
#: Characters of a suffix array that are gathered before it is built; a single anchor's surroundings may exceed it.
CHUNK = 1 << 20


def _ranked(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of keys from 1 by order, and how many there are."""
    order = np.argsort(key)
    k = key[order]
    new = np.empty(len(k), bool)
    new[:1] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    names = np.empty(len(k), np.int64)
    names[order] = np.cumsum(new)
    return names, int(names[order[-1]]) if len(k) else 0


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t (positive whole numbers below 2**31) in order, by the difference cover {1, 2} modulo 3."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate([t.astype(np.int64), np.zeros(3, np.int64)])
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    pair, _ = _ranked(s[sample] << 31 | s[sample + 1])
    names, many = _ranked(pair << 31 | s[sample + 2])
    if many < len(sample):
        order = suffix_array(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sample = sample[order]
    zero = zero[np.argsort(s[zero] << 31 | rank[zero + 1])]
    # the rest merges with each residue by keys that both have
    in_one, in_two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    less_one = np.searchsorted(s[in_one] << 31 | rank[in_one + 1], s[zero] << 31 | rank[zero + 1])
    pairs, _ = _ranked(np.concatenate([s[zero] << 31 | s[zero + 1], s[in_two] << 31 | s[in_two + 1]]))
    less_two = np.searchsorted(pairs[len(zero) :] << 31 | rank[in_two + 2], pairs[: len(zero)] << 31 | rank[zero + 2])
    total = len(zero) + len(sample)
    out, is_zero = np.empty(total, np.int64), np.zeros(total, bool)
    at = np.arange(len(zero)) + less_one + less_two
    is_zero[at] = True
    out[is_zero], out[~is_zero] = zero, sample
    return out[out < n]


class Grams:
    """Hashes of the ANCHOR-byte strings of a text: polynomial prefix sums modulo 2**64, mixed."""

    def __init__(self, size: int = ANCHOR):
        self.size, self.r = size, 0xD1342543DE82EF95
        self.inverse = pow(self.r, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            grow = lambda r: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, r, np.uint64)]), dtype=np.uint64)
            self.up, self.down = grow(np.uint64(self.r)), grow(np.uint64(self.inverse))

    def __call__(self, b: np.ndarray) -> np.ndarray:
        n = len(b)
        self._powers(n + 1)
        p = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=p[1:], dtype=np.uint64)
        return common.mix((p[self.size :] - p[: n - self.size + 1]) * self.down[: n - self.size + 1])


_PLACE = np.uint64((1 << 32) - 1)


def anchors(b: np.ndarray, grams: Grams, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last): the anchors of b and the starts of the strings that each stands for; equal hashes in one string
    go to the leftmost. Texts are below 2**32 bytes."""
    if len(b) < length:
        e = np.empty(0, np.int64)
        return e, np.empty(0, np.uint64), e, e
    if len(b) >= 1 << 32:
        raise ValueError("texts of 4 GB and more are not supported")
    h, w = grams(b), length - grams.size + 1
    low, reach = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while reach < w:  # minima over windows of w, by doubling
        step = min(reach, w - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    place = (low[first] & _PLACE).astype(np.int64)
    return place, h[place], first, np.concatenate([first[1:], [len(low)]]) - 1


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _repeats(docs: DataFrame, length: int, held: int = 1_500_000) -> DataFrame:
    """(_row, at): the anchors whose hash occurs more than once. Repeats within a task are known there: it sends one witness of each
    hash, so that no hash has more rows in a task than there are sending tasks' batches."""
    schema = "key long, h long, _row long, at long, known boolean"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, at, hs, n = Grams(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            r, p, h = np.concatenate(rows), np.concatenate(at), np.concatenate(hs).view(np.int64)
            order = np.argsort(h, kind="stable")
            r, p, h = r[order], p[order], h[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            known = ~(new & np.concatenate([new[1:], [True]]))
            witness = new & known
            key = np.where(known, r + p, h)
            none = np.full(int(witness.sum()), -1, np.int64)
            cat = lambda x, y: pa.array(np.concatenate([x, y]))
            return pa.RecordBatch.from_arrays([cat(key, h[witness]), cat(h, h[witness]), cat(r, none), cat(p, none), cat(known, np.zeros(len(none), bool))], names=["key", "h", "_row", "at", "known"])

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place, h, _, _ = anchors(_bytes(text), grams, length)
                rows.append(np.full(len(place), row, np.int64)), at.append(place), hs.append(h)
                n += len(place)
            if n > held:
                yield flush()
                rows, at, hs, n = [], [], [], 0
        if n:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, r, p = [], [], []
        for b in batches:
            known = b.column(4).to_numpy(zero_copy_only=False)
            cols = [b.column(i).to_numpy() for i in (1, 2, 3)]
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in cols[1:]], names=["_row", "at"])
            for out, c in zip((h, r, p), cols, strict=True):
                out.append(c[~known])
        if h:
            h, r, p = np.concatenate(h), np.concatenate(r), np.concatenate(p)
            order = np.argsort(h)
            h, r, p = h[order], r[order], p[order]
            same = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.empty(0, bool)
            again = (same | np.concatenate([same[1:], [False]])) & (p >= 0) if len(h) else same
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array(r[again]), pa.array(p[again])], names=["_row", "at"])

    dealt = docs.select("_row", "text").mapInArrow(common.frugal(send), schema)
    return dealt.repartition("key").mapInArrow(common.frugal(meet), "_row long, at long")


def _surroundings(found: DataFrame, length: int) -> DataFrame:
    """found: (_row, _order, text, at). -> the bytes around each repeated anchor; later copies within a batch are spans at once (h null)."""
    schema = "h long, _row long, _order long, first long, last long, ctx binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            seen: dict[bytes, tuple] = {}
            hs, rows, orders, first, last, ctx = [], [], [], [], [], []
            for row, order, text, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = _bytes(text)
                place, h, lo, hi = anchors(raw, grams, length)
                raw = raw.tobytes()
                for i in np.flatnonzero(np.isin(place, np.asarray(at, np.int64))).tolist():
                    f, e = int(lo[i]), int(hi[i]) + length
                    c, me = raw[f:e], (order, row, f)
                    was = seen.get(c)
                    if was is None:
                        seen[c] = (me, int(h[i].view(np.int64)))
                        continue
                    if me < was[0]:
                        seen[c], me = (me, was[1]), was[0]
                    if me != seen[c][0]:
                        hs.append(None), rows.append(me[1]), orders.append(me[0]), first.append(me[2]), last.append(me[2] + e - f), ctx.append(None)
            for c, (me, h) in seen.items():
                hs.append(h), rows.append(me[1]), orders.append(me[0]), first.append(me[2]), last.append(me[2] + len(c)), ctx.append(c)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (hs, rows, orders, first, last)), pa.array(ctx, pa.binary())], names=["h", "_row", "_order", "first", "last", "ctx"])

    return found.mapInArrow(common.frugal(run), schema)


def _runs(start: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Sorted starts of strings of `length` as merged runs."""
    cut = np.flatnonzero(np.diff(start) > length) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(start, cut)] if len(start) else []


def _later(texts: list[bytes], places: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, int, int]]:
    """(row, order, first, last) of what occurs in an earlier place. texts start at places (order, row, start), no two are equal."""
    sizes = np.array([len(x) for x in texts])
    t = np.full(int(sizes.sum()) + len(texts), 257, np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    for x, at in zip(texts, begin.tolist(), strict=True):
        t[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) + 1
    sa = suffix_array(t)
    whose = np.repeat(np.arange(len(texts)), sizes + 1)
    sa = sa[sa - begin[whose[sa]] <= sizes[whose[sa]] - length]
    text = np.lib.stride_tricks.sliding_window_view(t.astype(np.int16), length)
    same = np.zeros(len(sa), bool)
    for i in range(1, len(sa), 50_000):
        rows = text[sa[i - 1 : i + 50_000]]
        same[i : i + len(rows) - 1] = (rows[1:] == rows[:-1]).all(1)
    cls, owner = np.cumsum(~same), whose[sa]
    order, row, start = (np.array(x, np.int64) for x in zip(*places, strict=True))
    at = start[owner] + sa - begin[owner]
    by = np.lexsort((at, row[owner], order[owner], cls))
    later = np.concatenate([[False], cls[by][1:] == cls[by][:-1]]) if len(by) else np.empty(0, bool)
    owner, at = owner[by][later], at[by][later]
    out = []
    by = np.lexsort((at, owner))
    owner, at = owner[by], at[by]
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1) if len(owner) else []:
        out += [(int(row[owner[part[0]]]), int(order[owner[part[0]]]), a, z) for a, z in _runs(at[part], length)]
    return out


def _resolved(sent: DataFrame, length: int) -> DataFrame:
    """The spans that occur earlier, from surroundings sorted by h within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, places, spans, group, now, size = [], [], [], {}, None, 0

        def close() -> None:
            nonlocal size
            if len(group) > 1:
                texts.extend(group), places.extend(group.values())
                size += sum(map(len, group))
            group.clear()

        def batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((), (), (), ()))], names=["_row", "_order", "first", "last"])

        for b in batches:
            for h, row, order, first, last, ctx in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h is None:
                    spans.append((row, order, first, last))
                    continue
                if h != now:
                    close()
                    now = h
                    if size > CHUNK:
                        spans += _later(texts, places, length)
                        texts, places, size = [], [], 0
                me = (order, row, first)
                was = group.get(ctx)
                if was is None or me < was:
                    group[ctx], me = me, was
                if me is not None and me != group[ctx]:
                    spans.append((me[1], me[0], me[2], me[2] + len(ctx)))
            yield batch(spans)
            spans = []
        close()
        if texts:
            spans += _later(texts, places, length)
        yield batch(spans)

    return sent.mapInArrow(common.frugal(run), "_row long, _order long, first long, last long")


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), a row for each row of docs."""
    keyed = docs.select("doc_id", "text").withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("_order", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    again = common.spool(_repeats(keyed.select("_row", "text"), length).groupBy("_row").agg(F.collect_set("at").alias("at")))
    sent = _surroundings(keyed.join(again, "_row").select("_row", "_order", "text", "at"), length)
    spans = _resolved(sent.repartition(F.coalesce("h", F.col("_row") + F.col("first"))).sortWithinPartitions("h"), length)
    spans = common.spool(spans.groupBy("_row", "_order").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    schema = common.with_fields(docs.select("doc_id"), "n_bytes long, n_removed long, n_spans long, kept binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, runs, kept = [], [], [], []
            for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, parts, count, end = (text or "").encode("utf-8", "surrogatepass"), [], 0, -1
                for m in sorted(marks or [], key=lambda x: (x["first"], x["last"])):
                    if m["first"] > end:  # a run of its own
                        parts.append(raw[max(end, 0) : m["first"]])
                        count += 1
                    end = max(end, m["last"])
                parts.append(raw[max(end, 0) :])
                kept.append(b"".join(parts))
                n.append(len(raw)), gone.append(len(raw) - len(kept[-1])), runs.append(count)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept, pa.binary())], names=schema.names)

    return keyed.join(spans, ["_row", "_order"], "left").select("doc_id", "text", "spans").mapInArrow(common.frugal(cut), schema)


#: The same by brute force: the hash of every string of 100 bytes at its place.
SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
g AS (SELECT doc_id, unnest(generate_series(1, n - 99)) AS i, b FROM n WHERE n >= 100),
s AS (SELECT doc_id, i, md5_number(b[i:i + 99]) AS h FROM g),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f),
r AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
z AS (SELECT doc_id, k, min(i) AS a, max(i) + 99 AS z FROM r GROUP BY ALL),
l AS (SELECT doc_id, list({'a': a, 'z': z} ORDER BY a) AS l, count(*) AS spans, sum(z - a + 1) AS gone FROM z GROUP BY doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN l IS NULL THEN b ELSE list_reduce(list_prepend(''::BLOB, list_transform(range(0, len(l) + 1), lambda k: b[(CASE WHEN k = 0 THEN 1 ELSE l[k].z + 1 END):(CASE WHEN k = len(l) THEN n ELSE l[k + 1].a - 1 END)])), lambda x, y: x || y) END) AS kept_sha256
FROM n LEFT JOIN l USING (doc_id)
"""
