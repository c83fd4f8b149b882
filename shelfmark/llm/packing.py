"""Best-fit packing by a configuration linear program over the length histogram.

The driver sees the histogram alone (at most `capacity` rows, whatever the input). The program asks for pattern counts (a pattern is a
multiset of lengths that fit a sequence) that cover each length's pieces with as few sequences as can be. Prices start at the lengths,
which is feasible for the dual and gives the first lower bound; patterns come from knapsack dynamic programming over the prices, and a
length's price falls by a factor for each share of its pieces that is covered, so that lengths left behind are dearer (multiplicative
weights). Counts are fractions that together cover every length exactly. They are rounded down, what one loses going on to the next like it,
and what is left goes best fit, largest first, over the same histogram; plain best fit takes over where it needs fewer sequences.
Pieces then find their place by their rank among the pieces of their length: no task ever holds a sequence's or a length's pieces as a
group.

Null and empty texts are documents of the one closing id. Rows that repeat an id are packed as documents of their own; rows that are
equal in all that is kept get places of their own too, in any order. A very long text is cut into pieces in one task, which sends them
in parts of bounded size. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: How fast a price falls with coverage; the share of what a pattern could take that it takes at once; patterns between two pricings.
RATE, SHARE, BATCH = 0.5, 0.125, 200
#: Patterns of less fill are taken only after all others, and then by steps of this size from it to none.
FILL, STEP = 0.985, 0.05


class _Ids(dict):
    """Blank-separated chunk -> its ids as little-endian 32-bit bytes. Chunks never share a token, as the tokenizer drops white space."""

    def __init__(self, path: str, most: int = 450_000):
        from tokenizers import Tokenizer

        self.t, self.most = Tokenizer.from_file(path), most
        self.t.encode_special_tokens = False

    def encode(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _kept(self, chunk: str, ids: bytes) -> bytes:
        if len(self) < self.most and len(chunk) < 80:
            self[chunk] = ids
        return ids

    def core(self, word: str) -> bytes:
        """Ids of a run of ASCII letters, already lowered: one pre-token."""
        ids = self.get(word)
        return self._kept(word, np.array([x.id for x in self.t.model.tokenize(word)], "<u4").tobytes()) if ids is None else ids

    def __missing__(self, chunk: str) -> bytes:
        head = chunk.rstrip(".,;:!?#$%&*")
        if not (head.isascii() and head.isalpha()):
            return self._kept(chunk, self.encode(chunk))
        word, tail = head.lower(), chunk[len(head) :]
        ids = self.core(word)
        if tail:
            end = self.get(tail)
            ids += self._kept(tail, self.encode(tail)) if end is None else end
        return ids if word == chunk else self._kept(chunk, ids)

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit): documents with their closing id, cut at capacity."""
    schema = common.with_fields(docs.select("doc_id"), "piece int, start long, length long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, step = _Ids(tokenizer), int(end_id).to_bytes(4, "little"), 4 * capacity
        for b in batches:
            who, piece, start, length, out, held = [], [], [], [], [], 0
            for row, text in enumerate(common.values(b.column(1))):
                whole = ids.text(text) + end
                for k, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    who.append(row), piece.append(k), start.append(at // 4), length.append(len(part) // 4), out.append(part)
                    held += len(part)
                if held > 8 << 20 or row == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())],
                        names=schema.names,
                    )
                    who, piece, start, length, out, held = [], [], [], [], [], 0

    return docs.select("doc_id", "text").mapInArrow(common.frugal(run), schema)


def price(y: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over prices y[length]: the best price of each room, and the length chosen there (0: left free)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        offer = y[c:0:-1] + best[:c]  # length c first, so that ties go to the longer
        j = int(offer.argmax())
        if offer[j] > best[c - 1]:
            best[c], took[c] = offer[j], c - j
        else:
            best[c] = best[c - 1]
    return best, took


Pattern = tuple[tuple[int, int], ...]
#: Less than this of a piece counts as nothing left.
LEAST = 1e-6


class Program:
    """The covering program over a histogram: pattern counts x, the pieces not covered yet, and a lower bound on any packing."""

    def __init__(self, count: np.ndarray, capacity: int):
        self.capacity, self.demand, self.left = capacity, count.astype(float), count.astype(float)
        self.weight, self.x = np.ones(capacity + 1), {}
        self.bound = self._dual_bound()

    def _dual_bound(self) -> float:
        """The dual value of the prices at hand, scaled so that no pattern costs more than 1."""
        lengths = np.flatnonzero(self.demand)
        y = np.full(self.capacity + 1, -np.inf)
        y[lengths] = lengths * self.weight[lengths]
        return float((self.demand[lengths] * y[lengths]).sum() / price(y, self.capacity)[0][self.capacity]) if len(lengths) else 0.0

    def _pattern(self, lead: int, best: np.ndarray, took: np.ndarray) -> dict[int, int]:
        """The best filling of what `lead` leaves free, of lengths that are left; no more of a length than there are pieces."""
        parts, room = {lead: 1}, self.capacity - lead
        while room > 0 and best[room] > 0:
            k = int(took[room])
            if k and self.left[k] > LEAST and self.demand[k] >= parts.get(k, 0) + 1:
                parts[k] = parts.get(k, 0) + 1
                room -= k
            else:
                room -= 1
        return parts

    def solve(self, fill: float) -> None:
        """Covers until no pattern of at least this fill is found. Counts are fractions: a step is a share of what the scarcest length of a pattern
        has left, or all of it where that is less than a sequence."""
        need = 1.0
        while len(live := np.flatnonzero(self.left > LEAST)):
            y = np.full(self.capacity + 1, -np.inf)
            y[live] = live * self.weight[live]
            best, took = price(y, self.capacity)
            made = 0
            for lead in live[::-1].tolist():
                if self.left[lead] <= LEAST:
                    continue
                parts = self._pattern(lead, best, took)
                if sum(k * c for k, c in parts.items()) < need * self.capacity:
                    continue
                most = min(self.left[k] / c for k, c in parts.items())
                step = min(most, max(1.0, SHARE * most))
                key = tuple(sorted(parts.items(), reverse=True))
                self.x[key] = self.x.get(key, 0.0) + step
                for k, c in parts.items():
                    self.left[k] -= c * step
                    self.weight[k] *= math.exp(-RATE * c * step / self.demand[k])
                made += 1
                if made == BATCH:
                    break
            if not made:
                if need <= fill:
                    break
                need = max(fill, need - (0.0025 if need > FILL else STEP))
        self.bound = max(self.bound, self._dual_bound())


def best_fit(rest: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over the histogram: (pattern, how often). Bins of equal content are one group."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in np.flatnonzero(rest)[::-1].tolist():
        left, free = int(rest[length]), length
        while left:
            while free < capacity and not groups.get(free):
                free += 1
            parts, many = groups[free].pop() if free < capacity else ({}, math.ceil(left / (capacity // length)))
            each = free // length
            full = min(many, left // each)
            for took, bins in ((each, full), (left - full * each if full < many else 0, 1)):
                if took and bins and left:
                    took = min(took, each)
                    groups.setdefault(free - took * length, []).append((parts | {length: took}, bins))
                    left -= took * bins
                    many -= bins
            if many > 0 and parts:
                groups.setdefault(free, []).append((parts, many))
    return [g for held in groups.values() for g in held]


def rounded(x: dict[Pattern, float], count: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, int]], list[tuple[Pattern, int]]]:
    """(sequences of the patterns, sequences of what is left, best fit). Patterns are taken in order of their parts, so that neighbours are alike,
    and what one loses in rounding down goes to the next; none takes pieces that aren't left."""
    rest, out, carry = count.copy(), [], 0.0
    for parts, share in sorted(x.items(), reverse=True):
        many = min([math.floor(share + carry + 1e-9), *(int(rest[k]) // c for k, c in parts)])
        carry = min(share + carry - many, 1.0)
        if many > 0:
            out.append((parts, many))
            for k, c in parts:
                rest[k] -= many * c
    return out, [(tuple(sorted(p.items(), reverse=True)), n) for p, n in best_fit(rest, capacity)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, multiplicity) that hold exactly the histogram's pieces."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    out = [(((capacity, 1),), int(count[capacity]))] if count[capacity] else []
    count[capacity] = 0
    if count.any():
        program, tries = Program(count, capacity), []
        for fill in (FILL, 0.0):
            program.solve(fill)
            tries.append(sum(rounded(program.x, count, capacity), []))
        tries.append(sum(rounded({}, count, capacity), []))
        out += min(tries, key=lambda t: sum(n for _, n in t))  # the program's, where plain best fit is no better
    return out


_RANK_BITS = 44


def places(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """Sorted intervals of (length, rank): the first sequence, how many a sequence takes, the first offset."""
    rows, first, ranks = [], 0, {}
    for parts, many in patterns:
        at = 0
        for length, c in parts:
            base = ranks.get(length, 0)
            rows.append(((length << _RANK_BITS) | base, base, first, c, at))
            ranks[length] = base + many * c
            at += c * length
        first += many
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "base", "first", "each", "at"), a.T.copy(), strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), which should be a written table: it is read three times."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    buckets = max(16, math.ceil(sum(histogram.values()) / per_bucket))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*pieces.columns), F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("length", "_bucket").count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    rest = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", *rest)) - 1
    ranked = dealt.withColumn("_rank", rank.cast("long")).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = pieces.columns
    schema = common.with_fields(pieces, "sequence_id long, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = where.value
        for b in batches:
            length, r = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_rank"))
            i = np.searchsorted(w["key"], (length << _RANK_BITS) | r, "right") - 1
            k = r - w["base"][i]
            more = [w["first"][i] + k // w["each"][i], w["at"][i] + k % w["each"][i] * length]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *map(pa.array, more)], names=schema.names)

    return ranked.select(*names, "_rank").mapInArrow(common.frugal(run), schema)


def packed_digests(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Places of all pieces, with a checksum in place of the ids."""
    pieces = token_pieces(docs, tokenizer, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(common.spool(pieces), capacity)


def packed_ids(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Places of all pieces, with their ids: the training sequences once sorted by (sequence_id, offset)."""
    return pack(common.spool(token_pieces(docs, tokenizer, capacity)), capacity)
