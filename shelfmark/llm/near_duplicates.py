"""N-gram Jaccard join by MinHash banding, for texts of any number of copies.

Documents with one set of word shingles form a class; only classes are compared. Every class gets MinHash bands (band and row
counts chosen for the target recall at the threshold), and bands are shuffled on their hashes. Classes that share a bucket are
compared by their sketches, the low bytes of all their MinHash values: of a pair at the threshold, so many are equal with all but
MISS of probability. Pairs that pass link their classes; a bucket of more than BUCKET classes links them all to its first one
instead, which can only add candidates. Classes that hang together by these links are then verified on their full shingle sets,
in blocks of bounded bytes: a group of thousands is spread over many tasks, and a pair leaves a task only as a count and, where it
joins two parts, as one link.

Shingle sets are sent for classes that have such a link alone: texts are read a second time and pass a filter of fixed size first.
Tasks hold one text's set or two blocks (BLOCK_BYTES, or one set where that is larger) at a time.

Words are the contract's (A-Z lowered, runs of digits, letters and non-ASCII characters). A text of fewer words than a shingle,
but not none, is one shingle. Null texts and texts without words link to nothing, not even to each other. Ids need not be keys and
may be null: rows are numbered, a set goes by the smallest number of its rows, and its text is read again by the text's hashes.
A class is named by its smallest id. Classes without an id, and all but one of the classes whose smallest id is the
same, are named by numbers below every id of the table (unique, but other ones in another run). Other columns are not read and
pass through keep_one, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD, RECALL, MISS = 5, 0.8, 0.9999, 1e-5
#: Classes and bytes of a block, hashes of a signature, classes of a bucket that are compared with each other.
BLOCK, BLOCK_BYTES, MOST_HASHES, FEW, BUCKET = 1024, 16 << 20, 160, 48, 2048
#: Rows of a bucket that one task compares with each other; a larger bucket goes in pairs of such parts.
PART = 256


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective split of at most `most` hashes that finds a pair at the threshold with the target recall.
    A recall that no split reaches is an error."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        n = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if n * rows <= most:
            best = (n, rows)
    if best is None:
        raise ValueError(f"{most} hashes do not find pairs of similarity {threshold} with recall {recall}")
    return best


def least_equal(hashes: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """So many of `hashes` MinHash values are equal, at least, for a pair at the threshold, but for a share `miss` of such pairs."""
    below = 0.0
    for c in range(hashes + 1):
        below += math.comb(hashes, c) * threshold**c * (1 - threshold) ** (hashes - c)
        if below > miss:
            return c
    return hashes


def shingle_set(text: str | None, hashing: common.WordHash, k: int = SHINGLE) -> np.ndarray:
    h = hashing.array(common.word_list(text))
    return np.unique(common.shingles(h, min(k, len(h)) if len(h) else k))


class Signer:
    """Band hashes of a shingle set."""

    def __init__(self, n: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, n * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 1 << 63, n * rows, dtype=np.uint64)
        self.n, self.rows = n, rows

    def bands(self, s: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Band hashes, and the sketch."""
        low = np.full(len(self.a), ~np.uint64(0))
        for i in range(0, len(s), 2048):
            low = np.minimum(low, ((s[None, i : i + 2048] ^ self.c[:, None]) * self.a[:, None]).min(1))
        low = common.mix(low)
        sketch, low = (low & np.uint64(255)).astype(np.uint8).tobytes(), low.reshape(self.n, self.rows)
        out = np.arange(self.n, dtype=np.uint64)
        for r in range(self.rows):
            out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
        return out, sketch


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key_id and two text hashes: what a row is found again by. Rows that are equal in these are copies."""
    return docs.withColumns({"_key_id": F.col("doc_id").cast("long"), "_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})


def _signed(docs: DataFrame, n: int, rows: int, k: int) -> DataFrame:
    """row number, id, text hashes, size of the shingle set, its 128-bit hash, band hashes, sketch."""
    docs = _keyed(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("_row"), "_key_id", "_t1", "_t2", "text")
    schema = common.with_fields(docs.drop("text"), "_size long, _h1 long, _h2 long, _bands array<long>, _sketch binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        hashing, signer = common.WordHash(), Signer(n, rows)
        for b in batches:
            size, h1, h2, held, sketches = [], [], [], [], []
            for text in common.values(b.column(4)):
                s = shingle_set(text, hashing, k)
                d = xxh3_128_intdigest(s.tobytes())
                size.append(len(s)), h1.append((d >> 64) - (1 << 63)), h2.append((d & (1 << 64) - 1) - (1 << 63))
                one, sketch = signer.bands(s) if len(s) else (np.empty(0, np.uint64), b"")
                held.append(one.view(np.int64)), sketches.append(sketch)
            more = [*(pa.array(x, pa.int64()) for x in (size, h1, h2)), pa.array(held, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *more], names=schema.names)

    return docs.mapInArrow(common.frugal(run), schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows that come sorted by their first `keys` columns."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = r[:keys], []
            rows.append(r[keys:])
    if rows:
        yield now, rows


def _alike(sketches: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links of a bucket's rows that join what its pairs of at least `least` equal bytes join."""
    n, out = len(sketches), []
    label = np.arange(n)
    for i in range(n - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        near = other[(sketches[other] == sketches[i]).sum(1) >= least] if len(other) else other
        for old in np.unique(label[near]).tolist():
            out.append((i, int(near[label[near] == old][0])))
            label[label == old] = label[i]
    return out


def _candidates(sets: DataFrame, least: int) -> DataFrame:
    """(a, b), a < b: links between classes (rep, bands, sketch) that share a bucket and may be near."""
    total = sets.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    bucket = sets.select("rep", F.explode("bands").alias("h"))
    multi = common.spool(bucket.groupBy("h").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    shared = common.spool(common.lookup(bucket, multi, ["h"], total).select("h", "n", "a", "rep"))
    crowded = shared.filter((F.col("n") > BUCKET) & (F.col("rep") > F.col("a"))).select("a", F.col("rep").alias("b"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = shared.filter(F.col("n") <= BUCKET).withColumn("i", F.pmod(F.xxhash64("rep"), parts.cast("long")).cast("int")).select("h", "rep", "i", F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
    dealt = dealt.select("h", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), "rep")
    compared = dealt.join(sets.select("rep", "sketch"), "rep").select("h", "i", "j", "rep", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, seen = [], [], set()
        for _, rows in _groups(batches, 3):
            x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
            for i, j in _alike(x, least):
                pair = (min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0]))
                if pair not in seen:
                    seen.add(pair), a.append(pair[0]), b.append(pair[1])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b, seen = [], [], set()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compared.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(common.frugal(run), "a long, b long").union(crowded)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node hangs together with. links: (a, b), a < b. Alternating star contraction:
    each round points every node and its neighbours at the smallest of them, and ends when links no longer change. Rounds that
    run out are an error. Hubs of links are joined by broadcast (common.lookup)."""
    links = common.spool(links.select("a", "b").distinct())
    last, total = None, links.count()
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = common.spool(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
        large = common.spool(common.lookup(links, low, ["a"], 2 * total).select(F.col("m").alias("a"), "b").distinct())  # larger neighbours to the least
        low2 = common.spool(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")))
        small = common.lookup(large, low2, ["b"], total).filter("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))  # a node's smaller neighbours to the least
        old, links = links, common.spool(small.union(low2.select(F.col("m").alias("a"), "b")).distinct())
        common.drop(old, low, large, low2)
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if last == now:
            break
        last, total = now, now[0]
    else:
        raise ValueError(f"labels still change after {most_rounds} rounds")
    return links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _pairs_of(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) of shingle sets whose Jaccard similarity reaches the threshold; b None: pairs i < j of a."""
    rows = a if b is None else [*a, *b]
    if len(rows) <= 6:
        pairs = [(i, j) for i in range(len(a)) for j in (range(i + 1, len(a)) if b is None else range(len(b)))]
        near = []
        for i, j in pairs:
            x, y = a[i], (a if b is None else b)[j]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same >= threshold * (len(x) + len(y) - same) - 1e-9:
                    near.append((i, j))
        found = np.array(near, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]
    n, size = len(a), np.array([len(x) for x in rows], np.float32)
    every = np.concatenate(rows)
    value, col, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), size.astype(np.int64))
    shared = times[col] > 1
    row, col = row[shared], col[shared]
    order = np.lexsort((row, col))
    row = row[order]
    _, begin, times = np.unique(col[order], return_index=True, return_counts=True)
    width = n if b is None else len(rows) - n
    inter = np.zeros((n, width), np.float32)
    # shingles of few sets: their pairs one by one; shingles of many: matrix products over slices of them
    for c in range(2, FEW + 1):
        at = begin[times == c]
        left, right = np.triu_indices(c, 1)
        for part in np.array_split(at, max(1, len(at) * len(left) // 1_000_000)):
            held = row[part[:, None] + np.arange(c)]
            one, two = held[:, left].ravel(), held[:, right].ravel()
            if b is not None:
                across = (one < n) & (two >= n)
                one, two = one[across], two[across] - n
            if len(one):
                inter += np.bincount(one * width + two, minlength=n * width).reshape(n, width)
    many = np.flatnonzero(times > FEW)
    for part in np.array_split(many, max(1, -(-len(many) // 4096))):
        if len(part):
            m = np.zeros((len(rows), len(part)), np.float32)
            place = np.repeat(np.arange(len(part)), times[part])
            which = np.repeat(begin[part] - np.cumsum(times[part]) + times[part], times[part]) + np.arange(times[part].sum())
            m[row[which], place] = 1
            inter += m[:n] @ (m if b is None else m[n:]).T
    other = size if b is None else size[n:]
    near = inter >= np.float32(threshold) * (size[:n, None] + other[None, :] - inter) - np.float32(1e-4)
    i, j = np.nonzero(np.triu(near, 1) if b is None else near)
    exact = inter[i, j].astype(np.float64)
    ok = exact >= threshold * (size[i].astype(np.float64) + other[j] - exact) - 1e-9
    return i[ok], j[ok]


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join the same parts as all of (i, j) do."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """sets: (root, i, j, side, node, s), a block pair per (root, i, j). -> (a, b, n): links with b, counts with b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], []
        done = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])
        for _, rows in _groups(batches, 3):
            ids = [r[1] for r in rows]
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            here = sum(r[0] == 0 for r in rows)  # rows come sorted by side
            i, j = _pairs_of(sets[:here], sets[here:] if here < len(sets) else None, threshold)
            j = j + (here if here < len(sets) else 0)
            count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            for x, y in _spanning(i, j, len(ids)):
                a.append(ids[x]), b.append(ids[y]), n.append(0)
            for x in np.flatnonzero(count).tolist():
                a.append(ids[x]), b.append(None), n.append(int(count[x]))
            if len(a) > 50_000:
                yield done()
                a, b, n = [], [], []
        yield done()

    return sets.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "node").select("root", "i", "j", "side", "node", "s").mapInArrow(common.frugal(run), "a long, b long, n long")


def _found_by(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (_keyed) that keys (_key_id, _t1, _t2, n and others) name: those of keys that one row has, those of keys that n > 1 rows have."""
    same = lambda k: docs._key_id.eqNullSafe(k._key_id) & (docs._t1 == k._t1) & (docs._t2 == k._t2)
    return tuple(docs.join(k, same(k)).drop(k._key_id, k._t1, k._t2, k.n) for k in (keys.filter("n = 1"), keys.filter("n > 1")))


def _full_sets(docs: DataFrame, member: DataFrame, k: int) -> DataFrame:
    """member with s, the shingle sets of the texts that it names by their hashes. Texts pass a filter of fixed size, so that few
    others are sent; equal texts are sent once from each batch."""
    sent = docs.sparkSession.sparkContext.broadcast(common.bit_filter(member, "_t1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, words = common.WordHash(), sent.value
        for b in batches:
            t1, t2 = (b.column(i).to_numpy() for i in (0, 1))
            at = np.flatnonzero(common.passes(words, t1))
            _, first = np.unique(np.stack([t1[at], t2[at]]), axis=1, return_index=True)
            at = at[np.sort(first)]
            texts, out = b.column(2), []
            for i in at.tolist():
                out.append(shingle_set(texts[i].as_py(), hashing, k).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(t1[at]), pa.array(t2[at]), pa.array(out, pa.binary())], names=["_t1", "_t2", "s"])

    texts = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2"), "text")
    sets = texts.mapInArrow(common.frugal(run), "_t1 long, _t2 long, s binary").join(member.select("_t1", "_t2"), ["_t1", "_t2"], "left_semi")
    return sets.groupBy("_t1", "_t2").agg(F.first("s").alias("s")).join(member, ["_t1", "_t2"])


def _classed(docs: DataFrame, threshold: float, k: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(signed rows, their sets: _h1, _h2, the class's number `top`, n_links and the set's key: whether its id is null, _key_id, _t1, _t2, n rows)."""
    n, rows = bands(threshold, recall)
    signed = common.spool(_signed(docs, n, rows, k))
    known = signed.filter("_size > 0")
    key = F.struct(F.col("_key_id").isNull().alias("no_id"), "_key_id", "_t1", "_t2")
    sets = known.groupBy("_h1", "_h2").agg(F.min("_row").alias("rep"), F.min(key).alias("key"), F.first("_size").alias("size"), F.first("_bands").alias("bands"), F.first("_sketch").alias("sketch"))
    sets = common.spool(sets.select("_h1", "_h2", "rep", "key.*", "size", "bands", "sketch"))
    repeated = common.spool(known.groupBy("_key_id", "_t1", "_t2").agg(F.count("*").alias("n")).filter("n > 1"))
    same = sets._key_id.eqNullSafe(repeated._key_id) & (sets._t1 == repeated._t1) & (sets._t2 == repeated._t2)
    keys = sets.join(repeated, same, "left").select("_h1", "_h2", "rep", sets.no_id, sets._key_id, sets._t1, sets._t2, F.coalesce("n", F.lit(1)).alias("n"))
    could = common.spool(components(_candidates(sets.select("rep", "bands", "sketch"), least_equal(n * rows, threshold))))
    member = could.join(sets.select(F.col("rep").alias("node"), "_t1", "_t2", "size"), "node")
    size = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    member = common.spool(member.join(size, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")))
    full = _full_sets(docs, member, k)
    # block pairs (i, j), i <= j: a class goes to every pair that holds its block
    paired = full.select("root", "node", "s", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "root", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), (F.col("i") > F.col("o")).cast("int").alias("side"), "node", "s"
    )
    found = common.spool(_verified(paired, threshold))
    linked = components(found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    counted = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    named = counted.join(linked.withColumnRenamed("node", "rep"), "rep")
    links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    return signed, common.spool(keys.join(named, "rep", "left").select("_h1", "_h2", F.coalesce("root", "rep").alias("top"), links, "no_id", "_key_id", "_t1", "_t2", "n"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the smallest id of all that hang together by links), n_links (other shingle sets at the threshold or
    above): a row for each row of docs."""
    signed, sets = _classed(docs, threshold, k, recall)
    alone = signed.filter("_size = 0").select(F.col("_row").alias("top"), "_key_id")
    lead = sets.groupBy("top").agg(F.min("_key_id").alias("_key_id")).union(alone)
    owner = lead.filter("_key_id IS NOT NULL").groupBy("_key_id").agg(F.min("top").alias("owner"))
    least = signed.agg(F.least(F.min("_key_id"), F.lit(0)).alias("least"))
    named = lead.join(owner, "_key_id", "left").crossJoin(F.broadcast(least)).select("top", F.when(F.col("owner") == F.col("top"), F.col("_key_id")).otherwise(F.col("least") - 1 - F.col("top")).alias("class_id"))
    named = common.spool(named)
    known = sets.select("_h1", "_h2", "top", "n_links").join(named, "top").drop("top")
    out = signed.filter("_size > 0").select("_key_id", "_h1", "_h2").join(known, ["_h1", "_h2"]).select("_key_id", "class_id", "n_links")
    return out.union(alone.join(named, "top").select("_key_id", "class_id", F.lit(0).cast("long"))).withColumnRenamed("_key_id", "doc_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """One row of docs of each class, with its columns: of the smallest id, then text hash, then hash of all columns."""
    _, sets = _classed(docs, threshold, k, recall)
    kept = sets.groupBy("top").agg(F.min(F.struct("no_id", "_key_id", "_t1", "_t2", "n")).alias("key")).select("key._key_id", "key._t1", "key._t2", "key.n")
    # a row's columns are one struct: no name of theirs can clash with a name of ours
    rows = _keyed(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))).drop("doc_id", "text")
    one, many = _found_by(rows, common.spool(kept))
    hashed = F.xxhash64(*[F.col(f"_whole.`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    many = many.groupBy("_key_id", "_t1", "_t2").agg(F.min_by("_whole", hashed).alias("_whole"))
    wordless = docs.filter(~F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)))
    return one.select("_whole.*").union(many.select("_whole.*")).union(wordless)


#: The same by brute force: every pair of different shingle sets that share a shingle, components by recursion.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM s GROUP BY s),
m AS (SELECT s.doc_id, c.c FROM s JOIN c USING (s)),
g AS (SELECT c, n, unnest(s) AS g FROM c),
p AS (SELECT x.c AS a, y.c AS b FROM g x JOIN g y ON x.g = y.g AND x.c <> y.c AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
      GROUP BY x.c, x.n, y.c, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
k AS (SELECT a, min(b) AS low FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT w.doc_id, CAST(least(coalesce(k.low, m.c, w.doc_id), coalesce(m.c, w.doc_id)) AS BIGINT) AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN m USING (doc_id) LEFT JOIN k ON k.a = m.c LEFT JOIN l ON l.a = m.c
"""
