"""Vector code compression: product codes from weighted distinct parts.

Components become floor(256 * x); a vector is cut into 16 equal consecutive parts. At each part position equal parts are counted, so
Lloyd's rounds run over distinct parts with their counts, dealt over all tasks; what reaches the driver are the sums of at most
64 entries a position. Codes and errors of the distinct parts are joined back to the vectors; parts of very many vectors by broadcast.

Vectors that are null or hold null or non-finite components are dropped; other columns than vec_id and label may be of any name, and go.
Rows that repeat an id or have none are rows of their own; the first codebook takes ids in order, nulls last, ties by components. Fewer
than 64 vectors make smaller codebooks, an empty table no rows. Vectors of different lengths, or of a length that is not a positive
multiple of 16, and components of 2^23 or more are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

PARTS, ENTRIES, ROUNDS = 16, 64, 2


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row, vec_id, label, ints of the vectors that take part, written once, so that row numbers stay."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = vectors.filter(F.col(vector).isNotNull() & ~F.exists(vector, odd))
    ints = F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("int"))
    return common.spool(whole.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), ints.alias("ints")))


def parts_of(rows: DataFrame, width: int) -> DataFrame:
    """A row for each part of each vector: position (from 0), part."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice("ints", i * width + 1, width))
    return rows.select(*(c for c in rows.columns if c != "ints"), F.posexplode(cut).alias("position", "part"))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the first among equals, and its squared distance; exact, in whole numbers."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    if 4 * most * most * parts.shape[1] >= 1 << 62:
        raise ValueError("components too large for exact distances in 64 bits")
    kind = np.float64 if 8 * most * most * parts.shape[1] < 1 << 53 else np.int64  # doubles hold these numbers exactly
    p, b = parts.astype(kind), book.astype(kind)
    # the part's own square is the same for all entries
    score = (b * b).sum(1)[None, :] - 2 * (p @ b.T)
    code = score.argmin(1)
    return code, (score[np.arange(len(p)), code] + (p * p).sum(1)).astype(np.int64)


def by_position(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """position, its rows of the batch, their parts, codes and distances."""
    at = batch.column("position").to_numpy()
    parts = batch.column("part").flatten().to_numpy().reshape(len(at), -1).astype(np.int64)
    for position in np.unique(at):
        rows = np.flatnonzero(at == position)
        yield int(position), rows, parts[rows], *nearest(parts[rows], books[position])


def summing(books: np.ndarray) -> Callable:
    """Each task's sums by position and code: n parts, and their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), object)  # Python's integers: counts times components in any number
        for batch in batches:
            weights = batch.column("n").to_numpy()
            for position, rows, parts, code, _ in by_position(batch, books):
                n = weights[rows]
                small = int(n.sum()) * max(int(np.abs(parts).max(initial=0)), 1) < 1 << 62
                add = np.zeros(total.shape[1:], np.int64 if small else object)
                np.add.at(add, code, np.column_stack([n, parts * n[:, None]] if small else [n.astype(object), parts.astype(object) * n.astype(object)[:, None]]))
                total[position] += add.astype(object)
        position, code = np.nonzero(total[:, :, 0] != 0)
        sums = [[str(x) for x in total[p, c]] for p, c in zip(position, code, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(position, pa.int32()), pa.array(code, pa.int32()), pa.array(sums, pa.list_(pa.string()))], ["position", "code", "sums"])

    return run


def coding(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for _, rows, _, code, error in by_position(batch, books):
                codes[rows], errors[rows] = code, error
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes), pa.array(errors)], [*batch.schema.names, "code", "error"])

    return run


def lloyd(parts: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds over position, part, n; unused entries stay."""
    for _ in range(rounds):
        sums = parts.mapInArrow(common.frugal(summing(books)), "position int, code int, sums array<string>")
        sums = sums.select("position", "code", F.posexplode("sums").alias("i", "x")).groupBy("position", "code", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums.collect():  # positions x entries x (width + 1) numbers
            found.setdefault((r.position, r.code), {})[r.i] = int(r.x)
        books = books.copy()
        for (position, code), x in found.items():
            books[position, code] = [x[i + 1] // x[0] for i in range(books.shape[2])]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, **columns: str) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (two hex digits a part), error of each vector, and the codebooks (position, entry, component)."""
    rows = integers(vectors, **columns)
    total, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("ints")), F.max(F.size("ints"))).first()
    empty = StructType([rows.schema["vec_id"], rows.schema["label"], *StructType.fromDDL("code string, error long").fields])
    if not total:
        return rows.sparkSession.createDataFrame([], empty), np.zeros((PARTS, 0, 0), np.int64)
    if least != most or not least or least % PARTS:
        raise ValueError(f"vectors of {least} to {most} components; all must have the same number, a multiple of {PARTS}")
    width = least // PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    books = np.array([r.ints for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    each = parts_of(rows, width)
    distinct = common.spool(each.groupBy("position", "part").agg(F.count(F.lit(1)).alias("n")))
    books = lloyd(distinct, books, rounds)
    coded = common.spool(distinct.mapInArrow(common.frugal(coding(books)), common.with_fields(distinct, "code int, error long")))
    joined = common.lookup(each, coded, ["position", "part"], PARTS * total)
    whole = joined.groupBy("row", "vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("codes"), F.sum("error").alias("error"))
    digits = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c["code"]), 2, "0"))), "")
    return whole.select("vec_id", "label", digits.alias("code"), "error"), books


def digests(vectors: DataFrame, **columns: str) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels, nulls together) and codebooks_sha256."""
    found, books = compressed(vectors, **columns)
    found = common.spool(found.withColumns({"unlabelled": F.col("label").isNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    labels = common.spool(found.groupBy("unlabelled", "name").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    out = common.lookup(found, labels, ["unlabelled", "name"], found.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out: b0 are the first codebooks, a1 the parts' entries in b0, b1 the codebooks after one round."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = []
    for k in range(1, ROUNDS + 2):
        steps.append(f"""e{k} AS (SELECT w.position, w.n, w.part, b.entry, list_sum(list_transform(list_zip(w.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
            FROM w JOIN b{k - 1} b USING (position)),
        a{k} AS (SELECT position, part, any_value(n) AS n, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM e{k} GROUP BY position, part)""")
        if k <= ROUNDS:
            steps.append(f"""s{k} AS (SELECT position, entry, i, sum(n) AS n, sum(n * part[i]) AS s FROM a{k}, (SELECT unnest(generate_series(1, (SELECT max(len(part)) FROM w))) AS i) GROUP BY position, entry, i),
        m{k} AS (SELECT position, entry, list({floor} ORDER BY i) AS part FROM s{k} GROUP BY position, entry),
        b{k} AS (SELECT b.position, b.entry, coalesce(m{k}.part, b.part) AS part FROM b{k - 1} b LEFT JOIN m{k} ON b.position = m{k}.position AND b.entry = m{k}.entry)""")
    last = ROUNDS
    return f"""
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT r, position, ints[position * (len(ints) // {PARTS}) + 1:(position + 1) * (len(ints) // {PARTS})] AS part FROM v, (SELECT unnest(generate_series(0, {PARTS - 1})) AS position)),
    w AS (SELECT position, part, count(*) AS n FROM p GROUP BY position, part),
    f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS entry FROM v),
    b0 AS (SELECT position, entry, part FROM p JOIN f USING (r) WHERE entry < {ENTRIES}),
    {", ".join(steps)},
    c AS (SELECT r, string_agg(printf('%02x', a.entry), '' ORDER BY position) AS code, CAST(sum(dist) AS BIGINT) AS error FROM p JOIN a{last + 1} a USING (position, part) GROUP BY r),
    k AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM b{last})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r), k
    """


SQL = _sql()
