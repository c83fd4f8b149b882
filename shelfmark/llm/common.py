"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes to bytes: A-Z lowered, every other ASCII byte that is no digit or letter made a blank.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_M = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own
    under /tmp; on a cluster there is none that all machines see, so that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/shelfmark-{sc.applicationId}"
    return base.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as keep it apart from df's columns (which Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark drops a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spool(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and survives lost executors. The write's shuffle
    files go when it is done; the session's own setting for that holds again afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    if not keep:
        atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def drop(*spooled: DataFrame) -> None:
    """Deletes frames that spool returned; nothing that reads them may run any more. Others go when the interpreter ends."""
    for df in spooled:
        delete(df.sparkSession, df._spooled)


def lookup(left: DataFrame, right: DataFrame, key: list[str], total: int) -> DataFrame:
    """left's rows with right's columns, by key. right is a written table of one row a key, with `n`, how many of the `total` rows of
    left have the key. Keys of more than a thousandth of all rows (a thousand at most, whatever the input) are joined by
    broadcast, so that none of them fills one task; the others are joined by shuffle."""
    cut = max(total // 1000, 1000)
    hot = right.filter(F.col("n") > cut).collect() if total > cut else []
    if not hot:
        return left.join(right, key)
    few = F.broadcast(left.sparkSession.createDataFrame(hot, right.schema))
    return left.join(few.select(*key), key, "left_anti").join(right, key).unionByName(left.join(few, key))


def bit_filter(keys: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """Words of a filter of `bits` bits with those of the column's values (longs) set. At most bits / 64 rows reach the driver,
    whatever the input; where the table is so large that most bits are set, the filter lets more rows pass and loses none."""
    at = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(F.shiftright(at, 6).alias("w"), (at % 64).cast("int").alias("b")).distinct()
    out = np.zeros(bits // 64, np.uint64)
    for w, x in words.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))")).collect():
        out[w] = np.uint64(x & (1 << 64) - 1)
    return out


def passes(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values (64-bit) may be among the filter's keys."""
    at = values.astype(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended before the interpreter: the folder's owner clears it
        pass


def values(column: pa.Array, step: int = 512) -> Iterator:
    """A column's Python values, `step` at a time: a batch of long texts is never held twice."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def frugal(run: Callable) -> Callable:
    """run for mapInArrow; what it held goes back to the system when a task ends, as workers live on and serve other stages.

    Where the session has Spark's own batch size, 10,000 rows, it gets a smaller one: texts make batches of that many rows large, in
    the workers and beside the heap. Results do not depend on it."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """df's schema and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def words(text: str | None) -> list[bytes]:
    """The contract's words as UTF-8 bytes: maximal runs of ASCII digits, letters (A-Z lowered) and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def word_list(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over uint64 arrays."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class WordHash(dict):
    """word -> 64-bit hash, kept for up to `most` words of at most 40 bytes in a task."""

    def __init__(self, most: int = 120_000):
        from xxhash import xxh3_64_intdigest

        self._hash, self._most = xxh3_64_intdigest, most

    def __missing__(self, w: bytes) -> int:
        h = self._hash(w)
        if len(self) < self._most and len(w) <= 40:
            self[w] = h
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of word hashes h, in order of position; empty if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _M + mix(h[i : i + n] + np.uint64(i + 1))
    return mix(out)
