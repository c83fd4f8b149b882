"""Tables that end a plan's lineage: written to the folder that driver and executors share, and deleted by whoever is done with them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder under /tmp for a local master, and an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or f"file:///tmp/checkpoints/{sc.applicationId}").rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended before the interpreter: the folder's owner clears it
        pass


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back; it goes when the interpreter ends, or with drop."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written returned; nothing that reads them may run any more."""
    for df in tables:
        _delete(df.sparkSession, df._written)


def spread(df: DataFrame, *keys: str, rows: int | None = 20_000) -> DataFrame:
    """df dealt by keys over as many tasks as the session shuffles to, and over more where these would get more than `rows` rows each, so that
    tasks stay as large as they are while the table grows. For steps that do much for each row of a table that is small enough to be read
    in few tasks: they would do all the work there. df is counted: it should be a table, whose files know their rows; without `rows` it is not."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // rows)) if rows else tasks, *keys)
