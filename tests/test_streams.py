"""The stream of jobs against the batch plan: any order of arrival, results after the end, state that goes."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import jobs
from shelfmark.streaming import job_states

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, job_states.STORE)
    yield
    spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def tables(spark):
    """Jobs and their results, made of orders and their lines."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey % 25 = 3 OR o_orderkey < 40")
    later = lambda n: F.col("o_orderdate").cast("timestamp") + F.expr(f"INTERVAL {n} DAYS")
    work = orders.select(F.col("o_orderkey").cast("string").alias("job"), later(0).alias("t"), later(90).alias("deadline"), F.when(F.col("o_orderkey") % 5 == 0, later(60)).alias("stopped_at"), (F.col("o_orderkey") % 2 == 0).alias("partial_ok"))
    status = F.when(F.col("l_returnflag") == "A", "succeeded").when(F.col("l_returnflag") == "N", "partial").otherwise("failed")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").join(orders, F.expr("l_orderkey = o_orderkey"))
    results = lines.select(F.col("l_orderkey").cast("string").alias("job"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("item"), status.alias("status"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return work, results.dropDuplicates(["item"])


def events(work, results):
    items = results.groupBy("job").agg(F.count("*").alias("items"))
    submitted = work.join(items, "job", "left").selectExpr("job", "'submitted' AS kind", "t AS at", "CAST(NULL AS STRING) AS item", "CAST(NULL AS STRING) AS status", "deadline", "coalesce(items, 0L) AS items", "partial_ok")
    rest = "CAST(NULL AS TIMESTAMP) AS deadline", "CAST(NULL AS LONG) AS items", "CAST(NULL AS BOOLEAN) AS partial_ok"
    said = results.selectExpr("job", "'result' AS kind", "at", "item", "status", *rest)
    stopped = work.filter("stopped_at IS NOT NULL").selectExpr("job", "'stopped' AS kind", "stopped_at AS at", "CAST(NULL AS STRING) AS item", "CAST(NULL AS STRING) AS status", *rest)
    return submitted.unionByName(said).unionByName(stopped)


@pytest.mark.parametrize("seed", [1, 2])
def test_jobs_stream_equals_batch(spark, store, tmp_path, seed):
    work, results = tables(spark)
    rows = [tuple(r) for r in events(work, results).orderBy(F.xxhash64(F.lit(seed), "job", "item", "kind")).collect()]
    third = len(rows) // 3
    horizon = [[("last", "result", datetime.datetime(year, 1, 1), "i", "failed", None, None, None)] for year in (2100, 2120, 2140)]
    for i, part in enumerate([rows[:third], rows[third : 2 * third], rows[2 * third :], *horizon]):
        spark.createDataFrame(part, job_states.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{i}"))
        for name in os.listdir(tmp_path / f"part{i}"):
            if name.endswith(".parquet"):
                (tmp_path / "in").mkdir(exist_ok=True)
                os.rename(tmp_path / f"part{i}" / name, tmp_path / "in" / f"{i}.parquet")
                os.utime(tmp_path / "in" / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(job_states.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = job_states.job_states(stream, "4000 days").writeStream.outputMode("append").format("memory").queryName(f"jobs{seed}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    said = spark.table(f"jobs{seed}")
    got = {r.job: tuple(r) for r in job_states.ends(said).collect()}
    want = {r.job: (r.job, r.state, r.accepted, r.completed) for r in jobs.final_states(work, results, "job").collect()}
    assert len(want) > 80 and len({w[1] for w in want.values()}) >= 4
    assert got == want
    assert said.groupBy("job", "state").count().filter("count > 1").count() == 0  # queued, running and one end, once each
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 10  # the ended jobs' state has gone
