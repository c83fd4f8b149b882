"""Incremental statistics over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def host_counters(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests and failures of each host and day; events later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failures")
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drains the stream into a table in memory: for tests and small reports."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
