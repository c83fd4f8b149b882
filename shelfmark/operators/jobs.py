"""Final states of jobs from their results, batches with sound keys, and the folding of proposals that say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import keyed

# fixed values, least first
RISKS = ["low", "medium", "high"]
REVIEWS = ["unseen", "discarded", "viewed", "edited", "confirmed"]


def final_states(jobs: DataFrame, results: DataFrame, job: str) -> DataFrame:
    """job, state, accepted (results in time), completed. jobs: job, deadline, stopped_at (null: never), partial_ok, each job once.
    results: job, status, at (null: none came), a row for each item.

    A stop before the deadline and before the last result cancels; else a result that is late or never came times the job out. What
    comes after the end is discarded. Counts alone are shuffled, so a job of very many items is no hot key."""
    stop = F.col("stopped_at") < F.col("deadline")
    end = F.when(stop, F.col("stopped_at")).otherwise(F.col("deadline"))
    timed = results.select(job, "status", "at").join(jobs.select(job, "deadline", "stopped_at"), job)
    in_time = F.coalesce(F.col("at") <= end, F.lit(False))
    per = timed.groupBy(job).agg(
        F.count("*").alias("_items"), F.count_if(in_time).alias("accepted"),
        F.count_if(in_time & (F.col("status") == "succeeded")).alias("_good"), F.count_if(in_time & F.col("status").isin("succeeded", "partial")).alias("_some"),
        F.max(F.when(in_time, F.col("at"))).alias("_last"),
    )
    all_in = F.col("accepted") == F.col("_items")
    state = (
        F.when(~all_in & stop, "canceled").when(~all_in, "timed_out").when(F.col("accepted") == 0, "failed").when(F.col("_good") == F.col("accepted"), "succeeded")
        .when(F.coalesce("partial_ok", F.lit(False)) & (F.col("_some") > 0), "partial").otherwise("failed")
    )
    joined = jobs.select(job, "deadline", "stopped_at", "partial_ok").join(per, job, "left").fillna(0, ["_items", "accepted", "_good", "_some"])
    return joined.select(job, state.alias("state"), "accepted", F.when(all_in, F.col("_last")).otherwise(end).alias("completed"))


def whole_batches(results: DataFrame, batch: str, item: str) -> DataFrame:
    """The rows of batches in which every row has an item id of its own; a missing, blank or repeated id rejects its whole batch."""
    named = F.nullif(F.col(item).cast("string"), F.lit(""))
    once = results.groupBy(batch, named.alias("_item")).agg(F.count("*").alias("_n"))
    sound = once.groupBy(batch).agg(F.max("_n").alias("_most"), F.count_if(F.col("_item").isNull()).alias("_none")).filter("_most = 1 AND _none = 0")
    return results.join(sound.select(batch), batch, "left_semi")


def highest(value: str, order: list[str]) -> Column:
    """The value that comes last in `order`, over a group; values outside it count as its first."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(value)), F.lit(1))
    return F.element_at(F.array(*map(F.lit, order)), F.max(F.greatest(place, F.lit(1))).cast("int"))


def fold_proposals(df: DataFrame, group: str, order: str) -> DataFrame:
    """One proposal for each group: the first id, the longest summary (the earliest of equals), the highest risk and review state,
    applied where any is, ignored where all are, else pending; sources in order of first sight, null ones as none. `order` is unique within a group."""
    sources = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "sources"))), lambda x: F.coalesce(x["sources"], F.array().cast("array<string>"))))
    out = df.groupBy(group).agg(
        F.min_by("id", order).alias("id"), F.max_by("summary", F.struct(F.length("summary"), -F.col(order))).alias("summary"), highest("risk", RISKS).alias("risk"),
        highest("review", REVIEWS).alias("review"), sources.alias("_sources"), F.count("*").alias("merged"),
        F.when(F.bool_or(F.col("status") == "applied"), "applied").when(F.bool_and(F.col("status") == "ignored"), "ignored").otherwise("pending").alias("status"),
    )
    return out.withColumn("sources", keyed.ordered_distinct(F.col("_sources"))).drop("_sources")
