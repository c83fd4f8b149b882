"""Dedup, ranking, capping and fusion by key. Ties are always broken by explicit columns; no operator relies on partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import shared


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: list, order: list, limit: int | Column, rank: str = "rank") -> DataFrame:
    """Up to `limit` rows of each key, numbered from 1; the limit may be a column."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.filter(F.col(rank) <= limit)


def last_wins(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """key, first position, last value: a map's insertion order with the latest value; partial aggregates only, no sort."""
    return df.groupBy(key).agg(F.min(order).alias("first_pos"), F.max_by(value, order).alias(value))


def fold_case(df: DataFrame, column: str, order: list) -> DataFrame:
    """First row of each value, whatever its case."""
    return first_per_key(df, [F.lower(F.col(column))], order)


def reciprocal_rank_fusion(lists: DataFrame, key: str, list_id: str, rank: str, k: int = 10, depth: int = 8, least: int = 2) -> DataFrame:
    """Keys seen in at least `least` ranked lists within depth, scored by the sum of 1 / (k + rank + 1), ranks from 0."""
    window = lists.filter(F.col(rank) < max(4 * depth, 8))
    fused = window.groupBy(key).agg(
        F.count_distinct(list_id).alias("occurrences"), F.min(rank).alias("best_rank"),
        # summed in order of rank, so that the sum does not depend on the partitioning
        F.aggregate(F.array_sort(F.collect_list(F.lit(1.0) / (F.lit(k) + F.col(rank) + 1))), F.lit(0.0), lambda a, x: a + x).alias("score"),
    )
    return fused.filter(F.col("occurrences") >= least)


def numbered(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """df with `name`, each row's number in its group by order (from 1), and `total`, the group's rows. `order` ends in something unique.

    Rows lie in range partitions of group and order, written once; a partition numbers its own rows and adds what lies before it, so a group of any
    share of the table is spread over as many tasks as its rows fill. What meets by group is one row for each partition."""
    parts = shared.written(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    held = parts.groupBy(group, "_part").agg(F.count("*").alias("_held"))
    w = Window.partitionBy(group)
    held = held.withColumns({"_before": F.coalesce(F.sum("_held").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_held").over(w)})
    own = parts.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    met = own.join(held.drop("_held").withColumnsRenamed({group: "_g", "_part": "_p"}), (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_part") == F.col("_p")))
    return met.withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part", "_g", "_p")


def coverage_merge(df: DataFrame, source: str, key: str, order: list, head: int, limit: int) -> DataFrame:
    """The first `head` rows of each source come before the rest; each key once; `limit` rows in all. `order` ends in something unique."""
    placed = numbered(df, source, order, "_pos").withColumn("_late", (F.col("_pos") > head).cast("int"))
    once = placed.groupBy(key).agg(F.min(F.struct("_late", "_pos", source)).alias("s"))
    ordered = once.select(key, F.col(f"s.{source}").alias(source), F.col("s._late").alias("late"), F.col("s._pos").cast("int").alias("pos"))
    return ordered.orderBy("late", "pos", source, key).limit(limit)


def page_of(df: DataFrame, group: str, order: list, size: int) -> DataFrame:
    """Adds position, page and pages within each group. `order` ends in something unique."""
    out = numbered(df, group, order, "position")
    return out.withColumns({"pages": F.ceil(F.col("total") / size).cast("bigint"), "page": F.ceil(F.col("position") / size).cast("bigint")}).withColumn("position", F.col("position").cast("int")).drop("total")


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The latest non-null value at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def ordered_distinct(array: Column, ignore_case: bool = False) -> Column:
    """Distinct non-blank trimmed values in order of first sight."""
    kept = F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x != "")
    if not ignore_case:
        return F.array_distinct(kept)
    return F.filter(kept, lambda x, i: F.array_position(F.transform(kept, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def fair_sample(df: DataFrame, key: str, groups: dict[str, Column], each: int, order: Column) -> DataFrame:
    """For each group in turn, `each` rows with the fewest assignments so far, then by order. (key, group, used_before).

    The groups are a short list of predicates, so the turns are a short chain of plans; what is carried is groups * each rows."""
    taken = None
    for name, wanted in groups.items():
        pool = df.filter(wanted)
        used = F.lit(0).cast("long")
        if taken is not None:
            counts = F.broadcast(taken.groupBy(key).agg(F.count("*").alias("_used")))
            pool = pool.join(counts, key, "left")
            used = F.coalesce("_used", F.lit(0))
        pick = pool.withColumn("used_before", used).orderBy("used_before", order).limit(each).select(key, F.lit(name).alias("group_name"), "used_before")
        taken = pick if taken is None else taken.unionByName(pick)
    return taken
