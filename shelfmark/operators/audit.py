"""Integrity checks and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str, rule: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("entity_id"))


def missing_parents(child: DataFrame, child_id: list[str], foreign_key: str, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """Children whose foreign key has no parent."""
    orphans = child.join(parent.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")
    return orphans.select(F.lit(rule).alias("rule"), F.concat_ws(":", *child_id).alias("entity_id"))


def unused_parents(parent: DataFrame, key: str, child: DataFrame, foreign_key: str) -> DataFrame:
    return parent.join(child.select(F.col(foreign_key).alias(key)), key, "left_anti")


def assert_valid(violations: DataFrame) -> None:
    """Raises on the first violation found."""
    if found := violations.take(1):
        raise ValueError(f"{found[0]['rule']}: {found[0]['entity_id']}")


def rules(df: DataFrame, entity_id: Column, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row for each rule that a row breaks, in one scan: code -> (severity, predicate)."""
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, (sev, cond) in checks.items()]))
    return df.select(entity_id.cast("string").alias("entity_id"), F.explode(hits).alias("i")).select("entity_id", "i.code", "i.severity")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): a count for each value of each column, as one aggregation over grouping sets."""
    value = F.coalesce(*[F.col(c).cast("string") for c in columns])
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    bit = {c: (2 ** len(columns) - 1) ^ (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    name = reduce(lambda acc, c: F.when(F.col("_g") == bit[c], c).otherwise(acc), columns, F.lit(None))
    return sets.select(name.alias("facet"), value.alias("value"), "n")


def zero_filled(dimension: DataFrame, key: str, facts: DataFrame, name: str = "n") -> DataFrame:
    counts = facts.groupBy(key).agg(F.count("*").alias(name))
    return dimension.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
