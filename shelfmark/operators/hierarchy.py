"""Paths, merges with foreign keys rewritten, reversible patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_nodes(df: DataFrame, path: Column) -> DataFrame:
    """Every prefix of every path once: node, parent (null at the root), label, depth, leaves."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.slice("_p", 1, i))
    nodes = df.select(path.alias("_p")).filter(F.size("_p") > 0).select(F.explode(prefixes).alias("p"))
    counted = nodes.groupBy(F.array_join("p", "/").alias("node"), F.size("p").alias("depth")).agg(F.count("*").alias("leaves"), F.first("p").alias("p"))
    parent = F.when(F.col("depth") > 1, F.array_join(F.slice("p", 1, F.col("depth") - 1), "/"))
    return counted.select("node", parent.alias("parent"), F.element_at("p", -1).alias("label"), "depth", "leaves")


def merge_rewire(children: DataFrame, foreign_key: str, redirects: DataFrame, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """children with foreign keys of merged parents pointed at what they were merged into."""
    r = redirects.select(F.col(old).alias(foreign_key), F.col(new).alias("_new"))
    return children.join(r, foreign_key, "left").withColumn(foreign_key, F.coalesce("_new", foreign_key)).drop("_new")


def apply_patches(rows: DataFrame, key: str, column: str, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched rows, snapshots): patches (key, after) set the column; snapshots keep what was there."""
    joined = rows.join(patches.select(key, "after", F.lit(True).alias("_hit")), key, "left")
    patched = joined.withColumn(column, F.when(F.col("_hit"), F.col("after")).otherwise(F.col(column))).select(*rows.columns)
    snapshots = joined.filter("_hit").select(key, F.col(column).alias("before"), "after")
    return patched, snapshots


def revert(rows: DataFrame, key: str, column: str, snapshots: DataFrame) -> DataFrame:
    return apply_patches(rows, key, column, snapshots.select(key, F.col("before").alias("after")))[0]


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)
