"""Token search over pools of text, paging by kind, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import page_of


def matches(pool: Column, tokens: list[str]) -> Column:
    """Every token is a part of some text of the pool; no tokens match all."""
    return F.forall(F.array(*map(F.lit, tokens)), lambda t: F.exists(pool, lambda p: F.contains(p, t))) if tokens else F.lit(True)


def pages_by_kind(rows: DataFrame, kind_order: list[str], order: list, size: int) -> DataFrame:
    ranked = rows.withColumn("kind_rank", F.array_position(F.array(*map(F.lit, kind_order)), F.col("kind")).cast("bigint"))
    return page_of(ranked, "kind", order, size)


def section(label: Column) -> Column:
    """The upper-case first letter, or # where there is none."""
    c = F.upper(F.substring(F.trim(label), 1, 1))
    return F.when(c.rlike("^[A-Z]$"), c).otherwise("#")
