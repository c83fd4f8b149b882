"""How two states of a table differ, field by field, at any depth of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def leaves(schema: StructType, at: str = "") -> list[tuple[str, DataType]]:
    """Dotted paths of all fields that are no struct, with their types."""
    out = []
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        out += leaves(f.dataType, path) if isinstance(f.dataType, StructType) else [(path, f.dataType)]
    return out


def _column(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _text(path: str, kind: DataType) -> Column:
    c = _column(path)
    return F.to_json(c) if isinstance(kind, (ArrayType, MapType)) else c if isinstance(kind, StringType) else c.cast("string")


def rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, path, before, after, change: a row for each field that differs between rows of one key: 'changed', 'set' (null before) or 'cleared' (null
    after); and one of path '' for a key on one side alone: 'added' or 'removed'. Values are texts, lists and maps JSON. Each side has a key
    once; null keys meet. Fields of one table alone are null in the other.

    The paths come from the schemas, so that the plan is one join and one explode of what differs, whatever the depth."""
    mine, theirs = dict(leaves(before.schema)), dict(leaves(after.schema))
    paths = [p for p in {**mine, **theirs} if p != key]
    side = lambda df, has, s: df.select(F.col(key).alias(f"{s}key"), F.lit(True).alias(f"{s}there"), F.struct(*((_text(p, has[p]) if p in has else F.lit(None).cast("string")).alias(f"f{i}") for i, p in enumerate(paths))).alias(s))
    both = side(before, mine, "b").join(side(after, theirs, "a"), F.col("bkey").eqNullSafe(F.col("akey")), "full_outer")
    one = lambda path, b, a, change: F.struct(F.lit(path).alias("path"), b.alias("before"), a.alias("after"), change.alias("change"))
    none, alone = F.lit(None).cast("string"), F.col("bthere").isNull() | F.col("athere").isNull()
    fields = []
    for i, p in enumerate(paths):
        b, a = F.col(f"b.f{i}"), F.col(f"a.f{i}")
        change = F.when(b.isNull(), "set").when(a.isNull(), "cleared").otherwise("changed")
        fields.append(F.when(~alone & ~b.eqNullSafe(a), one(p, b, a, change)))
    whole = F.when(alone, one("", none, none, F.when(F.col("bthere").isNull(), "added").otherwise("removed")))
    each = both.select(F.coalesce("bkey", "akey").alias(key), F.explode(F.array_compact(F.array(whole, *fields))).alias("x"))
    return each.select(key, "x.*")


def summary(differences: DataFrame) -> DataFrame:
    """path, change, n: how often each field changed, in which way."""
    return differences.groupBy("path", "change").agg(F.count("*").alias("n"))
