"""A registry of names brought in line with a library: old entries are merged, kept or put aside by how many derived entries they match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import lookup_key, trimmed
from shelfmark.operators import resolve


def _values(df: DataFrame, entry: str) -> DataFrame:
    """entry, role, pos, value, key: a row for each value that has a key."""
    each = df.select(F.col(entry).alias("entry"), "role", F.posexplode("values").alias("pos", "value")).withColumn("value", trimmed(F.col("value")))
    return each.withColumn("key", lookup_key(F.col("value"))).filter("key <> ''")


def routes(existing: DataFrame, derived: DataFrame) -> DataFrame:
    """entry, route, target: 'append' (no derived entry of the role shares a key), 'merge' (one does, the target) or 'ambiguous' (more do).

    existing and derived: entry (unique), role, values. Of each key the smallest and the largest derived entry that has it say whether there is one
    or more, so that a key that very many entries have makes no pairs of them: what is joined is one row for each old value."""
    held = _values(derived, "entry").groupBy("role", "key").agg(F.min("entry").alias("lo"), F.max("entry").alias("hi"))
    met = _values(existing, "entry").join(held, ["role", "key"]).groupBy("entry").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = existing.select("entry").join(met, "entry", "left")
    route = F.when(F.col("lo").isNull(), "append").when(F.col("lo") == F.col("hi"), "merge").otherwise("ambiguous")
    return out.select("entry", route.alias("route"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("target"))


def kept_values(existing: DataFrame, derived: DataFrame, routed: DataFrame) -> DataFrame:
    """target, entry, pos, value: what merged entries give their targets: values that the target has a key of, or no other derived entry."""
    keys = _values(derived, "entry").select(F.col("entry").alias("target"), "key").distinct()
    spread = keys.groupBy("key").agg(F.count("*").alias("n"))
    merging = _values(existing, "entry").join(routed.filter("route = 'merge'").select("entry", "target"), "entry")
    own = merging.join(keys.withColumn("_own", F.lit(True)), ["target", "key"], "left").join(spread, "key", "left")
    return own.filter(F.col("_own").isNotNull() | F.col("n").isNull()).select("target", "entry", "pos", "value")


def synced(existing: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, ambiguous): entry, role, values. Derived entries have their own values first, then those of merged ones in order of entry and place,
    each key once; entries that match nothing follow as they are; ambiguous ones are put aside. Old entries are matched with the derived ones as
    these are before anything is merged, so that the order of old entries has no say; a second run with the outcome as the registry
    changes nothing."""
    routed = routes(existing, derived)
    own = _values(derived, "entry").select("entry", "role", F.lit(0).alias("_late"), F.col("entry").alias("_from"), "pos", "value", "key")
    more = kept_values(existing, derived, routed).join(derived.select(F.col("entry").alias("target"), "role"), "target")
    given = more.select(F.col("target").alias("entry"), "role", F.lit(1).alias("_late"), F.col("entry").alias("_from"), "pos", "value", lookup_key(F.col("value")).alias("key"))
    appended = _values(existing.join(routed.filter("route = 'append'").select("entry"), "entry", "left_semi"), "entry").select("entry", "role", F.lit(0).alias("_late"), F.col("entry").alias("_from"), "pos", "value", "key")
    every = own.unionByName(given).unionByName(appended)
    once = every.groupBy("entry", "role", "key").agg(F.min(F.struct("_late", "_from", "pos", "value")).alias("x"))
    entries = once.groupBy("entry", "role").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"]).alias("values"))
    return entries, existing.join(routed.filter("route = 'ambiguous'").select("entry"), "entry", "left_semi")


def consolidated(entries: DataFrame) -> DataFrame:
    """entry (the first), role, values: entries of one role that share a key, directly or through others, as one (resolve.hang_together)."""
    each = _values(entries, "entry").withColumn("_k", F.concat_ws("|", "role", "key"))
    rows = each.select(F.xxhash64("entry", "key").alias("_id"), "entry", "role", "pos", "value", "_k")
    together = resolve.hang_together(rows.groupBy("_id").agg(F.first("entry").alias("entry"), F.first("_k").alias("_k")), "_id", ["entry", "_k"])
    owner = together.groupBy("entry").agg(F.min("component").alias("_c"))
    named = rows.join(owner, "entry")
    once = named.groupBy("_c", "role", "_k").agg(F.min(F.struct("entry", "pos", "value")).alias("x"))
    return once.groupBy("_c", "role").agg(F.min("x.entry").alias("entry"), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"]).alias("values")).select("entry", "role", "values")
