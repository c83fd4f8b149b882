"""Proposals of edits: what keeps one from being applied, JSON documents with a path set, what several proposals for one entity come to."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfmark.functions import names
from shelfmark.functions.pages import canonical

RISKS = ("low", "medium", "high")


def blockers(kind: Column, risk: Column, changes: Column) -> Column:
    """Codes of what keeps a proposal from being applied as it is; changes: its fields and images."""
    rest = F.array_compact(F.array(F.when(F.coalesce(changes, F.lit(0)) == 0, "nothing-to-write"), F.when(risk == "high", "high-risk")))
    return F.when(kind == "merge", F.array(F.lit("merge"))).otherwise(rest)


@F.pandas_udf(StringType())
def set_path(document: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    """The JSON document with a JSON value at a path such as 'a.b[0].c', in canonical form. Objects and arrays that the path asks for are
    made; null where the path leads through something else, or where document or value are no JSON."""

    def one(d: str | None, p: str | None, v: str | None) -> str | None:
        steps = [int(x) if x.isdigit() else x for x in re.sub(r"\[(\d+)\]", r".\1", p or "").split(".") if x]
        try:
            tree, new = json.loads(d), json.loads(v)
        except (TypeError, ValueError):
            return None
        at = tree
        for k, step in enumerate(steps):
            empty = None if k + 1 == len(steps) else [] if isinstance(steps[k + 1], int) else {}
            if isinstance(step, int):
                if not isinstance(at, list):
                    return None
                at.extend([None] * (step + 1 - len(at)))
            elif not isinstance(at, dict):
                return None
            if empty is None:
                at[step] = new
                break
            if (at[step] if isinstance(step, int) else at.get(step)) is None:
                at[step] = empty
            at = at[step]
        return canonical(tree)

    return pd.Series([one(*x) for x in zip(document, path, value, strict=True)])


def merged(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fields (path -> value by the first proposal that sets it), sources (each once, in order), risk (the highest): what the proposals
    of one entity come to. fields: keys, pos, path, after, source, risk."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    first = fields.groupBy(*keys, "path").agg(F.min(F.struct("pos", "after")).alias("x"))
    paths = first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.col("x.after").alias("after"))))).alias("fields"))
    rest = fields.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("pos", "source"))).alias("x"), F.max(rank).alias("r"))
    out = rest.select(*keys, names.distinct(F.transform("x", lambda v: v["source"])).alias("sources"), F.coalesce(F.get(F.array(*map(F.lit, RISKS)), (F.col("r") - 1).cast("int")), F.lit("low")).alias("risk"))
    return paths.join(out, keys)


def patch_integer(c: Column) -> Column:
    """A whole number from a text; null for anything else."""
    bare = names.trimmed(c)
    return F.when(bare.rlike("^-?[0-9]+$"), bare.try_cast("bigint"))


def patch_list(c: Column) -> Column:
    """A text's lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), names.trimmed), lambda x: x != "")
