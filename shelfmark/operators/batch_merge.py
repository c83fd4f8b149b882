"""A batch of drafts put into a library: what confirmed entries bring with them, and the collections afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import trimmed
from shelfmark.operators import shared

COLLECTIONS = ("composers", "people", "workGroups", "works", "recordings")


def references(lib: dict[str, DataFrame]) -> DataFrame:
    """from_kind, from_id, to_kind, to_id: a recording's work and credited people, a work's composer and groups; '' names nothing."""
    row = lambda df, kind, to, c: df.select(F.lit(kind).alias("from_kind"), F.col("id").alias("from_id"), F.lit(to).alias("to_kind"), c.alias("to_id"))
    works, recordings = lib["works"], lib["recordings"]
    parts = [
        row(recordings, "recordings", "works", F.col("workId")), row(works, "works", "composers", F.col("composerId")), row(works, "works", "workGroups", F.explode("groupIds")),
        row(recordings, "recordings", "people", F.explode(F.transform("credits", lambda c: trimmed(c["personId"])))),
    ]
    return reduce(DataFrame.unionByName, parts).filter("to_id <> ''").distinct()


def ids(lib: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [lib[k].select(F.lit(k).alias("kind"), "id") for k in COLLECTIONS])


def selection(confirmed: DataFrame, draft: dict[str, DataFrame], base: dict[str, DataFrame]) -> DataFrame:
    """kind, id, steps: confirmed entries (kind, id; steps 0) and all that they lead to in the draft library and the base lacks.

    A search by rounds over the references, from what the round before found; it ends when a round finds nothing new, so kinds may refer to each
    other in any depth. Every round reads the references of the last found entries alone; entries that very many others refer to combine
    before the shuffle."""
    present = ids(base).select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id"))
    edges = shared.written(references(draft).join(present, ["to_kind", "to_id"], "left_anti"))
    found = front = shared.written(confirmed.select("kind", "id").filter("id <> ''").distinct().withColumn("steps", F.lit(0)))
    rounds = [found]
    while True:
        start = front.select(F.col("kind").alias("from_kind"), F.col("id").alias("from_id"))
        reached = edges.join(start, ["from_kind", "from_id"], "left_semi").select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).distinct()
        front = shared.written(reached.join(found, ["kind", "id"], "left_anti").withColumn("steps", F.lit(len(rounds))))
        if front.isEmpty():
            shared.drop(edges, front)
            return found
        rounds.append(front)
        found = reduce(DataFrame.unionByName, rounds)


def merged(base: dict[str, DataFrame], draft: dict[str, DataFrame], selected: DataFrame) -> dict[str, DataFrame]:
    """The base's collections with the selected entries as the draft has them: in place of those of their id, or new. Selected ids that the draft
    lacks change nothing."""
    out = {}
    for kind in COLLECTIONS:
        new = draft[kind].join(selected.filter(F.col("kind") == kind).select("id").distinct(), "id", "left_semi")
        out[kind] = base[kind].join(new.select("id"), "id", "left_anti").unionByName(new)
    return out
