"""Result rows of several hosts or queries, merged item by item: (item, source, pos, url). Branches of rows follow each other; an address
counts once, whatever its case, where it comes first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import trimmed

DEPTH = 12


def host_priority(host: Column) -> Column:
    """struct(late, name): the primary platforms first, in their order."""
    h = F.lower(F.coalesce(host, F.lit("")))
    put = lambda n, mark: F.struct(F.lit(n).alias("late"), F.concat(F.lit(mark), h).alias("name"))
    return F.when(h.rlike(r"youtube\.com|youtu\.be"), put(0, "1-")).when(h.rlike(r"bilibili\.com|b23\.tv"), put(0, "0-")).when(h.rlike(r"apple\.com"), put(0, "2-")).otherwise(put(1, ""))


def merged(branches: list[DataFrame], limit: int | None = None) -> DataFrame:
    """item, url, source, place: rows of the branches in turn, within one by source and place."""
    parts = [b.select(F.lit(i).alias("branch"), "item", "source", "pos", trimmed(F.col("url")).alias("url")) for i, b in enumerate(branches)]
    every = reduce(DataFrame.unionByName, parts).filter("url <> ''")
    first = every.groupBy("item", F.lower("url").alias("_key")).agg(F.min(F.struct("branch", "source", "pos", "url")).alias("x"))
    out = first.select("item", "x.url", "x.source", F.row_number().over(Window.partitionBy("item").orderBy("x.branch", "x.source", "x.pos", "x.url")).alias("place"))
    return out if limit is None else out.filter(F.col("place") <= limit)


def merged_hosts(rows: DataFrame, host: str = "host") -> DataFrame:
    """Rows of hosts (host; source is its number): two of each primary host first, then ten of the video platforms and four of the others;
    twelve of a host that is alone. pos counts from 0."""
    h = F.lower(F.col(host))
    alone = F.size(F.collect_set("source").over(Window.partitionBy("item"))) == 1
    cap = F.when(alone, DEPTH).when(h.rlike(r"youtube\.com|youtu\.be|bilibili\.com|b23\.tv"), 10).otherwise(4)
    held = rows.withColumns({"_cap": cap, "_late": host_priority(F.col(host))["late"]})
    return merged([held.filter("_late = 0 AND pos < 2"), held.filter("pos < _cap")])


def merged_trusted(api: DataFrame, browser: DataFrame, engine: DataFrame, mismatch: bool) -> DataFrame:
    """Rows of the browser, the interface and the engine, twelve an item; where the interface's parser is off, only those of its rows count
    that another source has too."""
    key = lambda df: df.withColumn("_key", F.lower(F.regexp_replace(trimmed(F.col("url")), "/+$", "")))
    if mismatch:
        trusted = key(browser.unionByName(engine)).filter("_key <> ''").select("item", "_key").distinct()
        api = key(api).join(trusted, ["item", "_key"], "left_semi").drop("_key")
    return merged([browser, api, engine], DEPTH)


def merged_queries(rows: DataFrame, depth: int) -> DataFrame:
    """Rows of queries (source from 0): most of the first two, one of each other, then the rest; `depth` in all."""
    head = F.when(F.col("source") == 0, max(1, depth - 3)).when(F.col("source") == 1, max(1, depth - 6)).otherwise(0)
    return merged([rows.filter(F.col("pos") < head), rows.filter("source > 1 AND pos < 1"), rows], depth)
