"""Choosing among link candidates, item by item. Candidates are rows (item, url, platform, confidence, ...) with columns for what they
scored; an item's candidates are few. Ties are broken by `pos`, the order in which they came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIMARY = ("bilibili", "youtube", "apple_music")
KNOWN = ("youtube", "bilibili", "apple_music", "spotify", "qobuz")


def sort_keys(confidence: Column, exactness: Column, packaging: Column, seconds: Column, uploader: Column, views: Column, title: Column) -> dict[str, Column]:
    """total, exact: what candidates are ordered by, largest first; seconds and uploader are null without a record."""
    low = F.lower(F.coalesce(title, F.lit("")))
    known = seconds.isNotNull()
    watched = F.when(views >= 8000, 0.06).when(views >= 2000, 0.04).when(views >= 500, 0.02).otherwise(0.0)
    named = F.trim(F.coalesce(uploader, F.lit(""))) != ""
    detail = F.when(known, F.when(seconds > 0, 0.03).otherwise(-0.03) + F.when(named, 0.02).otherwise(-0.02) + watched).otherwise(0.0)
    support = F.when(known, F.when(seconds > 0, 0.06).otherwise(-0.08) + F.when(named, 0.04).otherwise(-0.05) + watched).otherwise(0.0)
    old = F.when(low.rlike("new edition|remaster|restored"), -0.08).otherwise(0.0) + F.when(F.contains(low, F.lit("provided to youtube by")), -0.08).otherwise(0.0)
    return {"total": F.round(confidence + exactness + detail + old + packaging, 4), "exact": F.round(exactness + support + packaging, 4)}


def limit_by_zone(df: DataFrame, green: int = 3, yellow: int = 2) -> DataFrame:
    """The first candidates of each item, platform and zone; other zones go."""
    rank = F.row_number().over(Window.partitionBy("item", "platform", "zone").orderBy("pos"))
    return df.withColumn("_r", rank).filter(F.col("_r") <= F.when(F.col("zone") == "green", green).when(F.col("zone") == "yellow", yellow).otherwise(0)).drop("_r")


def dominant(df: DataFrame) -> DataFrame:
    """The one candidate of an item that stands out: by confidence, by its distance to the next, or by how exactly it fits."""
    w = Window.partitionBy("item").orderBy(F.desc("confidence"), "pos")
    after = Window.partitionBy("item").orderBy(F.desc("confidence"), "pos").rowsBetween(1, Window.unboundedFollowing)
    t = df.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("confidence").over(w), F.lit(0.0)), "_other": F.coalesce(F.max("exactness").over(after), F.lit(-0.05)), "_n": F.count("*").over(Window.partitionBy("item"))}).filter("_r = 1")
    c, x, known, ahead = F.col("confidence"), F.col("exactness"), F.col("platform").isin(*KNOWN), F.col("exactness") - F.col("_other")
    alone = F.col("_n") == 1
    stands_out = (c >= 0.58) | (known & (
        ((c >= 0.5) & (c - F.col("_next") >= 0.08)) | ((c >= 0.5) & (x >= 0.1) & (ahead >= 0.03 - 1e-6)) | ((c >= 0.45) & alone & (x >= 0.08)) | ((c >= 0.45) & (x >= 0.08) & (ahead >= 0.05 - 1e-6)) | ((c >= 0.5) & alone)
    ))
    return t.filter(stands_out).select(df.columns)


def champions(df: DataFrame, test: Column) -> DataFrame:
    """df with `champion`: the first candidate of each primary platform that passes the test; these come before the others (`place`)."""
    passing = test & F.col("platform").isin(*PRIMARY)
    first = F.min(F.when(passing, F.col("pos"))).over(Window.partitionBy("item", "platform"))
    out = df.withColumn("champion", F.coalesce(passing & (F.col("pos") == first), F.lit(False)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("champion"), "pos")))


def rescued(df: DataFrame, test: Column) -> DataFrame:
    """Candidates that stand in where nothing was chosen: of those that pass the test the first of each primary platform, three at most;
    without any of these the first and one more that fits nearly as exactly."""
    ok = df.filter(test).withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy("pos")))
    per = F.row_number().over(Window.partitionBy("item", "platform").orderBy("pos"))
    new = ok.withColumn("_p", F.col("platform").isin(*PRIMARY)).withColumn("_k", per)
    lead = F.col("_p") & (F.col("_k") == 1)
    new = new.withColumns({"_lead": lead, "_any": F.max(lead.cast("int")).over(Window.partitionBy("item")), "_top": F.first("exactness").over(Window.partitionBy("item").orderBy("pos"))})
    near = (F.col("_any") == 0) & ((F.col("_r") == 1) | (F.col("exactness") >= F.col("_top") - 0.03))
    kept = new.filter((F.col("_lead") & (F.col("_any") == 1)) | near)
    place = F.row_number().over(Window.partitionBy("item").orderBy("pos"))
    return kept.withColumn("_n", place).filter(F.col("_n") <= F.when(F.col("_any") == 1, 3).otherwise(2)).select(df.columns)


def accepted_first(df: DataFrame, least: Column | int) -> DataFrame:
    """Accepted candidates before the others, where an item has `least` of them, else all as they came: `place`."""
    n = F.sum(F.col("accepted").cast("int")).over(Window.partitionBy("item"))
    moved = F.when(n >= F.greatest(F.lit(1), F.lit(least)), F.col("accepted")).otherwise(F.lit(False))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(moved), "pos")))


def close_ties(df: DataFrame, gap: float = 0.01) -> DataFrame:
    """item, ties, limit: how many candidates come as close to the best as `gap`, and how many links that leaves room for."""
    top = F.max("confidence").over(Window.partitionBy("item"))
    n = df.withColumn("_tie", (F.abs(F.col("confidence") - top) <= gap).cast("int")).groupBy("item").agg(F.sum("_tie").alias("ties"))
    return n.withColumn("limit", F.when(F.col("ties") >= 3, F.least(F.lit(4), F.col("ties"))).otherwise(2))


def skips(df: DataFrame) -> DataFrame:
    """item, skip_fallback, skip_synthesis: what the scores of an item's records make needless."""
    strong = (F.trim("url") != "") & F.col("platform").isin(*KNOWN) & (F.col("score") >= 0.6)
    scored = df.withColumn("_s", F.when(F.trim("url") != "", F.col("score")))
    out = scored.groupBy("item").agg(F.max(F.when(strong, F.col("score"))).alias("best"), F.count_if(strong).alias("n"), F.slice(F.sort_array(F.collect_list("_s"), asc=False), 1, 2).alias("top"))
    first, second = F.coalesce(F.get("top", 0), F.lit(-1.0)), F.coalesce(F.get("top", 1), F.lit(0.0))
    synthesis = (first < 0) | ((first >= 0.88) & (first - second >= 0.12) & (second <= 0.45))
    return out.select("item", (F.coalesce(F.col("best") >= 0.72, F.lit(False)) | (F.col("n") >= 2)).alias("skip_fallback"), synthesis.alias("skip_synthesis"))


def normalized_records(df: DataFrame) -> DataFrame:
    """Records with texts trimmed, weights and scores between 0 and 1 (weights over 1 are of 100; 0 is 0.5), counts not below 0."""
    from shelfmark.functions.text import trimmed

    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    raw = F.coalesce(F.col("weight"), F.lit(0.0))
    weight = F.when(raw > 1, raw / 100).otherwise(raw)
    return df.withColumns({
        "url": trimmed(F.col("url")), "title": trimmed(F.col("title")), "platform": F.coalesce(F.nullif(trimmed(F.col("platform")), F.lit("")), F.lit("other")),
        "weight": unit(F.when(weight == 0, 0.5).otherwise(weight)), "score": unit(F.coalesce(F.col("score"), F.lit(0.0))),
        "seconds": F.greatest(F.lit(0), F.coalesce(F.col("seconds"), F.lit(0))), "views": F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("views"), F.lit(0).cast("long"))),
    })
