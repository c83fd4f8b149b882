"""Votes over evidence, evaluation metrics, host statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import first_per_key

# Acceptance thresholds of a field value.
FINAL, CORROBORATED = 0.85, 0.65


def field_vote(df: DataFrame, item: list[str], value: str, source: str, confidence: Column) -> DataFrame:
    """The best value of each field: most distinct sources, then confidence. Accepted at FINAL, or from two sources at CORROBORATED on average."""
    c = confidence.cast("decimal(18,6)")
    votes = df.groupBy(*item, value).agg(F.count_distinct(source).alias("sources"), F.max(c).alias("_max"), (F.sum(c).cast("double") / F.count("*")).alias("_avg"))
    best = first_per_key(votes, item, [F.desc("sources"), F.desc("_max"), F.asc(value)])
    ok = (F.col("_max") >= FINAL) | ((F.col("sources") >= 2) & (F.col("_avg") >= CORROBORATED))
    return best.select(*item, value, "sources", F.col("_max").cast("double").alias("max_confidence"), ok.alias("accepted"))


def host_health(df: DataFrame, host: str, failed: Column, latency: Column) -> DataFrame:
    """Requests, failures, failure rate, average latency and a state for each host."""
    s = df.groupBy(host).agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("failures"),
        (F.sum(latency.cast("decimal(18,4)")).cast("double") / F.count("*")).alias("avg_latency"),
    ).withColumn("failure_rate", F.col("failures") / F.col("requests"))
    bad = (F.col("requests") >= 2) & ((F.col("failures") >= 1) | (F.col("avg_latency") >= 2500))
    good = (F.col("requests") >= 2) & (F.col("failures") == 0) & (F.col("avg_latency") <= 1000)
    return s.withColumn("health", F.when(bad, "degraded").when(good, "healthy").otherwise("observing"))


def hit_metrics(df: DataFrame, variant: str, hits: dict[str, Column]) -> DataFrame:
    """Counts of hits by variant and over all (variant null), as one rollup."""
    return df.rollup(variant).agg(F.count("*").alias("evaluated"), *[F.count_if(c).alias(n) for n, c in hits.items()])


def host_advice(stats: DataFrame, timeout: float = 6.0, query_depth: int = 6, result_depth: int = 8) -> DataFrame:
    """stats (requests, failures, avg_latency, avg_results) with the timeout and depths to go on with."""
    n, rate, slow, results = F.col("requests"), F.col("failures") / F.col("requests"), F.col("avg_latency"), F.col("avg_results")
    known, clean = n >= 2, F.col("failures") == 0
    wait = F.lit(timeout) * F.when(known & ~clean, 1.2).otherwise(1.0) * F.when(known & ((rate >= 0.25) | (slow >= 2500)), 1.7).when(known & clean & (slow <= 800), 0.9).otherwise(1.0)
    queries = query_depth + F.when(known & (rate >= 0.4), -2).when(known & clean & (results >= 2), 1).when((n >= 3) & (results < 0.5), -1).otherwise(0)
    depth = F.when(known & (results >= 4), min(result_depth + 2, 12)).when((n >= 3) & (results < 1), max(result_depth - 2, 4)).otherwise(result_depth)
    return stats.withColumns({
        "timeout": F.round(F.greatest(F.lit(4.0), F.least(F.lit(14.0), wait)), 1), "query_depth": F.greatest(F.lit(2), F.least(F.lit(10), queries)), "result_depth": depth,
    })


def warning_signature(c: Column) -> Column:
    """A warning with its numbers taken out."""
    from shelfmark.functions.text import trimmed

    out = trimmed(c)
    many = "(?:、|,|，|和|及|与)"
    for pattern, to in (
        ("第[一二三四五六七八九十百千万0-9]+条URL", "第#条URL"), (f"[0-9]+(?:{many}[0-9]+)*号URL", "#号URL"), (f"候选[0-9]+(?:-[0-9]+|{many}[0-9]+)*", "候选#"), (f"记录[0-9]+(?:{many}[0-9]+)*", "记录#"),
        (r"(?i)URL\s*[0-9]+", "URL #"), (r"\b[0-9]{4}年", "<year>年"), ("多个B站视频标注为<year>年.+?音乐节，但转载来源或演奏者信息不明确，需谨慎验证", "多个B站视频标注为<year>年<festival>，但转载来源或演奏者信息不明确，需谨慎验证"),
    ):
        out = F.regexp_replace(out, pattern, to)
    return out


def warning_texts(warnings: DataFrame) -> DataFrame:
    """signature, text, status, k: every different text of warnings (text, status) by its signature, with how often it is there; all of them, as rows."""
    return warnings.select(warning_signature(F.col("text")).alias("signature"), "text", "status").groupBy("signature", "text", "status").agg(F.count("*").alias("k"))


def warning_corpus(warnings: DataFrame) -> DataFrame:
    """signature, n, texts (how many different), first_text (the smallest), statuses (status -> count) of warnings (text, status); the most frequent first
    is the reader's to order. The texts themselves, all of them, are the rows of warning_texts, so that no row grows with them."""
    each = warning_texts(warnings)
    per = each.groupBy("signature", "text").agg(F.sum("k").alias("k")).groupBy("signature").agg(F.sum("k").alias("n"), F.count("*").alias("texts"), F.min("text").alias("first_text"))
    statuses = each.groupBy("signature", "status").agg(F.sum("k").alias("k")).groupBy("signature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "k")))).alias("statuses"))
    return per.join(statuses, "signature").select("signature", "n", "texts", "first_text", "statuses")


def alignment(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, aligned, mismatched, absent: how two tables of one row a key agree, field by field; absent: the field is '' or null on a side, or the
    key is on one side alone. A null key is a key."""
    from shelfmark.functions.text import trimmed

    side = lambda df, s: df.select(F.col(key).alias(f"{s}_key"), *(trimmed(F.col(c)).alias(f"{s}_{i}") for i, c in enumerate(fields)))
    both = side(ours, "a").join(side(theirs, "b"), F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer")
    pair = lambda i, c: F.struct(F.lit(c).alias("field"), F.coalesce(f"a_{i}", F.lit("")).alias("a"), F.coalesce(f"b_{i}", F.lit("")).alias("b"))
    each = both.select(F.explode(F.array(*(pair(i, c) for i, c in enumerate(fields)))).alias("x")).select("x.*")
    gone = (F.col("a") == "") | (F.col("b") == "")
    return each.groupBy("field").agg(F.count_if(~gone & (F.col("a") == F.col("b"))).alias("aligned"), F.count_if(~gone & (F.col("a") != F.col("b"))).alias("mismatched"), F.count_if(gone).alias("absent"))
