"""A folder of old pages as a library: composers, people, groups, works and recordings by where a page lies and what it says, and a queue of
what needs a look."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import legacy, names, rules

# The folders of composers (with their works below), conductors and soloists (by kind).
COMPOSERS, CONDUCTORS, SOLOISTS = "作曲家", "指挥家", "独奏家"


def pages(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), html: every .htm file at any depth, each read whole by one task."""
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[hH][tT][mM]").text(root, wholetext=True)
    named = files.select(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/").alias("_p"), F.col("value").alias("html"))
    return named.select(F.substring("_p", F.length(base) + 2, F.length("_p")).alias("path"), "html")


def _bio(df: DataFrame, fallback) -> DataFrame:
    """name, nameLatin, summary of pages about people: the first paragraph names them, the others tell of them."""
    texts = F.filter(F.transform("page.paragraphs", lambda p: legacy.flat(p["text"])), lambda x: x != "")
    pair = legacy.name_pair(F.coalesce(F.get(texts, 0), fallback), fallback)
    return df.select("path", fallback.alias("fallback"), pair["name"].alias("name"), pair["latin"].alias("nameLatin"), F.array_join(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), "\n\n").alias("summary"))


def imported(found: DataFrame) -> dict[str, DataFrame]:
    """composers, people, workGroups, works, recordings and review of pages (path, html).

    A page in a composer's folder itself is about the composer; one further down is a recording's of the folder that it lies in, or tells of the
    work where it has the folder's name. People are one by name key: the first page by path names them, and their roles come together.
    review: entity, issue, sourcePath: recordings without a day, an image, all of album, label and release, with links that
    rules.link_issues finds fault with, and pages whose path says nothing ('unsupported-path')."""
    read = found.withColumn("page", legacy.outline("html")).drop("html").withColumn("_parts", F.split("path", "/"))
    top, depth, stem = F.get("_parts", 0), F.size("_parts"), F.regexp_replace(F.element_at("_parts", -1), r"(?i)\.htm$", "")
    bios = read.filter((top == COMPOSERS) & (depth == 3))
    composers = _bio(bios, F.get("_parts", 1)).withColumn("key", names.name_key(F.col("fallback")))
    folders = read.filter((top == COMPOSERS) & (depth >= 3)).select(F.get("_parts", 1).alias("name")).distinct().withColumn("key", names.name_key(F.col("name")))
    about = composers.groupBy("key").agg(F.min_by(F.struct("name", "nameLatin", "summary"), "path").alias("x"))
    made = folders.groupBy("key").agg(F.min("name").alias("name")).join(about, "key", "left")
    other = F.when(names.name_key(F.col("x.name")) != F.col("key"), F.array(F.col("x.name"))).otherwise(names.none())
    out = {"composers": made.select(F.concat(F.lit("composer-"), "key").alias("id"), "name", F.coalesce("x.nameLatin", F.lit("")).alias("nameLatin"), other.alias("aliases"), F.coalesce("x.summary", F.lit("")).alias("summary"))}
    people = _bio(read.filter(((top == CONDUCTORS) & (depth == 2)) | ((top == SOLOISTS) & (depth == 3))), stem).withColumn("role", F.when(F.col("path").startswith(CONDUCTORS), "conductor").otherwise("soloist"))
    keyed = people.withColumn("key", names.name_key(F.col("name"))).groupBy("key").agg(
        F.min_by("name", "path").alias("name"), F.min_by(F.nullif("nameLatin", F.lit("")), F.when(F.col("nameLatin") != "", F.col("path"))).alias("_l"), F.min_by("summary", F.when(F.col("summary") != "", F.col("path"))).alias("_s"), F.array_sort(F.collect_set("role")).alias("roles")
    )
    out["people"] = keyed.select(F.concat(F.lit("person-"), "key").alias("id"), "name", F.coalesce("_l", F.lit("")).alias("nameLatin"), "roles", F.coalesce("_s", F.lit("")).alias("summary"))
    deep = read.filter((top == COMPOSERS) & (depth >= 4)).withColumn("at", legacy.work_path(F.col("path")))
    placed = deep.filter("at IS NOT NULL").withColumn("composerId", F.concat(F.lit("composer-"), names.name_key(F.col("at.composer")))).withColumn("workId", F.concat_ws("/", F.lit("work"), "composerId", F.array_join("at.groups", "/"), "at.work"))
    groups = placed.select("composerId", F.explode(F.transform("at.groups", lambda g, i: F.slice("at.groups", F.lit(1), i + 1))).alias("path")).distinct()
    out["workGroups"] = groups.select(F.concat_ws("/", F.lit("group"), "composerId", F.array_join("path", "/")).alias("id"), "composerId", F.element_at("path", -1).alias("title"), "path")
    is_summary = F.col("at.file") == F.col("at.work")
    told = _bio(placed.filter(is_summary).withColumn("_w", F.col("at.work")), F.col("at.work")).join(placed.filter(is_summary).select("path", "workId"), "path").groupBy("workId").agg(F.min_by(F.struct("name", "nameLatin", "summary"), "path").alias("x"))
    works = placed.groupBy("workId").agg(F.first("composerId").alias("composerId"), F.first("at.groups").alias("_g"), F.first("at.work").alias("_w")).join(told, "workId", "left")
    chain = F.transform("_g", lambda g, i: F.concat_ws("/", F.lit("group"), F.col("composerId"), F.array_join(F.slice("_g", F.lit(1), i + 1), "/")))
    out["works"] = works.select(F.col("workId").alias("id"), "composerId", chain.alias("groupIds"), F.coalesce("x.name", "_w").alias("title"), F.coalesce("x.nameLatin", F.lit("")).alias("titleLatin"), F.coalesce("x.summary", F.lit("")).alias("summary"))
    spoken = placed.filter(~is_summary).withColumn("said", legacy.said(F.col("page.paragraphs")))
    recordings = spoken.select(F.concat(F.lit("recording/"), "path").alias("id"), "workId", F.col("at.file").alias("title"), F.col("path").alias("legacyPath"), *(c.alias(n) for n, c in legacy.recording_fields(F.col("page")).items()))
    out["recordings"] = recordings
    issue = lambda code, test: F.when(test, F.lit(code))
    codes = F.concat(
        F.array_compact(F.array(issue("missing-performance-date", F.col("performanceDateText") == ""), issue("missing-image", F.size("images") == 0), issue("missing-album-metadata", (F.col("albumTitle") == "") & (F.col("label") == "") & (F.col("releaseDate") == "")))),
        F.transform(F.flatten(F.transform("links", rules.link_issues)), lambda x: F.concat(F.lit("resource-link-"), x)),
    )
    faults = [recordings.select(F.col("id").alias("entity"), F.explode(codes).alias("issue"), F.col("legacyPath").alias("sourcePath")), deep.filter("at IS NULL").select(F.lit(None).cast("string").alias("entity"), F.lit("unsupported-path").alias("issue"), F.col("path").alias("sourcePath"))]
    out["review"] = reduce(DataFrame.unionByName, faults)
    return out
