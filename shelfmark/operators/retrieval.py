"""Requests for recordings of a library, and what results of them change there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import rules
from shelfmark.functions.text import trimmed

# Kinds of works, fields that a request asks for, fields that a result sets.
HINTS = ("orchestral", "concerto", "opera_vocal", "chamber_solo")
REQUESTED = ("links", "performanceDateText", "venueText", "albumTitle", "label", "releaseDate", "notes", "images")
SCALARS = ("performanceDateText", "venueText", "albumTitle", "label", "releaseDate", "notes")


def hint(c: Column) -> Column:
    low = F.lower(trimmed(c))
    return F.when(low.isin(*HINTS), low).otherwise("unknown")


def _or_blank(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def requests(lib: dict[str, DataFrame], overrides: DataFrame | None = None) -> DataFrame:
    """itemId, recordingId, workId, composerId, workTypeHint, sourceLine, seed (what is known), requestedFields: one row a recording; unknown works and
    composers leave their fields ''. overrides: id, workTypeHint, sourceLine, one row an id at most."""
    works = lib["works"].select(F.col("id").alias("workId"), "composerId", F.col("title").alias("_work"), F.col("titleLatin").alias("_work_latin"), F.col("catalogue").alias("_catalogue"))
    composers = lib["composers"].select(F.col("id").alias("composerId"), F.col("name").alias("_composer"), F.col("nameLatin").alias("_composer_latin"))
    r = lib["recordings"]
    own = r.select("id", "workId", F.struct(*(_or_blank(r, n).alias(n) for n in ("title", *SCALARS))).alias("own"), "credits", "links")
    joined = own.join(works, "workId", "left").join(composers, "composerId", "left")
    joined = joined.join(overrides.select("id", F.col("workTypeHint").alias("_hint"), F.col("sourceLine").alias("_line")), "id", "left") if overrides is not None else joined.withColumns({"_hint": F.lit(""), "_line": F.lit("")})
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    credits = F.transform(F.coalesce("credits", F.array().cast(r.schema["credits"].dataType)), lambda c: F.struct(c["role"].alias("role"), *(trimmed(c[k]).alias(k) for k in ("personId", "displayName", "label"))))
    links = F.transform(F.coalesce("links", F.array().cast(r.schema["links"].dataType)), lambda x: F.struct(x["platform"].alias("platform"), x["url"].alias("url"), trimmed(x["title"]).alias("title")))
    seed = F.struct(
        F.col("own.title").alias("title"), known("_composer").alias("composerName"), known("_composer_latin").alias("composerNameLatin"), known("_work").alias("workTitle"), known("_work_latin").alias("workTitleLatin"), known("_catalogue").alias("catalogue"),
        *(F.col(f"own.{n}").alias(n) for n in SCALARS), credits.alias("credits"), links.alias("links"),
    )
    return joined.select(
        F.col("id").alias("itemId"), F.col("id").alias("recordingId"), "workId", known("composerId").alias("composerId"), hint(F.col("_hint")).alias("workTypeHint"), trimmed(F.col("_line")).alias("sourceLine"), seed.alias("seed"),
        F.array(*map(F.lit, REQUESTED)).alias("requestedFields"),
    )


def _once(links: Column) -> Column:
    """The first link of each address, whatever its case."""
    return F.filter(links, lambda x, i: F.array_position(F.transform(links, lambda y: F.lower(trimmed(y["url"]))), F.lower(trimmed(x["url"]))) == i + 1)


def proposals(recordings: DataFrame, results: DataFrame) -> DataFrame:
    """id, entityId, summary, risk, fields (path, before, after; lists as JSON), links, images, warnings: what results come to, of those that
    succeeded, in part at least, for recordings that there are, where they change something or bring images.

    results: item, status, confidence, warnings, and of the result the SCALARS that it has, links and link_candidates (platform, url, title), images (src,
    sourceUrl, attribution, title). A field's new text counts where it isn't '' and isn't the old one; links are added to the recording's,
    each address once, and count where the list becomes another."""
    shape = "array<struct<platform:string,url:string,title:string>>"
    plain = lambda c, fill: F.filter(F.transform(F.coalesce(c, F.array().cast(shape)), lambda x: F.struct(
        (F.when(trimmed(x["platform"]) == "", rules.link_platform(x["url"])).otherwise(trimmed(x["platform"])) if fill else x["platform"]).alias("platform"), trimmed(x["url"]).alias("url"), trimmed(x["title"]).alias("title"))), lambda x: x["url"] != "")
    none = F.array().cast("array<string>")
    r = recordings.select(F.col("id").alias("item"), "title", *(_or_blank(recordings, n).alias(f"_{n}") for n in SCALARS), F.coalesce(F.transform("links", lambda x: F.struct(*(x[k].alias(k) for k in ("platform", "url", "title")))), F.array().cast(shape)).alias("_links"))
    met = results.filter(F.col("status").isin("succeeded", "partial")).join(r, "item")
    kept = F.filter(F.transform("_links", lambda x: F.struct(F.when(trimmed(x["platform"]) == "", rules.link_platform(x["url"])).otherwise(x["platform"]).alias("platform"), x["url"].alias("url"), trimmed(x["title"]).alias("title"))), lambda x: x["url"] != "")
    met = met.withColumn("_new", _once(F.concat(kept, plain(F.col("links"), True)))).withColumn("links", _once(F.concat(plain(F.col("link_candidates"), True), plain(F.col("links"), True))))
    images = F.filter(F.transform(F.coalesce("images", F.array().cast(results.schema["images"].dataType)), lambda x, i: F.struct(
        F.concat(F.lit("image-"), (i + 1).cast("string")).alias("id"), trimmed(x["src"]).alias("src"), F.when(trimmed(x["sourceUrl"]) == "", trimmed(x["src"])).otherwise(trimmed(x["sourceUrl"])).alias("sourceUrl"), trimmed(x["attribution"]).alias("attribution"), trimmed(x["title"]).alias("title"),
    )), lambda x: x["src"] != "")
    met = met.withColumn("images", images).withColumn("images", F.filter("images", lambda x, i: F.array_position(F.transform("images", lambda y: y["src"]), x["src"]) == i + 1))
    patch = lambda n: F.when((trimmed(F.col(n)) != "") & (trimmed(F.col(n)) != trimmed(F.col(f"_{n}"))), F.struct(F.lit(n).alias("path"), F.col(f"_{n}").alias("before"), trimmed(F.col(n)).alias("after")))
    links = F.when((F.size("_new") > 0) & (F.to_json("_new") != F.to_json("_links")), F.struct(F.lit("links").alias("path"), F.to_json("_links").alias("before"), F.to_json("_new").alias("after")))
    out = met.withColumn("fields", F.array_compact(F.array(*(patch(n) for n in SCALARS if n in results.columns), links))).filter((F.size("fields") > 0) | (F.size("images") > 0))
    risk = F.when((F.col("status") == "partial") | (F.col("confidence") < 0.7), "medium").otherwise("low")
    return out.select(F.concat(F.lit("proposal-"), "item").alias("id"), F.col("item").alias("entityId"), F.concat(F.lit("补充版本检索结果："), "title").alias("summary"), risk.alias("risk"), "fields", "links", "images", F.coalesce("warnings", none).alias("warnings"))
