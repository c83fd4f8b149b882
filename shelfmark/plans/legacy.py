"""The named query of old pages, with SQL that reads the same pages' parts by the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import legacy

from .catalogue import query

_LABELS = ("时间地点", "Date", "指挥", "Conductor", "交响乐团", "Orchestra", "钢琴独奏", "Mezzo Soprano", "女高音", "专辑名", "Album", "唱片公司", "Publisher", "发行日期", "Release Date", "合唱", "备注", "Piano")
#: Values of paragraphs, by the place of their label: texts of columns, in both dialects.
_VALUES = "CASE k % 4 WHEN 0 THEN concat(o_orderdate_text, ', ', o_orderpriority) WHEN 1 THEN concat(o_orderpriority, ' & ', o_orderstatus) WHEN 2 THEN concat('Name ', o_custkey) ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE concat(o_orderdate_text, '，Saal ', o_custkey, ', 1999') END END"
_N = len(_LABELS)


def old_pages(t):
    """o_orderkey, html: eight paragraphs with labels in an order of their own for each, some unclosed, some with a link for a name."""
    o = t("orders").withColumn("o_orderdate_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    each = o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate_text", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).withColumn("k", F.expr(f"(o_orderkey * 5 + j * 7) % {_N}"))
    label = F.get(F.array(*map(F.lit, _LABELS)), F.col("k").cast("int"))
    value = F.replace(F.expr(_VALUES), F.lit("&"), F.lit("&amp;"))
    named = F.when(F.expr("(k + o_orderkey) % 5 = 1"), F.concat(F.lit("<a href=' https://www.youtube.com/watch?v="), F.col("o_orderkey").cast("string"), F.lit("'>\n Link  of "), F.col("o_custkey").cast("string"), F.lit(" </a> more "), value)).otherwise(value)
    mark = F.when(F.col("k") % 2 == 0, "：").otherwise(" : ")
    text = F.concat(F.lit("<p class=x>\n  "), label, mark, named, F.when(F.col("j") % 3 == 1, "").otherwise("</p>"))
    whole = each.select("o_orderkey", F.struct("j", text.alias("t")).alias("x")).groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("b"))
    head = "<html><head><script>var a='<p>Date: x</p>';</script></head><body><img src=' a.jpg ' alt='A  b'><img><p>no label</p><a href='/local'>here</a>"
    return whole.select("o_orderkey", F.concat(F.lit(head), "b", F.lit("<div>Album: not in a paragraph</div></body>")).alias("html"))


def _has(label: str, held: tuple[str, ...], equal: tuple[str, ...]) -> str:
    return f"({' OR '.join(f'contains({label}, ' + chr(39) + h + chr(39) + ')' for h in held)} OR trim(regexp_replace(lower({label}), '[^a-z]+', ' ', 'g')) IN ({', '.join(chr(39) + e + chr(39) for e in equal)}))"


_ROLE = "CASE " + " ".join(f"WHEN {_has('label', h, e)} THEN '{r}'" for r, h, e in legacy.ROLES) + " ELSE 'soloist' END"


@query(f"""WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_text FROM orders),
e AS (SELECT *, (o_orderkey * 5 + j * 7) % {_N} AS k FROM o, (SELECT unnest(generate_series(0, 7)) AS j)),
v AS (SELECT *, [{", ".join(f"'{x}'" for x in _LABELS)}][k + 1] AS label, (k + o_orderkey) % 5 = 1 AS linked, {_VALUES} AS raw FROM e),
w AS (SELECT *, CASE WHEN linked THEN 'Link of ' || o_custkey || ' more ' || raw ELSE raw END AS val, CASE WHEN linked THEN 'Link of ' || o_custkey ELSE raw END AS who FROM v),
s AS (SELECT *, CASE WHEN {_has("label", legacy.DATES, legacy.DATES_EN)} THEN 'when' WHEN {_has("label", legacy.ALBUMS, legacy.ALBUMS_EN)} THEN 'album' WHEN {_has("label", legacy.LABELS, legacy.LABELS_EN)} THEN 'label'
  WHEN {_has("label", legacy.RELEASES, legacy.RELEASES_EN)} THEN 'release' WHEN {_has("label", legacy.CREDITS, legacy.CREDITS_EN)} THEN 'credit' ELSE 'other' END AS kind FROM w),
g AS (SELECT o_orderkey, coalesce(arg_max(val, j) FILTER (kind = 'when'), '') AS d, coalesce(arg_max(val, j) FILTER (kind = 'album'), '') AS album, coalesce(arg_max(val, j) FILTER (kind = 'label'), '') AS label, coalesce(arg_max(val, j) FILTER (kind = 'release'), '') AS released,
  coalesce(string_agg({_ROLE} || ':' || who || ':' || label, '|' ORDER BY j) FILTER (kind = 'credit' AND lower(who) NOT IN ('unknown', '-', '未知')), '') AS credits, count(*) FILTER (linked) AS n_links FROM s GROUP BY o_orderkey),
c AS (SELECT *, regexp_extract(d, '^(.+)，([^，]*)$', 2) AS p1, regexp_extract(d, '^(.+),([^,]*)$', 2) AS p2 FROM g)
SELECT o_orderkey, CASE WHEN trim(p1) <> '' AND NOT regexp_matches(trim(p1), '^[0-9]{{4}}') THEN trim(regexp_extract(d, '^(.+)，([^，]*)$', 1)) WHEN trim(p2) <> '' AND NOT regexp_matches(trim(p2), '^[0-9]{{4}}') THEN trim(regexp_extract(d, '^(.+),([^,]*)$', 1)) ELSE d END AS day,
CASE WHEN trim(p1) <> '' AND NOT regexp_matches(trim(p1), '^[0-9]{{4}}') THEN trim(p1) WHEN trim(p2) <> '' AND NOT regexp_matches(trim(p2), '^[0-9]{{4}}') THEN trim(p2) ELSE '' END AS place, album, label, released, credits, CAST(n_links AS BIGINT) AS n_links,
CASE WHEN n_links > 0 THEN 'youtube' ELSE '' END AS platform, 'a.jpg A b' AS image FROM c""")
def legacy_pages(t):
    """Old pages of recordings: day and place, album, label, release, credits by their labels, links, images (op S13)."""
    read = old_pages(t).withColumn("page", legacy.outline("html")).withColumn("said", legacy.said(F.col("page.paragraphs")))
    out = read.select("o_orderkey", *(c.alias(n) for n, c in legacy.recording_fields(F.col("page")).items()))
    return out.select(
        "o_orderkey", F.col("performanceDateText").alias("day"), F.col("venueText").alias("place"), F.col("albumTitle").alias("album"), "label", F.col("releaseDate").alias("released"),
        F.array_join(F.transform("credits", lambda x: F.concat_ws(":", x["role"], x["displayName"], x["label"])), "|").alias("credits"), F.size("links").cast("long").alias("n_links"), F.coalesce(F.get("links", 0)["platform"], F.lit("")).alias("platform"),
        F.array_join(F.transform("images", lambda x: F.concat_ws(" ", x["src"], x["alt"])), "|").alias("image"),
    )
