"""Selections by request, merges of entities, edits by hand and what they touch. Requests and edits are tables; ids that are null select
nothing; a selection that is not given selects all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names, rules
from shelfmark.functions.text import trimmed

from . import indexes, resolve

METADATA = ("performanceDateText", "venueText", "albumTitle", "label", "releaseDate")


def _ids(request: dict[str, DataFrame], kind: str, as_: str) -> DataFrame | None:
    """request holds a frame of one column `id` for each selection that is given."""
    return None if request.get(kind) is None else request[kind].select(F.col("id").alias(as_)).distinct()


def recordings_by_request(lib: dict[str, DataFrame], request: dict[str, DataFrame]) -> DataFrame:
    """Recordings that all given selections hold: recordings, works, composers (through works), and people in a credit: conductors and
    orchestras in that role, artists in any."""
    r = lib["recordings"]
    for kind, column in (("recordings", "id"), ("works", "workId")):
        if (ids := _ids(request, kind, column)) is not None:
            r = r.join(ids, column, "left_semi")
    if (ids := _ids(request, "composers", "composerId")) is not None:
        r = r.join(lib["works"].join(ids, "composerId", "left_semi").select(F.col("id").alias("workId")), "workId", "left_semi")
    for kind, role in (("conductors", "conductor"), ("artists", None), ("orchestras", "orchestra")):
        if (ids := _ids(request, kind, "_person")) is not None:
            credit = lib["recordings"].select("id", F.explode("credits").alias("c"))
            credit = credit if role is None else credit.filter(F.col("c.role") == role)
            r = r.join(credit.select("id", F.col("c.personId").alias("_person")).join(ids, "_person", "left_semi"), "id", "left_semi")
    return r


def works_by_request(lib: dict[str, DataFrame], request: dict[str, DataFrame]) -> DataFrame:
    """Works that all given selections hold; selections of people go by the works' recordings."""
    w = lib["works"]
    for kind, column in (("works", "id"), ("composers", "composerId")):
        if (ids := _ids(request, kind, column)) is not None:
            w = w.join(ids, column, "left_semi")
    if (ids := _ids(request, "recordings", "id")) is not None:
        w = w.join(lib["recordings"].join(ids, "id", "left_semi").select(F.col("workId").alias("id")), "id", "left_semi")
    if any(request.get(k) is not None for k in ("conductors", "artists", "orchestras")):
        w = w.join(recordings_by_request(lib, request).select(F.col("workId").alias("id")), "id", "left_semi")
    return w


def merge_people(lib: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """lib with people merged: pairs (duplicate, primary), each person in one pair at most. The primary keeps what it has and takes what it
    lacks; roles and names are united; credits of the duplicate point at the primary."""
    p = lib["people"]
    of = p.join(pairs, F.col("id") == F.col("duplicate"))
    other = of.select(F.col("primary").alias("id"), F.struct(*[c for c in p.columns if c != "id"]).alias("_o"))
    kept = ("id", "slug", "sortKey", "updatedAt")
    joined = p.join(pairs.select(F.col("duplicate").alias("id")), "id", "left_anti").join(other, "id", "left")

    def value(c: str, kind: str) -> Column:
        mine, its = F.col(c), F.col(f"_o.{c}")
        if c == "roles":
            return names.distinct(F.concat(mine, F.coalesce(its, names.none())))
        if c == "aliases":
            every = names.distinct(F.concat(F.coalesce(mine, names.none()), F.coalesce(its, names.none()), F.array(F.col("_o.name"), F.col("_o.nameLatin"))))
            return F.when(F.col("_o").isNull(), mine).otherwise(F.filter(every, lambda x: (x != trimmed(F.col("name"))) & (x != trimmed(F.col("nameLatin")))))
        if c in kept or kind.startswith("array"):
            return mine
        return F.when((F.coalesce(F.trim(mine.cast("string")), F.lit("")) == "") & F.col("_o").isNotNull(), its).otherwise(mine)

    merged = joined.select(*(value(c, kind).alias(c) for c, kind in p.dtypes))
    to = pairs.select(F.col("duplicate").alias("_d"), F.col("primary").alias("_p"))
    each = lib["recordings"].select("id", F.posexplode("credits").alias("pos", "c")).join(to, F.col("c.personId") == F.col("_d"), "left")
    each = each.withColumn("c", F.col("c").withField("personId", F.coalesce("_p", F.col("c.personId"))))
    back = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("x")).select("id", F.col("x.c").alias("_new"))
    recordings = lib["recordings"].join(back, "id", "left").withColumn("credits", F.coalesce("_new", "credits")).drop("_new")
    return lib | {"people": merged, "recordings": recordings}


def backfilled(recordings: DataFrame, entries: DataFrame) -> DataFrame:
    """recordings edited by hand. entries: id, removeCredits, credits (arrays of credits), metadata (map), one an id. A removal takes all
    credits that agree in what it names; new credits come after the others, each once; metadata replace what is there."""
    e = entries.select("id", F.col("removeCredits").alias("_gone"), F.col("credits").alias("_more"), F.col("metadata").alias("_set"))
    j = recordings.join(e, "id", "left")
    agrees = lambda want, has: (trimmed(want) == "") | (trimmed(want) == trimmed(has))
    hit = lambda c, g: agrees(g["role"], c["role"]) & agrees(g["displayName"], c["displayName"]) & agrees(g["personId"], c["personId"])
    left = F.when(F.col("_gone").isNull(), F.col("credits")).otherwise(F.filter("credits", lambda c: ~F.exists("_gone", lambda g: hit(c, g))))
    key = lambda c: F.concat_ws("::", trimmed(c["role"]), trimmed(c["personId"]), trimmed(c["displayName"]))
    plain = F.transform("_more", lambda c: F.struct(c["role"].alias("role"), trimmed(c["personId"]).alias("personId"), trimmed(c["displayName"]).alias("displayName"), trimmed(c["label"]).alias("label")))
    fresh = F.filter(plain, lambda c, i: (c["displayName"] != "") & (F.array_position(F.transform(plain, key), key(c)) == i + 1) & ~F.exists("_left", lambda h: key(h) == key(c)))
    out = j.withColumn("_left", left).withColumn("credits", F.when(F.col("_more").isNull(), F.col("_left")).otherwise(F.concat("_left", fresh)))
    new = {c: F.coalesce(F.trim(F.try_element_at("_set", F.lit(c))), F.col(c)) for c in METADATA if c in recordings.columns}
    return out.withColumns(new).select(recordings.columns)


def repaired_metadata(day: Column, place: Column) -> Column:
    """struct(day, place): placeholders are '', a place in the day's field goes where it belongs, 'day / place' is split."""
    blank = lambda c: F.when(F.lower(trimmed(c)).isin("", "-", "*", "unknown", "未知"), "").otherwise(trimmed(c))
    a, b = blank(day), blank(place)
    number = lambda c: c.rlike("[0-9]")
    put = lambda x, y: F.struct(x.alias("day"), y.alias("place"))
    parts = F.split(a, " / ")
    return (
        F.when((a != "") & (b != "") & ~number(a) & number(b), put(b, a)).when((a != "") & (b == "") & ~number(a), put(F.lit(""), a))
        .when((b == "") & F.contains(a, F.lit(" / ")), put(trimmed(parts[0]), trimmed(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " / ")))).otherwise(put(a, b))
    )


def affected_paths(lib: dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """entity_type, id, path: pages to build again when an entity is edited. The pages that every edit touches are not listed: the front
    page, the search page and the page about the site."""
    c, p, w, r = (lib[k] for k in ("composers", "people", "works", "recordings"))
    row = lambda df, kind, i, path: df.select(F.lit(kind).alias("entity_type"), F.col(i).alias("id"), path.alias("path"))
    own = indexes.canonical_people(p, resolve.alias_closure(links)).filter("id = canonical").select("id").join(p.select("id", "roles", "slug"), "id")
    page = rules.person_href(F.col("roles"), F.col("slug"))
    role = lambda x: p.filter(F.array_contains("roles", x))
    slug = c.select(F.col("id").alias("composerId"), F.col("slug").alias("_c"))
    of_work = w.select("id", "composerId").join(slug, "composerId")
    at = lambda kind, col: rules.href(kind, F.col(col))
    credit = r.select(F.col("id").alias("recording"), F.explode("credits.personId").alias("_p")).join(own.select(F.col("id").alias("_p"), page.alias("_page")), "_p")
    made = r.select(F.col("id").alias("recording"), F.col("workId").alias("_w")).join(w.select(F.col("id").alias("_w"), "composerId"), "_w")
    parts = [
        row(c, "composer", "id", at("composers", "slug")), row(c, "composer", "id", F.lit("/composers/")), row(own, "person", "id", page), row(role("composer"), "person", "id", F.lit("/composers/")),
        row(role("composer"), "person", "id", at("composers", "slug")), row(role("conductor"), "person", "id", F.lit("/conductors/")), row(role("orchestra"), "person", "id", at("orchestras", "slug")),
        row(w, "work", "id", at("works", "id")), row(of_work, "work", "id", at("composers", "_c")), row(r, "recording", "id", at("recordings", "id")), row(made, "recording", "recording", at("works", "_w")),
        row(made.join(slug, "composerId"), "recording", "recording", at("composers", "_c")), row(credit, "recording", "recording", F.col("_page")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()
