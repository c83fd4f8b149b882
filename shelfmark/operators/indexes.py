"""Indexes over a library: search entries of six kinds, people under their canonical entry, who performs what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names, rules

from . import display, resolve


def canonical_people(people: DataFrame, closed: DataFrame) -> DataFrame:
    """id, canonical: where a person's aliases lead, of links closed by resolve.alias_closure; oneself without any."""
    ends = closed.select(F.col("alias").alias("id"), F.col("canonical"))
    return people.select("id").join(ends, "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))


def moved_credits(recordings: DataFrame, people: DataFrame, closed: DataFrame) -> DataFrame:
    """id, pos, c: each credit at the canonical person, if there is one of that id, else at the person as it is; links are closed. Recordings without
    credits have a row with null pos."""
    known = people.select(F.col("id").alias("_known")).distinct()
    ends = closed.join(known, F.col("canonical") == F.col("_known"), "left_semi")
    each = recordings.select("id", F.posexplode_outer("credits").alias("pos", "c"))
    moved = each.join(ends, F.col("c.personId") == F.col("alias"), "left").withColumn("c", F.col("c").withField("personId", F.coalesce("canonical", F.col("c.personId"))))
    return moved.select("id", "pos", "c")


def canonical_credits(recordings: DataFrame, people: DataFrame, closed: DataFrame) -> DataFrame:
    """recordings with their credits as moved_credits has them."""
    back = moved_credits(recordings, people, closed).filter("pos IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("x")).select("id", F.col("x.c").alias("_credits"))
    return recordings.join(back, "id", "left").withColumn("credits", F.coalesce("_credits", "credits")).drop("_credits")


def relationships(lib: dict[str, DataFrame], links: DataFrame, role: str) -> DataFrame:
    """person, composer, work, recordings (sorted array): what people of a role perform in that role, under their canonical entries.
    Recordings of unknown works, works of unknown composers and credits of unknown people are left out."""
    people = lib["people"].select(F.col("id").alias("person"), "roles")
    credits = canonical_credits(lib["recordings"], lib["people"], resolve.alias_closure(links)).select(F.col("id").alias("recording"), "workId", F.explode("credits").alias("c")).filter(F.col("c.role") == role)
    works = lib["works"].select(F.col("id").alias("workId"), "composerId").join(lib["composers"].select(F.col("id").alias("composerId")), "composerId", "left_semi")
    each = credits.join(people.filter(F.array_contains("roles", role)), F.col("c.personId") == F.col("person")).join(works, "workId")
    return each.groupBy("person", F.col("composerId").alias("composer"), F.col("workId").alias("work")).agg(F.array_sort(F.collect_list("recording")).alias("recordings"))


def appearances(lib: dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """person, n: credits (not recordings) of each canonical person, in recordings whose work and composer are known; 0 for the others."""
    closed = resolve.alias_closure(links)
    credits = canonical_credits(lib["recordings"], lib["people"], closed).select("workId", F.explode("credits.personId").alias("person"))
    works = lib["works"].select(F.col("id").alias("workId"), "composerId").join(lib["composers"].select(F.col("id").alias("composerId")), "composerId", "left_semi")
    n = credits.join(works, "workId", "left_semi").groupBy("person").agg(F.count("*").alias("n"))
    own = canonical_people(lib["people"], closed).filter("id = canonical").select(F.col("id").alias("person"))
    return own.join(n, "person", "left").select("person", F.coalesce("n", F.lit(0)).alias("n"))


def search_index(lib: dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """kind, id, primary_text, secondary_text, href, match_tokens, alias_tokens of composers, people, work groups, works, recordings and, if the library
    has them, articles. Recordings may have albumTitle and label. Arrays that are null are taken as empty."""

    def entry(df: DataFrame, kind: Column, primary: Column, secondary: Column, href: Column, match: Column, alias: Column, once=names.distinct) -> DataFrame:
        return df.select(kind.alias("kind"), F.col("id"), primary.alias("primary_text"), secondary.alias("secondary_text"), href.alias("href"), once(match).alias("match_tokens"), names.distinct(alias).alias("alias_tokens"))

    shown = lambda df: df.withColumn("_d", names.display(F.col("name"), F.col("nameLatin"), F.col("aliases"))).withColumn("_s", names.search_texts(F.col("_d"), F.concat(F.coalesce("countries", names.none()), F.array("country"))))
    s = lambda k: F.col(f"_s.{k}")
    composers = shown(lib["composers"])
    head = composers.select(F.col("id").alias("composerId"), s("primaryText").alias("_heading"), "slug").withColumnRenamed("slug", "_slug")
    parts = [entry(composers, F.lit("composer"), s("primaryText"), s("secondaryText"), rules.href("composers", F.col("slug")), s("matchTokens"), s("aliasTokens"))]
    closed = resolve.alias_closure(links)
    who = canonical_people(lib["people"], closed)
    others = lib["people"].join(who, "id").groupBy("canonical").agg(F.flatten(F.array_sort(F.collect_list(F.concat(F.array("name", "nameLatin"), F.coalesce("aliases", names.none()))))).alias("_all"))
    people = shown(lib["people"]).join(others, F.col("id") == F.col("canonical"))
    kind = F.when(F.array_contains("roles", "conductor"), "conductor").when(F.array_contains("roles", "orchestra"), "orchestra").otherwise("person")
    second = F.coalesce(F.nullif(s("secondaryText"), F.lit("")), F.array_join("roles", " / "))
    parts.append(entry(people, kind, s("primaryText"), second, rules.person_href(F.col("roles"), F.col("slug")), F.concat(s("matchTokens"), F.col("_all")), s("aliasTokens")))
    some = lambda c: F.coalesce(c, names.none())
    groups = lib["workGroups"].join(head, "composerId")
    at = F.concat(rules.href("composers", F.col("_slug")), F.lit("#"), F.col("id"))
    parts.append(entry(groups, F.lit("workGroup"), F.col("title"), F.col("_heading"), at, F.concat(F.array("title"), some("path"), F.array("_heading")), names.none()))
    titles = lib["works"].select("id", F.posexplode("groupIds").alias("pos", "g")).join(lib["workGroups"].select(F.col("id").alias("g"), F.col("title").alias("_t")), "g")
    path = titles.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("x")).select("id", F.col("x._t").alias("_path"))
    works = lib["works"].join(head, "composerId").join(path, "id", "left").withColumn("_path", F.coalesce("_path", names.none()))
    mine = F.array_join(names.distinct(F.array(F.col("title"), names.without_catalogue(F.col("titleLatin"), F.col("catalogue")), F.col("catalogue"))), " / ")
    above = F.array_join(names.distinct(F.concat(F.array("_heading"), F.col("_path"))), " / ")
    match = F.concat(F.array("title", "titleLatin", "catalogue"), some("aliases"), F.col("_path"), F.array("_heading"))
    parts.append(entry(works, F.lit("work"), mine, above, rules.href("works", F.col("id")), match, F.col("aliases")))
    # what a work says is trimmed once a work, not once a recording
    w = lib["works"].join(head, "composerId", "left").select(
        F.col("id").alias("workId"), names.distinct(F.array("title", "titleLatin", "catalogue", "_heading")).alias("_found"), F.array_join(names.distinct(F.array("title", "_heading")), " / ").alias("_above"),
    )
    # credits are taken apart, moved, shown and put together once
    told = display.displays_of_credits(moved_credits(lib["recordings"], lib["people"], closed), lib["people"])
    r = display.titled(lib["recordings"].join(w, "workId").join(told, "id"))
    # moved credits say what the credits say, but for their people
    said = F.concat(some(F.flatten(F.transform("credits", lambda c: F.array(c["displayName"], c["label"], c["personId"])))), F.col("people"))
    more = [F.col(c) for c in ("albumTitle", "label") if c in lib["recordings"].columns]
    own = names.distinct(F.array_distinct(F.concat(F.array(F.col("performanceDateText"), F.col("venueText"), *more), said)))
    match = F.array_distinct(F.concat(F.array("_title"), F.col("_found"), own))
    parts.append(entry(r, F.lit("recording"), F.col("_title"), F.col("_above"), rules.href("recordings", F.col("id")), match, names.none(), once=lambda x: x))
    if "articles" in lib:
        a = lib["articles"]
        parts.append(entry(a, F.lit("article"), F.col("title"), F.col("summary"), rules.href("columns", F.col("slug")), F.array("title", "slug", "summary", "markdown"), names.none()))
    return reduce(DataFrame.unionByName, parts)


def normalized_groups(groups: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, works): groups of one composer and path are one, the first by id; works point at it; groups that no work has go."""
    clean = groups.withColumn("path", F.filter(F.transform("path", lambda x: F.trim(x)), lambda x: x != "")).filter(F.size("path") > 0)
    key = F.struct("composerId", F.array_join("path", "/").alias("k"))
    one = clean.groupBy(key.alias("key")).agg(F.min("id").alias("_keep"))
    to = clean.select("id", key.alias("key")).join(one, "key").select(F.col("id").alias("_old"), "_keep")
    each = works.select("id", F.posexplode("groupIds").alias("pos", "_old")).join(to, "_old")
    lists = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "_keep"))).alias("x")).select("id", names.distinct(F.col("x._keep")).alias("_groups"))
    out = works.join(lists, "id", "left").withColumn("groupIds", F.coalesce("_groups", names.none())).drop("_groups")
    used = out.select(F.explode("groupIds").alias("id")).distinct()
    return clean.join(used, "id", "left_semi"), out


def missing_groups(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """composerId, path: prefixes of wanted paths (composerId, path) that no group has yet, each once."""
    prefixes = wanted.select("composerId", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("path")).distinct()
    return prefixes.join(groups.select("composerId", "path"), ["composerId", "path"], "left_anti")


def unlink(recordings: DataFrame, pairs: DataFrame) -> DataFrame:
    """recordings without the credits of the people that pairs (id, personId) name for them."""
    gone = pairs.groupBy("id").agg(F.collect_set("personId").alias("_gone"))
    kept = F.filter("credits", lambda c: ~F.array_contains(F.coalesce("_gone", names.none()), F.trim(c["personId"])))
    return recordings.join(gone, "id", "left").withColumn("credits", kept).drop("_gone")


def relations(lib: dict[str, DataFrame]) -> DataFrame:
    """entity_type, id, other_type, other: what each entity has to do with, one step away, each pair once: a recording with its work and
    people, a work with its composer and recordings, people and composers with their recordings and works."""
    pair = lambda df, a, i, b, j: df.select(F.lit(a).alias("entity_type"), F.col(i).alias("id"), F.lit(b).alias("other_type"), F.col(j).alias("other"))
    works, people = lib["works"].select("id", "composerId"), lib["people"].select("id", "roles")
    made = lib["recordings"].select(F.col("id").alias("recording"), F.col("workId").alias("work")).join(works.select(F.col("id").alias("work")), "work", "left_semi")
    credit = lib["recordings"].select(F.col("id").alias("recording"), F.explode("credits.personId").alias("person")).distinct()
    known = credit.join(people.select(F.col("id").alias("person")), "person", "left_semi")
    by = works.join(people.select(F.col("id").alias("composerId")), "composerId", "left_semi")
    of = works.join(lib["composers"].select(F.col("id").alias("composerId")), "composerId", "left_semi").join(people.select(F.col("id").alias("composerId")), "composerId", "left_anti")
    parts = [
        pair(made, "recording", "recording", "work", "work"), pair(known, "recording", "recording", "person", "person"), pair(made, "work", "work", "recording", "recording"),
        pair(by, "work", "id", "person", "composerId"), pair(of, "work", "id", "composer", "composerId"), pair(known, "person", "person", "recording", "recording"), pair(of, "composer", "composerId", "work", "id"),
        pair(by.join(people.filter(F.array_contains("roles", "composer")).select(F.col("id").alias("composerId")), "composerId", "left_semi"), "person", "composerId", "work", "id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def delete_blockers(lib: dict[str, DataFrame]) -> DataFrame:
    """entity_type, id, held_by: works, people and composers that must not be deleted, with the kinds of what still needs them."""
    pair = lambda df, kind, i, by: df.select(F.lit(kind).alias("entity_type"), F.col(i).alias("id"), F.lit(by).alias("by"))
    credit = lib["recordings"].select(F.explode("credits.personId").alias("person")).distinct()
    held = pair(lib["recordings"], "work", "workId", "recording").union(pair(credit, "person", "person", "recording"))
    held = held.union(pair(lib["works"], "composer", "composerId", "work")).union(pair(lib["workGroups"], "composer", "composerId", "workGroup"))
    ids = reduce(DataFrame.union, [pair(lib[t], k, "id", "").drop("by") for k, t in (("work", "works"), ("person", "people"), ("composer", "composers"))])
    return held.distinct().join(ids, ["entity_type", "id"], "left_semi").groupBy("entity_type", "id").agg(F.array_join(F.array_sort(F.collect_list("by")), ",").alias("held_by"))
