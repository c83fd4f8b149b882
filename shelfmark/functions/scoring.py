"""How surely a page is the recording that a draft asks for: each term a column, so that a score can be read apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import matching, names, works
from shelfmark.functions.text import trimmed

# Words of movements, headings and marks of single movements and of compilations, months, pages that are no recordings.
TRACKS = ("allegro", "adagio", "andante", "scherzo", "rondo", "presto", "larghetto", "largo")
HEADINGS = ("allegro", "adagio", "andante", "scherzo", "rondo", "presto", "largo")
#: patterns, each with a text that all it finds holds: most pages don't, and a text is found faster than a pattern
SINGLE = (
    (":", r":\s*(?:i|ii|iii|iv|v)\.\s"), ("movement", "(?:1st|2nd|3rd|4th) movement"), ("goldberg variations", r"\bgoldberg variations\b.*:\s*aria\b"), ("allegro con brio", ""), ("andante", ""), ("adagio", ""), ("scherzo", ""),
    ("aria", r"\baria\b"),
)
SEVERAL = (
    ("no", r"nos?\.\s*[0-9]+\s*(?:and|&)\s*[0-9]+|\bnos?\s*[0-9]+\s*[,/]\s*[0-9]+"), ("symphonies", r"symphonies\s+nos?\."), ("sonatas", r"\bsonatas\b"), (" overture", ""), (" works /", ""), (" works by", ""),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
COLLABORATION = "&| / | and | with |、"
NO_RECORDING = ("biography", "discography of", "born ", "composer profile", "work details", "人物简介", "生平", "作品介绍")


def _number(*tests: Column) -> Column:
    out = F.lit(0)
    for t in tests:
        out = out + t.cast("int")
    return out


def _distinct(c: Column, pattern: str, group: int) -> Column:
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), group), lambda x: F.lower(x))))


def has_tracklist(hay: Column) -> Column:
    """Several numbered sections with words of movements, or three such words."""
    terms = _number(*(F.contains(hay, F.lit(t)) for t in TRACKS))
    return (terms >= 3) | ((terms >= 2) & (F.regexp_count(hay, F.lit(r"(?:^|\D)([1-6])\.")) >= 3))


def _any(hay: Column, guarded: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(hay, F.lit(text)) & hay.rlike(p) if p else F.contains(hay, F.lit(text)) for text, p in guarded))


def is_single_movement(hay: Column) -> Column:
    """One heading or tempo of a movement, not several, and no word for the whole. hay: a plain text, so in lower case."""
    marked = _distinct(hay, r"(?:^|[^a-z])(i{1,3}|iv|v)\.\s", 1) + _distinct(hay, r"(?:^|[\s(:\-–—])([1-9])\.\s", 1)
    counted = _distinct(hay, r"\b([1-9][0-9]{0,1})(?:st|nd|rd|th)\s+movement\b", 1)
    headings = F.when(hay.rlike(r"[iv1-9]\.\s"), marked).otherwise(0) + F.when(F.contains(hay, F.lit("movement")), counted).otherwise(0)
    terms = _number(*(F.contains(hay, F.lit(t)) & hay.rlike(rf"\b{t}\b") for t in HEADINGS))
    whole = _any(hay, (("full", r"\bfull\b"), ("complete", r"\bcomplete\b")))
    tell = lambda x: F.when((x["t"] >= 3) | (x["h"] >= 2) | ((x["h"] >= 1) & whole), False).when((x["h"] >= 1) & (x["t"] >= 1), True).otherwise(_any(hay, SINGLE))
    return matching.let(F.struct(headings.alias("h"), terms.alias("t")), tell)


def collaboration(c: Column) -> Column:
    return F.lower(trimmed(c)).rlike(COLLABORATION)


def named_aliases(*titles: Column) -> Column:
    """Nicknames of works, in both scripts."""
    out = []
    for c in titles:
        text, low = trimmed(c), matching.plain(c)
        out += [F.when(text.rlike(p) | low.rlike(p), F.array(*map(F.lit, values))) for p, values in works.NICKNAMES] + [F.when(low.rlike(p), F.array(*map(F.lit, values))) for p, values in works.NUMBERS]
    return F.array_distinct(F.flatten(F.filter(F.array(*out), lambda x: x.isNotNull())))


def all_aliases(d: dict[str, Column]) -> Column:
    return F.array_distinct(F.concat(works.aliases(d["work_latin"]), works.aliases(d["work"])))


def known(d: dict[str, Column]) -> Column:
    """struct: all that a score asks of the draft alone. Where a draft has many pages, it is worked out before the pages are joined.

    d: work, work_latin, catalogue, composer, composer_latin, title, day, raw (texts), slots (names of each lead), ensembles, ensembles_latin."""
    any_text = F.coalesce(F.nullif(trimmed(d["work_latin"]), F.lit("")), trimmed(d["work"]))
    slots = F.coalesce(d["slots"], F.array().cast("array<array<string>>"))
    own, latin = names.distinct(d["ensembles"]), names.distinct(d["ensembles_latin"])
    groups = F.slice(names.distinct(F.concat(F.slice(F.coalesce(d["ensembles"], names.none()), 1, 2), F.slice(F.coalesce(d["ensembles_latin"], names.none()), 1, 2))), 1, 4)
    wanted = F.array_distinct(F.flatten(F.transform(F.array(d["day"], d["title"], d["raw"]), lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("((?:17|18|19|20)[0-9]{2})"), 1))))
    spare = F.exists(F.slice(slots, F.lit(2), F.greatest(F.size(slots) - 1, F.lit(0))), lambda s: ~F.exists(s, names.looks_latin) & F.exists(s, names.holds_cjk))
    parted = F.size(F.filter(F.split(trimmed(d["title"]), " - "), lambda x: trimmed(x) != "")) >= 2
    composers = F.filter(F.array(trimmed(d["composer_latin"]), trimmed(d["composer"])), lambda x: x != "")
    context = F.filter(matching.tokens(F.regexp_replace(F.coalesce(d["day"], F.lit("")), "(19[0-9]{2}|20[0-9]{2})", " ")), lambda x: ~x.isin("live", "recorded", "recording"))
    return F.struct(
        matching.tokens(any_text).alias("work"), matching.tokens(matching.without_catalogue(any_text)).alias("bare"), all_aliases(d).alias("aliases"), named_aliases(d["work_latin"], d["work"]).alias("named"),
        F.transform(slots, matching.known_names).alias("slots"), matching.known_ensembles(groups).alias("groups"), wanted.alias("years"), ((collaboration(d["title"]) | parted) & (F.size(slots) >= 2) & spare).alias("sparse"),
        collaboration(d["title"]).alias("joint"), ((F.size(own) == 0) & (F.size(latin) == 0)).alias("alone"), (F.size(own) > 0).alias("grouped"), matching.known_names(composers).alias("composers"), F.exists(composers, names.looks_latin).alias("latin"),
        matching.tokens(d["catalogue"]).alias("catalogue"), matching.plain(d["catalogue"]).alias("mark"), matching.catalogue_marks(d["catalogue"]).alias("marks"), context.alias("context"),
        (F.exists(context, lambda x: x.isin(*MONTHS)) & F.exists(context, lambda x: x.rlike("^[0-9]+$"))).alias("dated"), matching.least_seconds(d["work"], d["work_latin"]).alias("least"),
    )


def with_facts(df: DataFrame, text: Column, url: Column, uploader: Column, draft: Column) -> DataFrame:
    """df with what terms of a score ask, as columns that are worth keeping: h_draft (the draft's own facts), h_hay, h_url, h_work (the work is named), h_leads (how many
    leads are), h_slots, h_groups, h_years (hit: 1, another: -1, none: 0), h_sparse (a collaboration that the draft's title alone tells). draft: known(d)."""
    hay, k = F.col("h_hay"), F.col("h_draft")
    df = df.withColumns({"h_draft": draft, "h_text": F.lower(trimmed(text)), "h_url": trimmed(url)}).withColumn("h_hay", matching.plain(F.concat_ws(" ", "h_text", "h_url", trimmed(uploader))))
    seen = F.regexp_extract_all(hay, F.lit("(19[0-9]{2}|20[0-9]{2})"), 1)
    years = F.when(F.size(k["years"]) == 0, 0).otherwise(matching.let(seen, lambda s: F.when(F.size(s) == 0, 0).when(F.arrays_overlap(k["years"], s), 1).otherwise(-1)))
    return df.withColumns({
        "h_work": matching.holds(hay, k["work"]) | matching.holds(hay, k["bare"]) | F.exists(k["aliases"], lambda a: F.contains(hay, a)), "h_asks": F.size(k["aliases"]) > 0,
        "h_leads": F.size(F.filter(k["slots"], lambda s: F.exists(s, lambda v: matching.known_name_matches(hay, v)))), "h_slots": F.size(k["slots"]), "h_groups": F.size(F.filter(k["groups"], lambda g: matching.known_ensemble_matches(hay, g))), "h_years": years,
        "h_sparse": k["sparse"], "h_named": F.exists(k["named"], lambda a: F.contains(hay, a)), "h_joint": F.col("h_text").rlike(COLLABORATION),
        "h_single": is_single_movement(hay), "h_several": _any(hay, SEVERAL), "h_tracks": has_tracklist(hay),
    })


def terms(seconds: Column, secondary: Column) -> dict[str, Column]:
    """The terms of the score, over the columns of with_facts; their sum, from 0 to 0.97, is the score. secondary: the draft names secondary people."""
    c, when = F.col, F.when
    hay, url, k, work, leads, slots, groups, sparse, joint = c("h_hay"), c("h_url"), c("h_draft"), c("h_work"), c("h_leads"), c("h_slots"), c("h_groups"), c("h_sparse"), c("h_joint")
    by = F.exists(k["composers"], lambda v: matching.known_name_matches(hay, v))
    lacking = slots - leads
    parted = _any(hay, tuple((m, "") for m in (" / ", "&", " and ", " with ")))
    explicit = joint | c("h_text").rlike(" - |, ")
    absent = when((slots >= 2) & (lacking > 0), when(parted, -0.24 * lacking * when(sparse & joint & work & (leads >= 1), 0.15).otherwise(1.0)).when(explicit, -0.18 * lacking).otherwise(0.0)).otherwise(0.0)
    alone = k["alone"]
    duo = when((slots >= 2) & alone, when(leads == slots, 0.18).when(leads == 1, when(sparse & joint & work, 0.08 + when(c("h_tracks"), 0.18).when(c("h_named"), 0.08).otherwise(0.0)).otherwise(-0.1)).otherwise(0.0)).when(
        k["joint"] & alone, when(joint & (leads >= 1) & work, 0.18 + when(c("h_named"), 0.06).otherwise(0.0)).when((leads >= 1) & ~joint, -0.12).otherwise(0.0)
    ).otherwise(0.0)
    hit = c("h_years") == 1
    day = when(matching.holds(hay, k["context"]), 0.1 + when(k["dated"] & (leads >= 1) & hit, 0.08 + when(work, 0.08).otherwise(0.0)).otherwise(0.0)).otherwise(0.0)
    track = F.lower(url).rlike(r"music\.apple\.com") & F.contains(F.lower(url), F.lit("?i="))
    chapter = F.concat_ws(" ", hay, url).rlike("(?i)" + "|".join(f"(?:{p})" for p in matching.FIRST_CHAPTER))
    named = work & (leads >= 1)
    part = when(track & named, when(chapter, -0.02).otherwise(-0.06)).when(chapter & named, -0.08).otherwise(-0.34)
    whole = c("h_tracks") | F.contains(hay, F.lit("full")) | F.contains(hay, F.lit("complete"))
    kind = when(c("h_single"), part).when(c("h_several"), when(track & named, 0.0).when(named, -0.12).otherwise(-0.34)).when(whole, 0.04).otherwise(0.0)
    flag = lambda test, value: when(test, value).otherwise(0.0)
    return {
        "base": F.lit(0.2), "work": flag(work, 0.25), "catalogue": flag(matching.holds(hay, k["catalogue"]), 0.12),
        "composer": when(by, 0.08).when(work & k["latin"], -0.24).otherwise(0.0), "leads": when(leads > 0, 0.18 + 0.08 * (leads - 1)).otherwise(0.0), "absent_leads": absent, "duo": duo,
        "groups": flag(groups > 0, 0.15), "half": flag(secondary & (slots >= 2) & (leads == 1) & (groups > 0) & work & ~sparse, -0.45), "all": flag(work & (groups > 0) & (leads >= slots), 0.06),
        "years": when(hit, 0.08).when(c("h_years") == -1, -0.32).otherwise(0.0), "day": day, "tracks": flag(sparse & work & (leads >= 1) & c("h_tracks"), 0.08 + flag(hit, 0.04)), "marks": matching.known_catalogue_fit(k["mark"], k["marks"], hay),
        "kind": kind, "page": flag(url.rlike(r"(?i)[?&]p=[0-9]+"), -0.04), "edition": flag(_any(hay, tuple((m, "") for m in matching.EDITIONS.split("|"))), -0.12), "provided": flag(F.contains(hay, F.lit("provided to youtube by")), -0.1),
        "length": matching.duration_fit(k["least"], hay, F.coalesce(seconds, F.lit(0))), "other": flag(_any(hay, tuple((m, "") for m in NO_RECORDING)), -0.28), "no_work": flag(c("h_asks") & ~work, -0.22), "no_lead": flag((slots > 0) & (leads == 0), -0.1),
        "no_group": flag(k["grouped"] & (groups == 0), -0.08),
    }


def total(values: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for v in values.values():
        out = out + v
    return F.greatest(F.lit(0.0), F.least(F.lit(0.97), out))
