"""Queries for a recording that is searched for, of what a draft says of it: shapes of work, people and day, and rescues by few words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import matching, names
from shelfmark.functions.text import trimmed
from shelfmark.operators import keyed

# The parts of each shape (title, composer, work, lead, ensemble, day), words that belong to a surname, words that tell what a profile is.
SHAPES = ("WLED", "CWLED", "CWLE", "WLD", "LED", "WED", "LD", "LE", "TLE", "ED")
PARTICLES = ("da", "de", "del", "della", "der", "di", "du", "la", "le", "ten", "ter", "van", "von")
TAGS = {
    "piano": ("piano", "pianist", "钢琴"), "violin": ("violin", "violinist", "小提琴"), "vocal": ("soprano", "tenor", "baritone", "mezzo", "歌剧", "声乐", "女高音", "男高音"), "choral": ("choir", "chorus", "合唱"),
    "live": (" live ", "live in", "recorded live", "现场"), "studio": ("studio", "录音室"),
}


def work_query(work: Column, other: Column, catalogue: Column, title: Column) -> Column:
    """The work's title, the other script's where it has none, with its catalogue mark unless it holds that; the recording's title without any."""
    name, mark = F.coalesce(F.nullif(trimmed(work), F.lit("")), trimmed(other)), trimmed(catalogue)
    return F.when((name != "") & (mark != "") & ~F.contains(F.lower(name), F.lower(mark)), F.concat(name, F.lit(" "), mark)).when(name != "", name).otherwise(F.coalesce(title, F.lit("")))


def shaped(work: Column, composer: Column, leads: Column, ensembles: Column, title: Column, day: Column) -> Column:
    """Every shape with each of up to three leads and ensembles (none counts as one that is ''), without empty parts; each query once, in order."""
    few = lambda values: matching.let(names.distinct(values), lambda x: F.when(F.size(x) == 0, F.array(F.lit(""))).otherwise(F.slice(x, 1, 3)))
    said = lambda c: F.nullif(trimmed(c), F.lit(""))
    pairs = lambda es: F.flatten(F.transform(few(leads), lambda lead: F.transform(es, lambda e: F.struct(F.nullif(lead, F.lit("")).alias("L"), F.nullif(e, F.lit("")).alias("E")))))
    own = F.struct(said(title).alias("T"), said(composer).alias("C"), said(work).alias("W"), said(day).alias("D"), matching.let(few(ensembles), pairs).alias("pairs"))
    # texts are trimmed once a draft; a shape is a fixed list of them, and parts that are missing are left out
    query = lambda d, shape: lambda pair: F.concat_ws(" ", *(pair[k] if k in "LE" else d[k] for k in "TCWLED" if k in shape))
    every = lambda d: F.flatten(F.array(*(F.transform(d["pairs"], query(d, s)) for s in SHAPES)))
    return F.array_distinct(F.filter(matching.let(own, every), lambda x: x != ""))


def surname(c: Column) -> Column:
    """The last word of a Latin name, with the particles before it, where it has four letters and isn't the only one; else the name; '' for others."""
    name = trimmed(c)
    words = F.array_join(F.regexp_extract_all(name, F.lit(r"[A-Za-z][A-Za-z'.-]*"), 0), " ")
    last = F.regexp_extract(words, rf"(?i)^\S+ (?:\S+ )*?((?:(?:{'|'.join(PARTICLES)}) )*\S{{4,}})$", 1)
    return F.when(~names.looks_latin(name), "").when(last != "", last).otherwise(name)


def last_segment(c: Column) -> Column:
    """The last part of a Chinese name, cut at points, marks and blanks; '' for others."""
    parts = F.filter(F.split(trimmed(c), r"(?U)[·•・／/|,，、\s]+"), lambda x: x != "")
    return F.when(names.holds_cjk(c), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))).otherwise("")


def prioritized(values: Column) -> Column:
    """Names, each once whatever its case: of two or three words, of more, of one, pairs with a slash; the shorter first."""
    once = keyed.ordered_distinct(values, ignore_case=True)
    words = lambda x: F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    bucket = lambda x: F.when(F.contains(x, F.lit("/")), 3).when(words(x).between(2, 3), 0).when(words(x) >= 4, 1).otherwise(2)
    placed = F.transform(once, lambda x, i: F.struct(bucket(x).alias("b"), F.length(x).alias("l"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda v: v["x"])


def keywords(values: Column) -> Column:
    """The surnames of prioritized Latin names, each once."""
    return keyed.ordered_distinct(F.transform(prioritized(values), surname), ignore_case=True)


def year_of(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(19[0-9]{2}|20[0-9]{2})", 1)


def _queries(*parts: Column) -> Column:
    return keyed.ordered_distinct(F.flatten(F.array(*parts)), ignore_case=True)


def year_anchors(leads: Column, year: Column) -> Column:
    """A person and the year: the name as it is in Chinese, the surname of a Latin one."""
    term = lambda x: F.when(names.holds_cjk(x), trimmed(x)).otherwise(surname(x))
    terms = F.filter(F.transform(keyed.ordered_distinct(leads, ignore_case=True), term), lambda x: x != "")
    return F.when(year == "", names.none()).otherwise(keyed.ordered_distinct(F.transform(terms, lambda x: F.concat(x, F.lit(" "), year)), ignore_case=True))


def surname_pairs(work: Column, first: Column, second: Column, composer: Column, year: Column) -> Column:
    """Of concertos: two surnames with composer and year, with composer, with the year; no name with itself. first, second: keywords."""
    pairs = F.flatten(F.transform(F.slice(first, 1, 2), lambda a: F.transform(F.slice(second, 1, 2), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    apart = F.filter(pairs, lambda p: F.lower(p["a"]) != F.lower(p["b"]))
    both = lambda p: F.concat(p["a"], F.lit(" "), p["b"])
    said = lambda p: F.filter(F.array(
        F.when((composer != "") & (year != ""), F.concat_ws(" ", both(p), composer, F.lit("concerto"), year)), F.when(composer != "", F.concat_ws(" ", both(p), composer, F.lit("concerto"))), F.when(year != "", F.concat_ws(" ", both(p), F.lit("concerto"), year)),
    ), lambda x: x.isNotNull())
    return F.when(F.contains(matching.plain(work), F.lit("concerto")), _queries(F.flatten(F.transform(apart, said)))).otherwise(names.none())


def decades(work: Column, first: Column, composer: Column, year: Column) -> Column:
    """Of concertos: a surname with the work, in the plural too, and the decade; with the composer first. first: keywords."""
    bare = matching.without_catalogue(work)
    forms = F.filter(F.array(bare, F.when(F.contains(bare, F.lit("Piano Concerto")) & ~F.contains(bare, F.lit("Piano Concertos")), F.replace(bare, F.lit("Piano Concerto"), F.lit("Piano Concertos")))), lambda x: x.isNotNull() & (x != ""))
    decade = F.concat(F.substring(year, 1, 3), F.lit("0s"))
    one = lambda k: F.concat(
        F.when(composer != "", F.transform(forms, lambda f: F.concat_ws(" ", k, composer, f, decade))).otherwise(names.none()), F.transform(forms, lambda f: F.concat_ws(" ", k, f, decade)),
    )
    applies = F.contains(matching.plain(work), F.lit("concerto")) & (year != "") & names.looks_latin(bare)
    return F.when(applies, _queries(F.flatten(F.transform(F.slice(first, 1, 2), one)))).otherwise(names.none())


def tags(*texts: Column) -> Column:
    """What a profile is about, by words in its texts."""
    text = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in texts))), F.lit(" "))
    held = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m))
    return F.array_compact(F.array(*(F.when(held(marks), tag) for tag, marks in TAGS.items())))
