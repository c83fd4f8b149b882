"""Does a page's text mean a recording: tokens, names, ensembles, catalogue marks, lengths, years. Texts are lower case after `plain`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names
from .text import nfkc, trimmed

# Marks of catalogues, words that an ensemble's name shares with others, shortest lengths of whole works in seconds.
CATALOGUES = ("op", "kv", "k", "bwv", "hob", "d", "wab", "sz", "rv")
CATALOGUE_NUMBER = r"(?i)\b(?:op|k|bwv|hob|d|wab)\.?\s*[0-9]+[a-z]?\b"
SHARED_WORDS = ("orchestra", "philharmonic", "symphony", "ensemble", "choir")
LENGTHS = [("symphony|交响曲|concerto|协奏曲|variations|变奏曲", 900), ("sonata|奏鸣曲|quartet|四重奏|trio|三重奏", 720), ("mass|requiem|opera|suite|组曲", 900)]
EDITIONS = "new edition|restored|remaster|reissue|alt take"
DISCS = r"blu-ray|bluray|bd版|蓝光|「bd」|\[bd\]|\(bd\)"
WORK_MARKS = r"concerto|symphony|sonata|quartet|trio|op\."
# Patterns of movements, first chapters, compilations and editions.
MOVEMENT = [r"(?:^|[\s(:\-–—])(i{1,3}|iv|v)\.\s", r"(?:^|[\s(:\-–—])([1-9])\.\s", r"\b(?:1st|2nd|3rd|4th|first|second|third|fourth)\s+movement\b", r"\ballegro\b", r"\badagio\b", r"\bandante\b", r"\bscherzo\b", r"\brondo\b"]
FIRST_CHAPTER = [r"(?:^|[\s(:\-–—])(i|1)\.\s", r"\b1st movement\b", r"\bfirst movement\b", r"[?&]p=1\b"]
COMPILATION = [r"nos?\.\s*[0-9]+\s*(?:and|&)\s*[0-9]+", r"\bnos?\s*[0-9]+\s*,\s*[0-9]+", r"\bnos?\s*[0-9]+\s*/\s*[0-9]+", r"\bconcertos\b", r"\bsonatas\b", " overture", " works /", " works by", r"\bbrahms\b.+\bschumann\b"]
MATCH_MARKS = r"""[\s·:：;；,.，。'"`()\[\]{}<>|/\\_-]+"""
BIOGRAPHY, PERFORMANCE = "biography|born|composer|founded|首席指挥|作曲家生平|担任", "album|recording|symphony|concert|live|交响曲|录音|演出"


def plain(c: Column) -> Column:
    """Lower case, numbers after 'no' and 'sym' set apart, one blank between words."""
    low = F.lower(trimmed(c))
    for pattern, to in ((r"№\s*([0-9]+)", " no $1"), (r"\bn\s*[°º]\s*([0-9]+)", " no $1"), (r"\bno\.?\s*([0-9]+)", " no $1"), (r"\bsym\s*\.?\s*([0-9]+)", " sym $1")):
        low = F.regexp_replace(low, pattern, to)
    return F.regexp_replace(low, r"\s+", " ")


def tokens(c: Column) -> Column:
    """Runs of letters, digits and Chinese characters: of two characters at least, or numbers."""
    return F.filter(F.split(plain(c), r"[^a-z0-9\x{4e00}-\x{9fff}]+"), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))


def holds(haystack: Column, words: Column) -> Column:
    """All words are in the haystack, and there is one."""
    return (F.size(words) > 0) & F.forall(words, lambda t: F.contains(haystack, t))


def name_matches(haystack: Column, value: Column) -> Column:
    """By all words, by the surname, or by initials with points or blanks between them."""
    words = tokens(value)
    last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    initials = F.transform(words, lambda t: F.substring(t, 1, 1))
    pattern = F.concat(F.lit(r"(?i)\b"), F.array_join(initials, r"[\.\s]+"), F.lit(r"\.?\b"))
    return holds(haystack, words) | ((F.length(last) >= 4) & F.contains(haystack, last)) | ((F.size(words) >= 2) & F.rlike(haystack, pattern))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is asked for."""
    return F.get(F.transform(F.array(value), use), 0)


def known_names(values: Column) -> Column:
    """What known_name_matches asks of each name: its words, the last of them, the pattern of its initials."""
    pattern = lambda w: F.concat(F.lit(r"(?i)\b"), F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), r"[\.\s]+"), F.lit(r"\.?\b"))
    return F.transform(F.transform(values, tokens), lambda w: F.struct(w.alias("words"), F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("")).alias("last"), pattern(w).alias("initials")))


def known_name_matches(haystack: Column, name: Column) -> Column:
    """name_matches of one of known_names."""
    words, last = name["words"], name["last"]
    return holds(haystack, words) | ((F.length(last) >= 4) & F.contains(haystack, last)) | ((F.size(words) >= 2) & F.rlike(haystack, name["initials"]))


def acronym(words: Column) -> Column:
    """First letters of words of two characters at least; '' for fewer than two such words."""
    long = F.filter(words, lambda t: F.length(t) >= 2)
    return F.when(F.size(long) >= 2, F.array_join(F.transform(long, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def ensemble_matches(haystack: Column, value: Column) -> Column:
    """By all words, by the acronym, by words whose first letters in a row are the acronym that the name is, or by its words that others do not share."""
    words, short = tokens(value), acronym(tokens(value))
    own = F.filter(words, lambda t: ~t.isin(*SHARED_WORDS))
    bare = F.regexp_replace(trimmed(value), r"[. ]", "")
    is_acronym = (F.length(bare) >= 2) & (F.length(bare) <= 6) & bare.rlike(r"^\p{L}+$") & (F.upper(bare) == bare)
    row = F.array_join(F.transform(F.filter(tokens(haystack), lambda t: F.length(t) >= 2), lambda t: F.substring(t, 1, 1)), "")
    return (F.size(words) > 0) & (
        holds(haystack, words) | ((short != "") & F.contains(F.regexp_replace(haystack, "[. ]", ""), short)) | (is_acronym & F.contains(row, F.lower(bare))) | holds(haystack, own)
    )


def known_ensembles(values: Column) -> Column:
    """What known_ensemble_matches asks of each ensemble: its words, those that others do not share, its acronym, and the acronym that it is, or ''."""
    def facts(x: Column) -> Column:
        bare, own = x["bare"], F.filter(x["words"], lambda t: ~t.isin(*SHARED_WORDS))
        is_acronym = (F.length(bare) >= 2) & (F.length(bare) <= 6) & bare.rlike(r"^\p{L}+$") & (F.upper(bare) == bare)
        return F.struct(x["words"].alias("words"), own.alias("own"), acronym(x["words"]).alias("short"), F.when(is_acronym, F.lower(bare)).otherwise("").alias("bare"))

    return F.transform(F.transform(values, lambda v: F.struct(tokens(v).alias("words"), F.regexp_replace(trimmed(v), r"[. ]", "").alias("bare"))), facts)


def known_ensemble_matches(haystack: Column, e: Column) -> Column:
    """ensemble_matches of one of known_ensembles."""
    row = F.array_join(F.transform(F.filter(tokens(haystack), lambda t: F.length(t) >= 2), lambda t: F.substring(t, 1, 1)), "")
    return (F.size(e["words"]) > 0) & (
        holds(haystack, e["words"]) | holds(haystack, e["own"]) | ((e["short"] != "") & F.contains(F.regexp_replace(haystack, "[. ]", ""), e["short"])) | ((e["bare"] != "") & F.contains(row, e["bare"]))
    )


def without_catalogue(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed(c), CATALOGUE_NUMBER, ""), r"^[ ,.;:-]+|[ ,.;:-]+$", "")


def marks_in(text: Column) -> Column:
    """'op57', 'k331' ... that a plain text holds."""
    found = F.regexp_extract_all(text, F.lit(rf"\b(?:{'|'.join(CATALOGUES)})\s*\.?\s*[0-9]+[a-z]?\b"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[\s.]+", "")))


def catalogue_marks(c: Column) -> Column:
    """'op57', 'k331' ... that a text holds."""
    return marks_in(plain(c))


def known_catalogue_fit(mark: Column, own: Column, haystack: Column) -> Column:
    """catalogue_fit of a mark that is plain, its own marks, and a plain text."""
    others = let(marks_in(haystack), lambda seen: (F.size(seen) > 0) & ~F.arrays_overlap(own, seen))
    return F.when(mark == "", 0.0).when(F.contains(haystack, mark), 0.06).when(F.size(own) == 0, 0.0).when(others, -0.2).otherwise(0.0)


def catalogue_fit(catalogue: Column, haystack: Column) -> Column:
    """0.06 if the mark is there, -0.2 if only others are, else 0."""
    return known_catalogue_fit(plain(catalogue), catalogue_marks(catalogue), haystack)


def least_seconds(title: Column, latin: Column) -> Column:
    text, out = plain(F.concat_ws(" ", F.coalesce(latin, F.lit("")), F.coalesce(title, F.lit("")))), F.lit(0)
    for words, n in reversed(LENGTHS):
        out = F.when(text.rlike(words), n).otherwise(out)
    return out


def duration_fit(least: Column, haystack: Column, seconds: Column) -> Column:
    whole = F.when(haystack.rlike("full|complete"), 0.05).otherwise(0.02)
    cut = lambda share: F.floor(least * share)
    return (
        F.when((seconds <= 0) | (least <= 0), 0.0).when(seconds >= cut(0.85), whole).when(seconds < F.greatest(F.lit(240), cut(0.35)), -0.38)
        .when(seconds < cut(0.6), -0.18).otherwise(0.0)
    )


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def is_movement(c: Column) -> Column:
    return _any(c, MOVEMENT)


def is_compilation(c: Column) -> Column:
    return _any(c, COMPILATION)


def packaging(title: Column, description: Column, url: Column, has_record: Column, has_details: Column) -> Column:
    """What a candidate costs that is a movement, a page of several or a compilation; what a whole one gains."""
    text = F.concat_ws(" ", *(F.nullif(trimmed(c), F.lit("")) for c in (title, description, url)))
    apple = F.lower(trimmed(url)).rlike(r"music\.apple\.com") & F.contains(F.lower(trimmed(url)), F.lit("?i="))
    first = _any(text, FIRST_CHAPTER)
    movement = F.when(apple & has_record & has_details, F.when(first, -0.04).otherwise(-0.08)).otherwise(F.when(first, -0.14).otherwise(-0.28))
    kind = F.when(is_movement(text), movement).when(is_compilation(text), F.when(apple & has_record, 0.0).otherwise(-0.06)).when(F.lower(text).rlike("full|complete"), 0.04).otherwise(0.0)
    return kind + F.when(url.rlike(r"(?i)[?&]p=[0-9]+"), -0.04).otherwise(0.0)


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("((?:17|18|19|20)[0-9]{2})"), 1))


def reference_years(*texts: Column) -> Column:
    return F.array_distinct(F.concat(*(years(c) for c in texts)))


def year_conflict(c: Column, wanted: Column) -> Column:
    """A text that names years, and none of the wanted ones."""
    return (F.size(years(c)) > 0) & (F.size(wanted) > 0) & ~F.arrays_overlap(years(c), wanted)


def title_quality(title: Column, wanted_years: Column, anchors: Column, composer: Column, composer_latin: Column, catalogue: Column, primary: Column, secondary: Column, leads: Column, alone: Column) -> Column:
    """How exactly a candidate's title names a recording. anchors: lower-case names of the work; alone: nobody plays beside the lead."""
    low = F.lower(trimmed(title))
    mark = F.lower(trimmed(catalogue))
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    has_year = F.exists(wanted_years, lambda y: F.contains(low, y))
    has_work = F.exists(anchors, lambda a: F.contains(low, a))
    surname = F.lower(F.coalesce(F.try_element_at(names.tokens(composer_latin), F.lit(-1)), F.lit("")))
    has_composer = F.array_contains(F.transform(names.tokens(low), F.lower), surname) | ((trimmed(composer) != "") & F.contains(low, trimmed(composer))) | F.exists(names.tokens(composer), lambda t: (F.length(t) >= 2) & F.contains(low, t))
    has_mark = (mark != "") & (F.contains(low, mark) | F.contains(tight(low), tight(mark)))
    both, lead = names.mentions(low, primary) & names.mentions(low, secondary), names.mentions(low, leads)
    score = (
        F.when(has_year, 0.05).when(year_conflict(low, wanted_years), -0.05).otherwise(0.0) + F.when(has_work, 0.03).otherwise(0.0) + F.when(has_composer, 0.05).otherwise(0.0)
        + F.when(has_mark, 0.05).when((mark != "") & low.rlike(WORK_MARKS), -0.02).otherwise(0.0)
        + F.when(both, 0.04).when(lead, 0.01 + F.when(alone & has_work, 0.03).otherwise(0.0)).otherwise(0.0)
        + F.when(low.rlike(EDITIONS), -0.08).otherwise(0.0) + F.when(low.rlike(DISCS), -0.06).otherwise(0.0)
    )
    return F.when(low == "", -0.05).otherwise(score)


def match_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), MATCH_MARKS, " "))


def simple_match(text: Column, work: Column, composer: Column, leads: Column, orchestras: Column, year: Column) -> Column:
    """4 for a word of the work, 2 of the composer, 3 of a lead, 2 of an orchestra, 2 for the year; -5 for a page about people."""
    hay = match_text(text)
    quoted = lambda value: F.array_join(F.transform(F.filter(F.split(match_text(value), " "), lambda t: t != ""), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    hit = lambda value: (quoted(value) != "") & F.rlike(hay, quoted(value))
    score = (
        F.when(hit(work), 4).otherwise(0) + F.when(hit(composer), 2).otherwise(0) + F.when(hit(F.array_join(leads, " ")), 3).otherwise(0)
        + F.when(hit(F.array_join(orchestras, " ")), 2).otherwise(0) + F.when((year != "") & F.contains(hay, year), 2).otherwise(0)
        - F.when(hay.rlike(BIOGRAPHY) & ~hay.rlike(PERFORMANCE), 5).otherwise(0)
    )
    return F.when(hay == "", 0).otherwise(score)


def without_annotations(c: Column) -> Column:
    """A name without '(EN: ...)' and ', EN: ...'."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), r"(?i)\(\s*EN\s*[:：].*?\)", ""), r"(?i)[,，]\s*EN\s*[:：].*$", ""))


def explicit_latin(c: Column) -> Column:
    """The Latin name that an annotation gives; '' without one."""
    found = F.regexp_extract(trimmed(c), r"(?i)EN\s*[:：]\s*([^()]+?)(?=\s*(?:CHN|CN|中文)\s*[:：]|\)|$)", 1)
    bare = F.regexp_replace(trimmed(found), r"^[ ,;|)]+|[ ,;|)]+$", "")
    return F.when((bare != "") & names.looks_latin(bare), bare).otherwise("")


def search_query(c: Column) -> Column:
    """A search box's text: NFKC, lower case, its own class of marks (one of them a stray character) as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), r"""[·•・路,.;:'"`()（）\[\]\-_/\\]+""", " "), r"\s+", " "))
