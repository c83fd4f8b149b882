"""Names of people, groups and works: keys to compare them by, what is shown of them, how well they are known. Null texts are taken as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc, strip_accents, trimmed

# Words of a Latin name that are no surname.
PARTICLES = ("von", "van", "de", "del", "der", "di", "da", "la", "le")
SURNAME_PARTICLES = ("da", "de", "del", "della", "der", "di", "du", "la", "le", "ten", "ter", "van", "von")
# Marks that a key leaves out.
SEARCH_MARKS = r"""[·•・・,.;:'"`()（）\[\]\-_/\\]+"""
KEY_MARKS = r"""[\s'"`鈥溾€濃€樷€?,;:!?()\[\]{}\-_/\\|&]+"""
# Marks of a group's name that was put together from others, and of one that holds other data.
COMPOSITE = r"\s+/\s+|\s+&\s+|\bcurrently\b|\([^)]+\)"
CAPITALS = r"\b[A-Z]{2,5}\b(?:\s*&\s*\b[A-Z]{1,5}\b)+"
POLLUTED = "时间|地点|currently|current|chn"
PLACEHOLDERS = ("", "-", "unknown", "未知", "未填写")
ENSEMBLES = ("orchestra", "ensemble", "chorus")


def none() -> Column:
    return F.array().cast("array<string>")


def distinct(values: Column) -> Column:
    """Trimmed values that are not '', each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, none()), trimmed), lambda x: x != ""))


def first(values: Column) -> Column:
    """The first value, '' if there is none."""
    return F.coalesce(F.get(values, 0), F.lit(""))


def is_chinese(c: Column) -> Column:
    return c.rlike(r"[\x{3400}-\x{9fff}]")


def holds_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[\x{4e00}-\x{9fff}]")


def looks_latin(c: Column) -> Column:
    return trimmed(c).rlike("[A-Za-z]") & ~holds_cjk(c)


def is_abbreviation(c: Column) -> Column:
    return trimmed(c).rlike(r"^[A-Z0-9][A-Z0-9 .&/-]{1,11}$")


def search_text(c: Column) -> Column:
    """NFKC, lower case, marks as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), SEARCH_MARKS, " "), r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    """NFKC, lower case, without blanks and marks; points and middle dots stay."""
    return F.regexp_replace(F.lower(nfkc(trimmed(c))), r"(?U)" + KEY_MARKS, "")


def ascii_fold(c: Column) -> Column:
    return strip_accents(trimmed(c))


def primary_name(name: Column, aliases: Column) -> Column:
    """A Chinese alias that is shorter than the name, else another Chinese one, else the name."""
    name, chinese = trimmed(name), F.filter(distinct(aliases), is_chinese)
    shorter = F.filter(chinese, lambda x: F.length(x) < F.length(name))
    other = F.filter(chinese, lambda x: x != name)
    return F.coalesce(F.get(shorter, 0), F.get(other, 0), name)


def full_name(name: Column, aliases: Column) -> Column:
    """The name if it is Chinese, else a Chinese alias that holds the primary name and more, else a longer one, else the name."""
    name, primary = trimmed(name), primary_name(name, aliases)
    longer = F.filter(distinct(F.concat(F.coalesce(aliases, none()), F.array(name))), lambda x: is_chinese(x) & (F.length(x) > F.length(primary)))
    holding = F.filter(longer, lambda x: F.contains(x, primary))
    return F.when(is_chinese(name), name).otherwise(F.coalesce(F.get(holding, 0), F.get(longer, 0), F.nullif(name, F.lit("")), primary))


def short_latin(latin: Column) -> Column:
    """The last word of a Latin name that is no particle."""
    words = F.filter(F.split(trimmed(latin), r"\s+"), lambda x: (x != "") & ~F.lower(x).isin(*PARTICLES))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), trimmed(latin))


def display(name: Column, latin: Column, aliases: Column) -> Column:
    """struct(primary, full, latin, aliases, abbreviations): what is shown of a person, a group or a composer."""
    some = F.coalesce(aliases, none())
    return F.struct(
        primary_name(name, aliases).alias("primary"), full_name(name, aliases).alias("full"), trimmed(latin).alias("latin"),
        distinct(F.concat(some, F.array(name, latin))).alias("aliases"), distinct(F.filter(some, is_abbreviation)).alias("abbreviations"),
    )


def search_texts(shown: Column, countries: Column) -> Column:
    """struct(primaryText, secondaryText, matchTokens, aliasTokens) of display."""
    head = F.coalesce(F.nullif(shown["full"], F.lit("")), shown["primary"])
    aside = distinct(F.concat(F.array(F.when(shown["primary"] != head, shown["primary"]), shown["latin"]), shown["abbreviations"]))
    every = F.concat(F.array(shown["primary"], shown["full"], shown["latin"]), shown["aliases"], shown["abbreviations"], F.coalesce(countries, none()))
    return F.struct(
        head.alias("primaryText"), F.array_join(aside, " / ").alias("secondaryText"), distinct(every).alias("matchTokens"),
        distinct(F.concat(shown["aliases"], shown["abbreviations"])).alias("aliasTokens"),
    )


def website_display(shown: Column) -> Column:
    """struct(heading, short, latin) of display."""
    head = F.coalesce(F.nullif(shown["full"], F.lit("")), shown["primary"])
    return F.struct(head.alias("heading"), F.when(shown["primary"] != head, shown["primary"]).otherwise("").alias("short"), shown["latin"].alias("latin"))


def is_ensemble(roles: Column) -> Column:
    return F.arrays_overlap(F.coalesce(roles, none()), F.array(*map(F.lit, ENSEMBLES)))


def fits_role(role: Column, roles: Column) -> Column:
    """Whether a person of these roles can have a credit of this role."""
    has = lambda *xs: F.arrays_overlap(F.coalesce(roles, none()), F.array(*map(F.lit, xs)))
    return (
        F.when(role.isin("orchestra", "ensemble"), has("orchestra", "ensemble", "chorus")).when(role == "chorus", has("chorus", "ensemble")).when(role == "conductor", has("conductor"))
        .when(role == "singer", has("singer")).when(role.isin("soloist", "instrumentalist"), has("soloist", "instrumentalist")).otherwise(F.lit(True))
    )


def is_placeholder_value(c: Column) -> Column:
    return name_key(c).isin(*PLACEHOLDERS)


def is_placeholder_person(id_: Column, name: Column) -> Column:
    return (trimmed(id_) == "person-item") | is_placeholder_value(name)


def is_composite(name: Column, roles: Column) -> Column:
    """A group whose name looks like several, or like one with a note."""
    return is_ensemble(roles) & (trimmed(name).rlike(COMPOSITE) | trimmed(name).rlike(CAPITALS))


def is_polluted(slug: Column, roles: Column) -> Column:
    return is_ensemble(roles) & trimmed(slug).rlike(f"(?i){POLLUTED}")


def quality(p: dict[str, Column]) -> Column:
    """How much is known of a person; p holds the person's columns by name, those that are missing count for nothing."""
    text = lambda k: trimmed(p[k]) if k in p else F.lit("")
    known = lambda k, n: F.when(text(k) != "", n).otherwise(0)
    differ = (text("name") != "") & (text("nameLatin") != "") & (name_key(text("name")) != name_key(text("nameLatin")))
    legacy = [text(k) != "" for k in ("fullName", "displayName", "displayFullName", "displayLatinName") if k in p]
    has_legacy = F.lit(False)
    for test in legacy:
        has_legacy = has_legacy | test
    return (
        known("country", 3) + known("summary", 4) + known("avatarSrc", 2) + known("imageSourceUrl", 2) + known("imageAttribution", 1)
        + F.least(F.size(F.coalesce(p["aliases"], none())), F.lit(6)) + known("nameLatin", 1) + F.when(differ, 2).otherwise(0) + F.when(has_legacy, 1).otherwise(0)
    )


def match_score(keys: Column, target: Column, least: Column | int = 5, partial: bool = True) -> Column:
    """How well the best of a person's name keys meets a target key: 100 and its length if they are equal, 10 and the shorter one's
    length if one holds the other and the target has `least` characters, else 0."""
    each = lambda k: F.when(k == target, F.length(target) + 100).when(
        F.lit(partial) & (F.length(target) >= least) & (F.contains(k, target) | F.contains(target, k)), F.least(F.length(k), F.length(target)) + 10
    ).otherwise(0)
    some = F.array_max(F.transform(F.filter(keys, lambda k: k != ""), each))
    return F.when(target == "", 0).otherwise(F.coalesce(some, F.lit(0)))


def condensed_latin(value: Column) -> Column:
    """First name and surname with its particles, where a Latin name has more; and the same without accents."""
    parts = F.filter(F.split(trimmed(value), r"\s+"), lambda x: x != "")
    n = F.size(parts)
    back = F.reverse(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))))  # middle words from the last
    stop = F.array_position(F.transform(back, lambda x: F.lower(x).isin(*SURNAME_PARTICLES)), F.lit(False))
    kept = F.when(stop == 0, F.size(back)).otherwise(stop - 1).cast("int")
    short = F.array_join(F.concat(F.slice(parts, 1, 1), F.reverse(F.slice(back, F.lit(1), kept)), F.slice(parts, -1, 1)), " ")
    folded = ascii_fold(short)
    out = F.array_distinct(F.array_compact(F.array(short, F.when(looks_latin(folded), folded))))
    return F.when(looks_latin(value) & (n >= 3) & (short != trimmed(value)), out).otherwise(none())


def without_catalogue(segment: Column, catalogue: Column) -> Column:
    """A work's title without the catalogue mark at its end; '' if it is nothing else. The mark is a column, so its characters are escaped."""
    segment, mark = trimmed(segment), trimmed(catalogue)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[，,:：;；()\[\]{}]+", " "), r"\s+", " "))
    escaped = F.regexp_replace(F.regexp_replace(mark, r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"\\s+")
    cut = F.trim(F.regexp_replace(segment, F.concat(F.lit(r"(?i)(?:\s*[,，:：;；/|·-]\s*|\s+)\(?"), escaped, F.lit(r"\)?$")), F.lit("")))
    cut = F.trim(F.regexp_replace(cut, F.concat(F.lit(r"(?i)\("), escaped, F.lit(r"\)$")), F.lit("")))
    return F.when((segment == "") | (mark == ""), segment).when(plain(segment) == plain(mark), "").otherwise(cut)


def tokens(value: Column) -> Column:
    """Runs of Latin letters and Chinese characters."""
    return F.filter(F.split(trimmed(value), r"[^A-Za-z\x{4e00}-\x{9fff}]+"), lambda x: x != "")


def same_person(left: Column, right: Column) -> Column:
    """Names that are equal or part of each other by letters, or whose words are, in order, among the other's."""
    bare = lambda c: F.lower(F.regexp_replace(trimmed(c), r"[^A-Za-z\x{4e00}-\x{9fff}]+", ""))
    a, b = bare(left), bare(right)
    x, y = (F.transform(tokens(c), lambda t: F.lower(t)) for c in (left, right))
    among = lambda short, long: F.aggregate(long, F.lit(0), lambda n, t: F.when((n < F.size(short)) & (t == F.get(short, n)), n + 1).otherwise(n)) == F.size(short)
    words = (F.size(x) >= 2) & (F.size(y) >= 2) & (among(x, y) | among(y, x))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | words)


def mentions(lowered: Column, values: Column) -> Column:
    """Whether a lower-case title holds the last word of one of the names: as a word if it is Latin, else as a part."""
    held = F.transform(tokens(lowered), lambda t: F.lower(t))

    def one(value: Column) -> Column:
        last = F.lower(F.try_element_at(tokens(value), F.lit(-1)))
        latin = (F.length(last) >= 3) & last.rlike(r"^[\x00-\x7F]*$")
        return F.coalesce(F.when(latin, F.array_contains(held, last)).otherwise((F.length(last) >= 2) & F.contains(lowered, last)), F.lit(False))

    return F.exists(F.coalesce(values, none()), one)


# What ends a Chinese name within a sentence, and phrases of the encyclopaedia that it was taken from.
CLAUSE = r"(是|为|由|系|位于|成立于|创建于|创立于|于)[\s\S]*$"
BOILERPLATE = "百度百科是一部内容开放、自由的网络百科全书|百度百科是一部内容开放自由的网络百科全书|百度百科"


def chinese_name(c: Column) -> Column:
    """A Chinese name without brackets, what follows a mark, and the rest of a sentence."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^()]{0,80}\)", " "), r"[,:;|].*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, BOILERPLATE, ""), CLAUSE, ""), r"(?U)\s+", "")


def chinese_name_score(c: Column, score: Column, reference: Column) -> Column:
    """The candidate's score, more for a name in parts and for length, less for the name at hand; -1 for what is no Chinese name."""
    raw, name = F.coalesce(c, F.lit("")), chinese_name(c)
    no_name = raw.rlike("百度百科|内容开放|网络百科全书") | raw.rlike("(?:是|为|由|系|位于|成立于|创建于|创立于).{2,}") | ~name.rlike(r"^[\x{3400}-\x{9fff}路·]{2,24}$")
    total = score + F.when(name.rlike("[路·]"), 8).otherwise(0) + F.least(F.length(name), F.lit(16)) - F.when(name == chinese_name(reference), 4).otherwise(0)
    return F.when(no_name, F.lit(-1.0)).otherwise(total.cast("double"))


def entity_score(kind: Column, image: Column, summary: Column, filled: Column, confidence: Column) -> Column:
    """How good a source of data on an entity is: by kind, image, summary, the number of fields that it fills, and its own confidence."""
    source = F.when(kind == "wikimedia-commons", 36).when(kind == "wikipedia", 32).when(kind == "baidu-baike", 30).when(kind == "llm", 28).otherwise(16)
    text = F.coalesce(summary, F.lit(""))
    sure = F.floor(F.coalesce(confidence, F.lit(0.55)) * 25 + 0.5)
    return source + F.when(F.coalesce(image, F.lit("")) != "", 20).otherwise(0) + F.least(F.length(text) / 6, F.lit(15.0)) + filled * 6 + sure
