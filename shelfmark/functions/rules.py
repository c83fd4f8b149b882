"""Decision tables over recordings, works, people and links as column expressions. Null texts are taken as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# Kinds of work, the words that tell them, in the order in which they are tried.
WORK_TYPES = ("orchestral", "concerto", "opera_vocal", "chamber_solo", "unknown")
WORK_TYPE_WORDS = [
    ("concerto", "协奏曲|concerto|concertante"),
    ("opera_vocal", "歌剧|声乐|清唱剧|弥撒|安魂曲|opera|vocal|oratorio|mass|requiem|cantata"),
    ("chamber_solo", "奏鸣曲|重奏|室内乐|独奏|无伴奏|变奏曲|小提琴奏鸣曲|钢琴奏鸣曲|sonata|quartet|quintet|trio|duo|chamber|solo|partita"),
    ("orchestral", "交响|交响诗|序曲|管弦|舞剧|芭蕾|组曲|symphon|orchestral|tone poem|overture|ballet|suite"),
]
# Instruments of concertos, then the other words, with the path of groups that each leads to.
CONCERTO_WORDS = [
    ("钢琴|piano", "钢琴协奏曲"), ("小提琴|violin", "小提琴协奏曲"), ("大提琴|cello", "大提琴协奏曲"), ("中提琴|viola", "中提琴协奏曲"), ("长笛|flute", "长笛协奏曲"),
    ("单簧管|clarinet", "单簧管协奏曲"), ("双簧管|oboe", "双簧管协奏曲"), ("巴松|bassoon", "巴松协奏曲"), ("小号|trumpet", "小号协奏曲"), ("圆号|horn", "圆号协奏曲"),
]
GROUP_WORDS = [
    ("歌剧|opera", ["歌剧与声乐", "歌剧"]), ("安魂曲|requiem", ["歌剧与声乐", "安魂曲"]), ("弥撒|mass", ["歌剧与声乐", "弥撒"]),
    ("清唱剧|神剧|oratorio|cantata", ["歌剧与声乐", "清唱剧"]), ("声乐|vocal|lied|song cycle", ["歌剧与声乐"]), ("交响曲|symphon", ["交响曲"]),
    ("交响诗|tone poem", ["管弦乐", "交响诗"]), ("序曲|overture", ["管弦乐", "序曲"]), ("组曲|suite", ["管弦乐", "组曲"]), ("舞剧|芭蕾|ballet", ["管弦乐", "舞剧与芭蕾"]),
    ("交响|管弦|orchestral", ["管弦乐"]), ("奏鸣曲|sonata", ["室内乐与独奏", "奏鸣曲"]), ("四重奏|quartet", ["室内乐与独奏", "四重奏"]), ("五重奏|quintet", ["室内乐与独奏", "五重奏"]),
    ("三重奏|trio", ["室内乐与独奏", "三重奏"]), ("二重奏|duo", ["室内乐与独奏", "二重奏"]), ("独奏|solo|partita", ["室内乐与独奏", "独奏"]), ("室内乐|chamber", ["室内乐与独奏"]),
]
# Words of ensembles' names.
CHORUS_WORDS = "chorus|choir|合唱"
ORCHESTRA_WORDS = "orchestra|philharmonic|symphony|sinfonieorchester|philharmoniker|orkester|orquesta|orchestre|kapelle|zenekara|乐团|乐队"
BATCH_ENSEMBLE_WORDS = "ensemble|quartet|quintet|trio|duo|octet|nonet|重奏|组合"
CREDIT_ENSEMBLE_WORDS = "ensemble|quartet|trio|重奏|组合"
# The part that a role plays in a kind of work.
ENSEMBLE_ROLES = ("orchestra", "ensemble", "choir", "group")
BUCKETS = {
    "concerto": {"primary": ("soloist",), "secondary": ("conductor", "singer", "instrumentalist", "person")},
    "opera_vocal": {"primary": ("conductor",), "secondary": ("soloist", "singer", "instrumentalist", "person")},
    "chamber_solo": {"primary": ("soloist", "instrumentalist", "person"), "secondary": ("conductor", "singer")},
    "": {"primary": ("conductor",), "secondary": ("soloist", "singer", "instrumentalist", "person")},
}
# Platforms by address, for links and for search results (two vocabularies), and their labels.
LINK_PLATFORMS = [(r"bilibili\.com", "bilibili"), (r"youtube\.com|youtu\.be", "youtube"), (r"music\.163\.com", "netease"), (r"music\.apple\.com", "apple-music"), (r"amazon\.[^/]+/music", "amazon-music")]
PLATFORM_LABELS = {"bilibili": "bilibili", "youtube": "YouTube", "netease": "网易云音乐", "apple-music": "Apple Music", "amazon-music": "Amazon Music", "local": "本地文件", "other": "其他资源"}
# A source's share of a record's confidence.
KIND_BONUS = {"existing-link": 0.12, "high-quality": 0.08, "streaming": 0.02}


def first_match(text: Column, rules: list[tuple[str, Column]], other: Column) -> Column:
    """The value of the first pattern that text holds, whatever its case."""
    out = other
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(f"(?i)({pattern})"), value).otherwise(out)
    return out


def work_type(hint: Column) -> Column:
    low = F.lower(trimmed(hint))
    return F.when(low.isin(*WORK_TYPES), low).otherwise("unknown")


def work_type_of_texts(texts: Column) -> Column:
    """The kind of work that titles and groups tell."""
    flat = F.array_join(F.filter(F.transform(texts, lambda x: F.lower(trimmed(x))), lambda x: x != ""), " ")
    return first_match(flat, [(p, F.lit(name)) for name, p in WORK_TYPE_WORDS], F.lit("unknown"))


def resolved_work_type(hint: Column, texts: Column) -> Column:
    return F.when(work_type(hint) != "unknown", work_type(hint)).otherwise(work_type_of_texts(texts))


def count_roles(credits: Column) -> Column:
    """struct(conductors, orchestras, soloists, singers, ensembles) of an array of credits."""
    n = lambda *roles: F.coalesce(F.when(credits.isNotNull(), F.size(F.filter(credits, lambda c: c["role"].isin(*roles)))), F.lit(0))
    return F.struct(
        n("conductor").alias("conductors"), n("orchestra").alias("orchestras"), n("soloist", "instrumentalist").alias("soloists"), n("singer").alias("singers"),
        n("ensemble", "chorus").alias("ensembles"),
    )


def family(hint: Column, n: Column) -> Column:
    """How a recording is presented, by its kind of work, else by who plays. n: count_roles."""
    kind, featured = work_type(hint), n["soloists"] + n["singers"]
    many = (n["ensembles"] > 0) | (featured > 1)
    return (
        F.when(kind == "concerto", "concerto").when(kind == "opera_vocal", "opera").when(kind == "chamber_solo", F.when(many, "chamber").otherwise("solo"))
        .when(kind == "orchestral", "orchestral").when((n["conductors"] > 0) | (n["orchestras"] > 0), "orchestral").when(many, "chamber")
        .when(featured == 1, "solo").otherwise("unknown")
    )


def missing_roles(kind: Column, n: Column) -> Column:
    """The roles that a recording of this family lacks, in order."""
    featured, group = n["soloists"] + n["singers"], n["orchestras"] + n["ensembles"]
    want = [
        (kind.isin("orchestral", "opera") & (n["conductors"] == 0), "conductor"),
        ((kind == "concerto") & (featured == 0), "soloist"),
        ((kind == "opera") & (featured == 0), "singer_or_soloist"),
        (kind.isin("orchestral", "concerto", "opera") & (group == 0), "orchestra_or_ensemble"),
        ((kind == "solo") & (featured == 0) & (group == 0), "soloist"),
        ((kind == "chamber") & (group == 0) & (featured < 2), "ensemble_or_multiple_soloists"),
    ]
    return F.array_compact(F.array(*(F.when(test, name) for test, name in want)))


def group_path(text: Column) -> Column:
    """The groups of a work by its title, from the widest; empty if nothing tells them."""
    put = lambda xs: F.array(*map(F.lit, xs))
    concerto = first_match(text, [(p, put(["协奏曲", name])) for p, name in CONCERTO_WORDS], put(["协奏曲"]))
    rest = first_match(text, [(p, put(path)) for p, path in GROUP_WORDS], F.array().cast("array<string>"))
    return F.when(text.rlike("(?i)(协奏曲|concerto|concertante)"), concerto).otherwise(rest)


def batch_ensemble_role(name: Column, other: Column) -> Column:
    return first_match(F.lower(trimmed(name)), [(CHORUS_WORDS, F.lit("chorus")), (ORCHESTRA_WORDS, F.lit("orchestra")), (BATCH_ENSEMBLE_WORDS, F.lit("ensemble"))], other)


def credit_ensemble_role(name: Column) -> Column:
    """chorus, orchestra or ensemble by the words of a name; null for others."""
    return first_match(F.lower(trimmed(name)), [(CHORUS_WORDS, F.lit("chorus")), (ORCHESTRA_WORDS, F.lit("orchestra")), (CREDIT_ENSEMBLE_WORDS, F.lit("ensemble"))], F.lit(None).cast("string"))


def batch_credits(hint: Column, slots: Column) -> Column:
    """array of struct(role, displayName) from the slots of a line entered by hand, by kind of work."""
    slot = lambda i: F.coalesce(F.get(slots, i), F.lit(""))
    filled = lambda x: (trimmed(x) != "") & (trimmed(x) != "-")
    names = lambda i: F.filter(F.transform(F.split(slot(i), r"\s*\+\s*"), lambda x: trimmed(x)), filled)
    credit = lambda role, name: F.struct(role.alias("role"), name.alias("displayName"))
    one = lambda i: F.filter(F.array(credit(F.lit("conductor"), trimmed(slot(i)))), lambda c: filled(c["displayName"]))
    each = lambda role, i: F.transform(names(i), lambda x: credit(F.lit(role), x))
    ensembles = lambda other, i: F.transform(names(i), lambda x: credit(batch_ensemble_role(x, F.lit(other)), x))
    told = lambda i: F.transform(F.filter(names(i), lambda x: F.lower(x).rlike(f"{CHORUS_WORDS}|{ORCHESTRA_WORDS}|{BATCH_ENSEMBLE_WORDS}")), lambda x: credit(batch_ensemble_role(x, F.lit("ensemble")), x))
    kind = work_type(hint)
    return (
        F.when(kind == "concerto", F.concat(each("soloist", 0), one(1), ensembles("orchestra", 2)))
        .when(kind == "opera_vocal", F.concat(one(0), each("singer", 1), ensembles("ensemble", 2)))
        .when(kind == "chamber_solo", F.concat(each("soloist", 0), told(1))).otherwise(F.concat(one(0), ensembles("ensemble", 1)))
    )


def credit_bucket(kind: Column, role: Column) -> Column:
    """primary, secondary, ensemble or ignore: the part of a role in a kind of work."""
    kind, role = F.lower(trimmed(kind)), F.lower(trimmed(role))
    part = lambda rules: F.when(role.isin(*rules["primary"]), "primary").when(role.isin(*rules["secondary"]), "secondary").otherwise("ignore")
    out = F.when(role.isin(*ENSEMBLE_ROLES), "ensemble")
    for name, rules in BUCKETS.items():
        out = out.when(kind == name, part(rules)) if name else out
    return out.otherwise(part(BUCKETS[""]))


def person_href(roles: Column, slug: Column) -> Column:
    kind = F.when(F.array_contains(roles, "conductor"), "conductors").when(F.array_contains(roles, "orchestra"), "orchestras").otherwise("people")
    return F.concat(F.lit("/"), kind, F.lit("/"), slug, F.lit("/"))


def href(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"/{kind}/"), key, F.lit("/"))


def link_platform(url: Column) -> Column:
    return first_match(url, [(p, F.lit(name)) for p, name in LINK_PLATFORMS], F.lit("other"))


def platform_label(platform: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in PLATFORM_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, platform), F.lit(PLATFORM_LABELS["other"]))


def read_link(link: Column) -> Column:
    """A link as it comes in: its type told by what it has, public unless said otherwise."""
    url, local, kind = trimmed(link["url"]), trimmed(link["localPath"]), trimmed(link["linkType"])
    is_local = (kind == "local") | ((kind == "") & (url == "") & (local != ""))
    return F.struct(
        F.coalesce(F.nullif(trimmed(link["platform"]), F.lit("")), F.lit("other")).alias("platform"), url.alias("url"), local.alias("localPath"), trimmed(link["title"]).alias("title"),
        F.when(is_local, "local").otherwise("external").alias("linkType"), F.when(trimmed(link["visibility"]) == "local-only", "local-only").otherwise("public").alias("visibility"),
    )


def is_renderable(link: Column, with_local: bool = True) -> Column:
    """Of a link that was read: it leads somewhere, and to a place that may be shown."""
    shown = F.lit(True) if with_local else link["visibility"] != "local-only"
    return F.when(link["linkType"] == "local", F.lit(with_local) & (link["localPath"] != "")).otherwise(shown & (link["url"] != ""))


def site_links(links: Column, with_local: bool = True) -> Column:
    return F.filter(F.transform(links, read_link), lambda x: is_renderable(x, with_local))


def link_href(link: Column) -> Column:
    return F.when(link["linkType"] == "local", F.concat(F.lit("/__local-resource?path="), F.url_encode(link["localPath"]))).otherwise(link["url"])


def link_issues(link: Column) -> Column:
    """Codes of what is wrong with a link that was read."""
    web = r"(?i)^https?://"
    found = link_platform(link["url"])
    mismatch = (link["platform"] != "other") & (found != "other") & (found != link["platform"])
    codes = F.when(~link["url"].rlike(web), F.array(F.lit("invalid-url"))).otherwise(
        F.array_compact(F.array(F.when(mismatch, "platform-mismatch"), F.when(link["title"].rlike(web), "title-looks-like-url")))
    )
    return F.when(link["linkType"] == "local", F.array().cast("array<string>")).otherwise(codes)


def zone(confidence: Column, exactness: Column, conflicts: Column, collaboration: Column, names_lead: Column) -> Column:
    """struct(zone, note) of a link candidate. conflicts: tokens of people that the draft does not have."""
    red = (F.size(conflicts) > 0) & (collaboration | ~names_lead | (F.size(conflicts) >= 2))
    put = lambda z, note: F.struct(F.lit(z).alias("zone"), note.alias("note"))
    return (
        F.when(red, put("red", F.concat(F.lit("conflicting-credit:"), F.array_join(F.slice(F.array_sort(conflicts), 1, 3), "/"))))
        .when((confidence >= 0.65) & (exactness >= 0.05), put("green", F.lit("high-confidence"))).when(exactness >= 0.0, put("yellow", F.lit("review-needed")))
        .otherwise(put("yellow", F.lit("low-evidence")))
    )


def collaborates(title: Column) -> Column:
    return F.lower(trimmed(title)).rlike("&| / | and | with |、")


def result_status(best_score: Column, has_final: Column, has_evidence: Column, unresolved: Column) -> Column:
    """not_found, partial or succeeded; best_score is null without records, unresolved are requested fields without a value."""
    found = F.coalesce(best_score, F.lit(0.0)) >= 0.45
    return F.when(~found, "not_found").when(~has_final & has_evidence, "partial").when(F.size(unresolved) > 0, "partial").otherwise("succeeded")


def record_confidence(score: Column, weight: Column, kind: Column) -> Column:
    bonus = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KIND_BONUS.items() for x in kv)), kind), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), score * 0.7 + weight * 0.2 + bonus))
