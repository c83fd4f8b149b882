"""People: which person a credit means, which poor entry a better one stands for, credits that say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import names
from shelfmark.functions.text import trimmed
from shelfmark.operators import resolve, shared

LEGACY = ("fullName", "displayName", "displayFullName", "displayLatinName")


def _names(people: DataFrame) -> Column:
    """All names of a person that its table has."""
    return F.concat(F.array(*(F.col(c) for c in ("name", "nameLatin", *LEGACY) if c in people.columns)), F.coalesce("aliases", names.none()))


def keyed(people: DataFrame) -> DataFrame:
    """(id, roles, key, quality): people by every name key that is not ''. Placeholders are left out."""
    q = names.quality({c: F.col(c) for c in people.columns})
    each = people.filter(~names.is_placeholder_person(F.col("id"), F.col("name"))).select("id", "roles", q.alias("quality"), F.explode(F.array_distinct(_names(people))).alias("n"))
    return each.select("id", "roles", "quality", names.name_key(F.col("n")).alias("key")).filter("key <> ''").distinct()


def dedupe_credits(credits: Column) -> Column:
    """The first credit of each role, person and name, trimmed."""
    plain = F.transform(credits, lambda c: F.struct(c["role"].alias("role"), trimmed(c["personId"]).alias("personId"), trimmed(c["displayName"]).alias("displayName"), trimmed(c["label"]).alias("label")))
    key = lambda c: F.concat_ws("::", trimmed(c["role"]), c["personId"], c["displayName"])
    return F.filter(plain, lambda c, i: F.array_position(F.transform(plain, key), key(c)) == i + 1)


def contained(short: DataFrame, s: str, long: DataFrame, l: str, least: int) -> DataFrame:
    """(s, l): each string of short[s] with the strings of long[l] that hold it and are longer. Both are distinct and not ''."""
    cut = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k)))
    grams = long.filter(F.length(l) >= least).select(l, F.explode(cut(l, least)).alias("g"))
    common = grams.groupBy("g").agg(F.count("*").alias("n"))
    own = short.filter(F.length(s) >= least).select(s, F.explode(cut(s, least)).alias("g"))
    # of those whose every string is known, the rarest
    rare = own.join(common, "g", "left").groupBy(s).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("x")).filter("x.n > 0").select(s, F.col("x.g").alias("g"))
    met = rare.join(grams, "g").select(s, l)
    tiny = short.filter(F.length(s) < least).select(s, F.col(s).alias("g"))
    pieces = long.select(l, F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(least - 1), F.length(l))), lambda k: cut(l, k)))).alias("g"))
    return met.unionByName(tiny.join(pieces, "g").select(s, l)).filter(F.contains(l, F.col(s)) & (F.length(l) > F.length(s))).distinct()


def person_for_credit(credits: DataFrame, people: DataFrame, least: int = 5) -> DataFrame:
    """(role, displayName, person): the person that a credit means. credits: distinct (role, displayName).

    A group's name must be one of the person's; of several persons the best known wins, then the smaller id. Another name may be a part
    of the person's or hold it if it has `least` characters; the best score wins, and equal best scores mean nobody.

    Equal keys meet by a hash join. A name that is part of another has all its strings of `least` characters there; it is looked up by the
    one that fewest of the others have, so that what all names share (a title, a first name) brings nobody together. A person's names that are
    shorter than that are looked up whole, among the credit's strings of their length."""
    each = credits.select("role", "displayName", names.name_key(F.col("displayName")).alias("target")).filter(~names.is_placeholder_value(F.col("displayName"))).distinct()
    who = keyed(people)
    fits = names.fits_role(F.col("role"), F.col("roles"))
    group = F.col("role").isin(*names.ENSEMBLES)
    equal = each.join(who.withColumnRenamed("key", "target"), "target").filter(fits).withColumn("score", F.length("target") + 100)
    alone = each.filter(~group & (F.length("target") >= least))
    wanted, held = alone.select("target").distinct(), who.select("key").distinct()
    pairs = contained(held, "key", wanted, "target", least).unionByName(contained(wanted, "target", held, "key", least).select("key", "target")).filter("key <> target").distinct()
    part = alone.join(pairs, "target").join(who, "key").filter(fits).withColumn("score", F.least(F.length("key"), F.length("target")) + 10)
    cols = ["role", "displayName", "id", "quality", "score"]
    best = equal.select(*cols).union(part.select(*cols)).groupBy("role", "displayName", "id", "quality").agg(F.max("score").alias("score"))
    w = Window.partitionBy("role", "displayName")
    order = [F.when(group, 0).otherwise(-F.col("score")), F.desc("quality"), "id"]
    ranked = best.withColumns({"r": F.row_number().over(w.orderBy(*order)), "second": F.lead("score").over(w.orderBy(*order))})
    clear = group | F.col("second").isNull() | (F.col("second") < F.col("score"))
    return ranked.filter("r = 1").filter(clear).select("role", "displayName", F.col("id").alias("person"))


def is_thin(people: DataFrame, group: bool) -> Column:
    """An entry of which hardly anything is known: a group, or a single person."""
    blank = F.lit(True)
    for c in ("country", "summary", "avatarSrc", "imageSourceUrl", "imageAttribution", *LEGACY):
        if c in people.columns:
            blank = blank & (trimmed(F.col(c)) == "")
    of_kind = names.is_ensemble(F.col("roles")) if group else ~names.is_ensemble(F.col("roles"))
    return of_kind & ~names.is_placeholder_person(F.col("id"), F.col("name")) & blank & (F.size(F.coalesce("aliases", names.none())) <= (0 if group else 1))


def strip_polluted(c: Column) -> Column:
    """A group's name without the first mark of other data and without years."""
    bare = F.regexp_replace(F.regexp_replace(trimmed(c), f"(?is)^(.*?)({names.POLLUTED})", "$1 "), r"\b[0-9]{4}\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def group_keys(people: DataFrame) -> DataFrame:
    """(id, key): a group's name keys that say enough: no short code, more than four characters."""
    values = F.concat(_names(people), F.array("slug"))
    each = people.filter(names.is_ensemble(F.col("roles"))).select("id", F.explode(values).alias("v")).select("id", trimmed(F.col("v")).alias("v"))
    each = each.select("id", "v", names.name_key(strip_polluted(F.col("v"))).alias("key"))
    return each.filter(~F.col("v").rlike("(?i)^[A-Z0-9]{2,6}$") & (F.length("key") > 4)).select("id", "key").distinct()


def group_replacements(people: DataFrame) -> DataFrame:
    """(id, replacement): for groups that are thin or whose slug holds other data, the best known group of a fitting role that shares a name
    key or comes within two edits of one; nothing where that one is not better known. Keys meet by equality, near ones by what is left of them
    without two characters (resolve.near_tails) or without their ends.

    Of the groups of one key the two best known are enough, for any role and for a chorus's (one may be the group itself), so copies of a name
    don't meet each other. Only better known groups meet at all, and pairs are told apart before they are sorted."""
    q = names.quality({c: F.col(c) for c in people.columns})
    low = is_thin(people, True) | names.is_polluted(F.col("slug"), F.col("roles"))
    role = F.when(F.array_contains("roles", "orchestra"), "orchestra").when(F.array_contains("roles", "chorus"), "chorus").otherwise("ensemble")
    facts = people.select("id", "roles", role.alias("role"), q.alias("quality"), low.alias("low"), names.is_placeholder_person(F.col("id"), F.col("name")).alias("blank"))
    keys = shared.written(group_keys(people).join(facts, "id"))
    poor = keys.filter("low").select(F.col("id").alias("a"), "role", F.col("quality").alias("quality_a"), F.col("key").alias("key_a"))
    chorus = names.fits_role(F.lit("chorus"), F.col("roles"))
    w = Window.orderBy(F.desc("quality"), "id")
    ranked = keys.filter("NOT blank").withColumn("fits", chorus).withColumns({"_any": F.row_number().over(w.partitionBy("key")), "_fit": F.row_number().over(w.partitionBy("key", "fits"))})
    good = ranked.filter("_any <= 2 OR fits AND _fit <= 2").select(F.col("id").alias("b"), "roles", F.col("quality").alias("quality_b"), F.col("key").alias("key_b"))
    better = (F.col("quality_b") > F.col("quality_a")) & (F.col("a") != F.col("b")) & names.fits_role(F.col("role"), F.col("roles"))
    pair = ["a", "quality_b", "b"]
    equal = poor.join(good, F.col("key_a") == F.col("key_b")).filter(better).select(*pair)
    wide_a, wide_b = poor.filter(F.length("key_a") >= 12), good.filter(F.length("key_b") >= 12)
    near = resolve.near_tails(wide_a, "key_a", wide_b, "key_b", 8, 2, better).select(*pair)
    # one key within the other: the longer without its ends
    ends = lambda k: F.array_distinct(F.array(*(F.substring(k, 1 + i, F.length(k) - i - j) for i, j in ((1, 0), (0, 1), (2, 0), (1, 1), (0, 2)))))
    inner = wide_a.join(wide_b.withColumn("_in", F.explode(ends(F.col("key_b")))), F.col("key_a") == F.col("_in")).filter(better).select(*pair)
    outer = wide_a.withColumn("_in", F.explode(ends(F.col("key_a")))).join(wide_b, F.col("key_b") == F.col("_in")).filter(better).select(*pair)
    best = equal.union(near).union(inner).union(outer).groupBy("a").agg(F.min(F.struct((-F.col("quality_b")).alias("n"), "b")).alias("best"))
    return best.select(F.col("a").alias("id"), F.col("best.b").alias("replacement"))


def split_composite(credits: Column) -> Column:
    """Credits of groups whose name is several groups', split by role; a part that is only 'choir' takes the orchestra's name before it."""
    from shelfmark.functions import rules

    tail = r"(?i)\s+(?:orchestra|philharmonic(?:\s+orchestra)?|symphony(?:\s+orchestra)?|sinfonieorchester|philharmoniker|orkester|orquesta|orchestre|kapelle|zenekara|乐团|乐队)$"

    def one(c: Column) -> Column:
        label = F.when(trimmed(c["label"]) != "", F.concat(trimmed(c["label"]), F.lit("拆分"))).otherwise("复合署名拆分")
        parts = F.filter(F.transform(F.split(trimmed(c["displayName"]), r"\s*[/&]\s*"), trimmed), lambda x: x != "")
        orchestra = names.first(F.filter(parts, lambda x: rules.credit_ensemble_role(x) == "orchestra"))
        prefix = trimmed(F.regexp_replace(orchestra, tail, ""))
        named = F.transform(parts, lambda x: F.when(x.rlike("(?i)^(chorus|choir|合唱)$") & (prefix != ""), F.concat(prefix, F.lit(" "), x)).otherwise(x))
        made = F.transform(named, lambda x: F.struct(rules.credit_ensemble_role(x).alias("role"), F.lit("").alias("personId"), x.alias("displayName"), label.alias("label")))
        splits = c["role"].isin(*names.ENSEMBLES) & trimmed(c["displayName"]).rlike("[/&]") & (F.size(parts) >= 2) & F.forall(made, lambda x: x["role"].isNotNull())
        return F.when(splits, made).otherwise(F.array(F.struct(*(c[k].alias(k) for k in ("role", "personId", "displayName", "label")))))

    return F.flatten(F.transform(credits, one))
