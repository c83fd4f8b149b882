"""What is shown of recordings: credits with the names of their people, titles by family. Credits of one recording are few; they are one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names, rules
from shelfmark.functions.text import trimmed

# What joins parts of a title, names beside each other, and date and place.
DASH, SLASH, META = " - ", " / ", " 路 "
GROUPS = {"conductors": ("conductor",), "orchestras": ("orchestra",), "groups": ("ensemble", "chorus"), "soloists": ("soloist", "instrumentalist"), "singers": ("singer",)}


def _joined(parts: Column, mark: str = DASH) -> Column:
    return F.array_join(names.distinct(parts), mark)


def credit_displays(recordings: DataFrame, people: DataFrame) -> DataFrame:
    """id and an array for each of GROUPS: struct(key, primary, fullLabel, secondary, shortLabel), in the credits' order, each key once;
    soloists and singers who conduct are left out. Credits of people who are not known go by the name that they have. Recordings
    without credits stay, with empty arrays; people must have one row an id."""
    return displays_of_credits(recordings.select("id", F.posexplode_outer("credits").alias("pos", "c")), people).drop("people")


def displays_of_credits(each: DataFrame, people: DataFrame) -> DataFrame:
    """credit_displays of single credits (id, pos, c; a row with null pos for a recording without any), and people: their ids in the credits' order."""
    # a credit's text is its key only where it names no person: the others don't pass through Arrow
    bare = F.col("pos").isNotNull() & (F.coalesce("c.personId", F.lit("")) == "")
    texts = each.filter(bare).withColumn("_text", names.search_text(trimmed(F.col("c.displayName"))))
    each = texts.unionByName(each.filter(~bare).withColumn("_text", F.lit(None).cast("string")))
    who = people.select(F.col("id").alias("_person"), names.display(F.col("name"), F.col("nameLatin"), F.col("aliases")).alias("_d"), names.short_latin(F.col("nameLatin")).alias("_short"))
    each = each.join(who, F.col("c.personId") == F.col("_person"), "left")
    d, role, plain = F.col("_d"), F.col("c.role"), trimmed(F.col("c.displayName"))
    group, known = role.isin(*names.ENSEMBLES), F.col("_person").isNotNull()
    filled = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    key = filled(F.when(known, trimmed(F.col("_person"))), F.col("c.personId"), F.col("_text"))
    full = F.when(group, filled(d["full"], d["primary"])).otherwise(d["primary"])
    short = F.when(group, filled(names.first(d["abbreviations"]), d["primary"])).otherwise(d["primary"])
    second = F.when(group, filled(d["latin"], d["full"], d["primary"])).otherwise(filled(F.col("_short"), d["latin"], d["full"], d["primary"]))
    pick = lambda x: F.when(known, x).otherwise(plain)
    part = F.coalesce(*(F.when(role.isin(*roles), name) for name, roles in GROUPS.items()))
    item = F.struct("pos", part.alias("part"), role.alias("role"), key.alias("key"), pick(d["primary"]).alias("primary"), pick(full).alias("fullLabel"), pick(second).alias("secondary"), pick(short).alias("shortLabel"))
    there = F.col("pos").isNotNull()
    each = each.select("id", F.when(there & part.isNotNull() & (key != ""), item).alias("x"), F.when(there, F.struct("pos", F.col("c.personId").alias("id"))).alias("p"))
    every = each.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.array_sort(F.collect_list("p")).alias("p"))
    # each key once in its part; most recordings name nobody twice
    every = every.withColumn("_keys", F.transform("x", lambda c: F.struct(c["part"], c["key"])))
    once = F.filter("x", lambda c, i: F.array_position("_keys", F.struct(c["part"], c["key"])) == i + 1)
    every = every.withColumn("x", F.when(F.size(F.array_distinct("_keys")) == F.size("_keys"), F.col("x")).otherwise(once))
    of = lambda name: F.filter("x", lambda c: c["part"] == name)
    out = every.select("id", F.col("p.id").alias("people"), *(of(name).alias(name) for name in GROUPS))
    lead = F.transform("conductors", lambda x: x["key"])
    apart = lambda c: F.when((F.size("conductors") == 0) | (F.size(c) == 0), F.col(c)).otherwise(F.filter(c, lambda x: ~F.array_contains(lead, x["key"]))).alias(c)
    return out.select("id", "people", "conductors", "orchestras", "groups", apart("soloists"), apart("singers"))


def recording_displays(recordings: DataFrame, people: DataFrame) -> DataFrame:
    """id, family, title, subtitle, meta_text, note_excerpt of recordings (id, title, workTypeHint, credits, performanceDateText,
    venueText, notes): the title names who leads, who plays with them and when or where, as the family asks for."""
    told = titled(recordings.drop("credits").join(credit_displays(recordings, people), "id"))
    return told.select("id", "family", F.col("_title").alias("title"), "subtitle", "meta_text", "note_excerpt")


def titled(shown: DataFrame) -> DataFrame:
    """shown (recordings with their credit_displays) with family, _title, subtitle, meta_text and note_excerpt."""
    list_of = lambda group, field: F.when(F.size(group) == 0, "").otherwise(_joined(F.transform(group, lambda x: x[field])))
    filled = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    counts = F.struct(*(F.size(name).alias(as_) for name, as_ in (("conductors", "conductors"), ("orchestras", "orchestras"), ("soloists", "soloists"), ("singers", "singers"), ("groups", "ensembles"))))
    kind = F.col("family")
    shown = shown.withColumn("family", rules.family(F.col("workTypeHint"), counts))
    day, place = trimmed(F.col("performanceDateText")), trimmed(F.col("venueText"))
    when = filled(day, place)

    # columns, so that names are joined once, however many families ask for them; without any names nothing is joined
    whole = {"primary": "fullLabel", "secondary": "secondary"}
    shown = shown.withColumns({f"_{f}_{g}": list_of(g, whole[f] if g in ("orchestras", "groups") else f) for f in whole for g in GROUPS})

    def line(field: str) -> Column:
        conductor, soloist, singer, orchestra, group = (F.col(f"_{field}_{g}") for g in ("conductors", "soloists", "singers", "orchestras", "groups"))
        ensemble = _joined(F.array(orchestra, group))
        few = _joined(F.array(filled(group, soloist, singer), place, day))
        return (
            F.when(kind == "concerto", _joined(F.array(conductor, soloist, ensemble, when))).when(kind == "opera", _joined(F.array(conductor, filled(singer, soloist), ensemble, when)))
            .when(kind.isin("solo", "chamber"), few).otherwise(_joined(F.array(conductor, ensemble, when)))
        )

    both = _joined(F.array(F.col("performanceDateText"), F.col("venueText")), META)
    notes = trimmed(F.col("notes"))
    clipped = F.when(F.length(notes) > 120, F.concat(trimmed(F.substring(notes, 1, 120)), F.lit("…"))).otherwise(notes)
    shown = shown.withColumn("_title", filled(line("primary"), trimmed(F.col("title")), F.lit("*")))
    return shown.withColumns({"subtitle": filled(line("secondary"), both, F.col("_title")), "meta_text": both, "note_excerpt": clipped})
