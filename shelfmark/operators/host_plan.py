"""The queries that a host is asked for an item: slices of many generators in order, each text once, anchors put into fixed slots, ten kept.

All items in one plan. Generators are rows (item, generator, position from 0, query, anchors); a plan is a short table of slices. Rows are dealt by
item once; what meets in one row is one item's queries, some dozens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import matching, names, queries
from shelfmark.functions.text import trimmed
from shelfmark.operators import shared


@dataclass(frozen=True)
class Injection:
    """The first query of a generator with a mark among its anchors; where it isn't in the first `window` places, it is moved or put to `slot` (from 0)."""

    mark: str
    generator: str
    window: int
    slot: int


@dataclass(frozen=True)
class Plan:
    cjk: bool
    #: (generator, from, to), in order: what stands first, and what follows, sorted by fit.
    first: tuple[tuple[str, int, int], ...]
    sorted: tuple[tuple[str, int, int], ...]
    injections: tuple[Injection, ...] = ()
    #: where a year's anchor and an exact collaboration are looked for; none where the plan doesn't want them
    year: tuple[tuple[str, int, int], ...] = ()
    exact: tuple[tuple[str, int, int], ...] = ()
    most: int = 10


def _s(*slices: str) -> tuple[tuple[str, int, int], ...]:
    out = []
    for s in slices:
        name, _, cut = s.partition("[")
        start, _, stop = cut.rstrip("]").partition(":")
        out.append((name, int(start or 0), int(stop)))
    return tuple(out)


# The slices, windows and slots of the two kinds of hosts.
CHINESE = Plan(
    cjk=True,
    first=_s(
        "profile_zh[:2]", "chamber_cjk[:2]", "named_surname[:2]", "named_year[:2]", "solo_opus[:2]", "chamber_latin[:7]", "cjk_context[:1]", "decade[:2]", "bundle[:1]", "bundle_context[:1]", "work_rescue[:2]",
        "year_anchor[:1]", "primary_only[:3]", "bilingual[:1]", "bilingual_alias[:1]", "alias[:1]", "profile_latin[:1]",
    ),
    sorted=_s(
        "chamber_cjk[:2]", "named_surname[:2]", "named_year[:2]", "solo_opus[:2]", "chamber_latin[:7]", "cjk_context[:1]", "bundle_context[:1]", "decade[:2]", "bundle[:1]", "work_rescue[:2]", "year_anchor[:1]",
        "primary_only[:3]", "bilingual[:3]", "bilingual_alias[:3]", "zh[:3]", "latin[:3]", "profile_mixed[:1]", "mixed[:2]", "alias[:2]",
    ),
    injections=(
        Injection("named_duo", "chamber_cjk", 2, 0), Injection("compact_duo", "chamber_cjk", 8, 1), Injection("latin_duo", "chamber_latin", 6, 3), Injection("solo_opus", "solo_opus", 6, 1),
        Injection("trailer", "chamber_latin", 10, 5), Injection("bundle_year", "chamber_latin", 10, 6), Injection("solo_cjk", "chamber_cjk", 6, 2),
    ),
    year=_s(
        "profile_zh[:2]", "profile[:3]", "profile_latin[:3]", "profile_mixed[:2]", "zh[:3]", "primary_only[:3]", "year_anchor[:1]", "bilingual[:3]", "bilingual_alias[:2]", "alias[:2]", "decade[:2]", "work_rescue[:2]", "solo_opus[:2]",
    ),
    exact=_s("latin[:20]", "profile_latin[:20]", "profile[:20]"),
)
OTHER = Plan(
    cjk=False,
    first=_s("chamber_latin[:7]", "named_surname[:3]", "chamber_latin[6:8]", "surname_pair[:3]", "primary_only[:4]", "alias[:1]", "profile[:2]", "profile_latin[:2]"),
    sorted=_s("chamber_latin[:7]", "named_surname[:3]", "chamber_latin[6:8]", "surname_pair[:3]", "primary_only[:4]", "alias[:4]", "latin[:4]"),
)


def hinted(q: Column, plain: Column, catalogue: Column, mentions: Column, spared: Column) -> Column:
    """q (trimmed, and plain) with the catalogue's mark at its end, where it asks for the item's work without it: holds one of `mentions`; unless spared."""
    c = trimmed(catalogue)
    names_work = F.exists(F.coalesce(mentions, names.none()), lambda m: F.contains(plain, m))
    return F.when((q == "") | (c == "") | F.contains(plain, matching.plain(c)) | spared | ~names_work, q).otherwise(F.concat(q, F.lit(" "), c))


def plain_slots(slots: Column) -> Column:
    """Each slot's names (the names of one lead) as plain texts, without blank ones."""
    return F.transform(F.coalesce(slots, F.array().cast("array<array<string>>")), lambda s: F.filter(F.transform(s, matching.plain), lambda v: v != ""))


def slot_hits(plain: Column, slots: Column) -> Column:
    """In how many of plain_slots a name stands in the text."""
    return F.size(F.filter(slots, lambda s: F.exists(s, lambda v: F.contains(plain, v))))


def _turn(slices: tuple[tuple[str, int, int], ...]) -> Column:
    """The number of the first slice that holds a row; null without one. The slices are a short literal."""
    return F.coalesce(*(F.when((F.col("generator") == g) & (F.col("position") >= a) & (F.col("position") < b), i) for i, (g, a, b) in enumerate(slices)), F.lit(None).cast("int"))


_FLAGS = ("work_rescue", "year_anchor", "exact_collaboration")


def planned(rows: DataFrame, items: DataFrame, plan: Plan, item: str = "item") -> DataFrame:
    """item, ordinal (from 1), query.

    rows: item, generator, position, query, anchors (marks that injections ask for). items, one row each: item, catalogue, work, composer (texts that a
    better query holds), slots (names of each lead), joint_first (queries that name two leads come first), mentions (plain texts of which one says that
    the item's work is asked for), spare_bundles (queries for bundles of works get no mark), dated (the item has a year: no exact collaboration
    is put in). Null texts are ''; items without rows have no queries.

    One pass: rows are dealt by item once, each text of an item is described once as it is and once with its mark, however many generators have it, and
    places are told by numbering rows."""
    wanted = {c: F.lower(trimmed(F.col(c))) for c in ("work", "composer")} | {"slots": plain_slots(F.col("slots")), "mark": F.lower(trimmed(F.col("catalogue")))}
    at = F.struct("generator", "position", F.coalesce("anchors", names.none()).alias("anchors"))
    texts = shared.spread(rows.select(item, "generator", "position", "query", "anchors"), item, rows=None).groupBy(item, "query").agg(F.collect_list(at).alias("at"))
    dealt = texts.join(items.withColumns(wanted), item)
    facts = queries.classified(queries.described(dealt)).filter("q_length > 0").withColumn("q_plain", matching.plain(F.col("q_text")))
    low = F.col("q_lower")
    has = lambda c: F.when((F.col(c) != "") & F.contains(low, F.col(c)), 0).otherwise(1)
    pair_first = F.coalesce("joint_first", F.lit(False)) & (slot_hits(F.col("q_plain"), F.col("slots")) >= 2)
    fit = F.struct(F.when(pair_first, 0).otherwise(1).alias("pair"), F.when(F.col("q_cjk") == plan.cjk, 0).otherwise(1).alias("script"), has("mark").alias("cat"), has("work").alias("work"), has("composer").alias("composer"), F.col("q_length").alias("length"))
    entry = F.struct(F.col("q_text").alias("text"), *(F.col(c) for c in _FLAGS), F.col("q_collaboration").alias("joint"))
    spared = F.coalesce("spare_bundles", F.lit(False)) & F.col("bundle_rescue")
    once_told = facts.select(
        item, "at", F.col("q_lower").alias("lower"), fit.alias("fit"), F.col("q_cjk").alias("cjk"), F.col("q_length").alias("length"), entry.alias("raw"),
        hinted(F.col("q_text"), F.col("q_plain"), F.col("catalogue"), F.col("mentions"), spared).alias("query"), F.coalesce("dated", F.lit(False)).alias("dated"),
    )
    told = queries.classified(queries.described(once_told)).select(*once_told.columns, entry.alias("hinted"), F.lower("query").alias("_k"))
    each = told.withColumn("at", F.explode("at")).select("*", "at.generator", "at.position", "at.anchors", F.array_contains("at.anchors", "named_duo").alias("duo")).drop("at")
    marked = each.withColumns({c: F.col(c).withField("duo", F.col("duo")) for c in ("raw", "hinted")})
    zero = F.struct(*(F.lit(0).alias(n) for n in ("pair", "script", "cat", "work", "composer", "length")))
    place = lambda late, fit, turn: F.when(turn.isNotNull(), F.struct(F.lit(late).alias("late"), fit.alias("fit"), turn.alias("turn"), F.col("position").alias("position")))
    # each text of the sorted part once, at its first place; then each query once
    turn = F.row_number().over(Window.partitionBy(item, "lower").orderBy(F.asc_nulls_last("_turn"), "position"))
    sorted_ = marked.withColumn("_turn", _turn(plan.sorted)).withColumn("_late", F.when(turn == 1, place(1, F.col("fit"), F.col("_turn"))))
    lined = sorted_.withColumn("_place", F.coalesce(place(0, zero, _turn(plan.first)), "_late"))
    first = F.row_number().over(Window.partitionBy(item, "_k").orderBy(F.asc_nulls_last("_place")))
    numbered = lined.withColumn("_line", F.when((first == 1) & F.col("_place").isNotNull(), F.struct(F.col("_place").alias("place"), F.col("hinted").alias("e"))))
    wanted = _candidates(plan, place, zero)
    finals = numbered.groupBy(item).agg(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["e"]).alias("chosen"), *wanted).filter(F.size("chosen") > 0)
    for k, i in enumerate(plan.injections):
        finals = _injected(finals, F.col(f"_i{k}"), i)
    if plan.year:
        finals = _replaced(finals, F.col("_year"), F.lit(True), lambda e: ~e["work_rescue"] & ~e["joint"] & ~e["duo"], plan.most)
    if plan.exact:
        finals = _replaced(finals, F.col("_exact"), ~F.coalesce("_dated", F.lit(False)), lambda e: ~e["work_rescue"] & ~e["year_anchor"] & ~e["exact_collaboration"] & ~e["joint"] & ~e["duo"], plan.most)
    out = finals.select(item, F.transform(F.slice("chosen", 1, plan.most), lambda e: e["text"]).alias("_q")).select(item, F.posexplode_outer("_q").alias("ordinal", "query"))
    return out.filter(F.col("query").isNotNull()).withColumn("ordinal", F.col("ordinal") + 1)


def _candidates(plan: Plan, place, zero: Column) -> list[Column]:
    """An aggregate for each injection (_i0, ...), _year, _exact and _dated: entries that may be put in."""
    if not plan.injections:
        return []
    raw = F.col("raw")
    marked = lambda i: (F.col("generator") == i.generator) & F.array_contains("anchors", i.mark)
    out = [F.min_by(F.when(marked(i), raw), F.when(marked(i), F.col("position"))).alias(f"_i{k}") for k, i in enumerate(plan.injections)] + [F.bool_or("dated").alias("_dated")]
    late = F.col("_late").isNotNull()
    if plan.year:
        level = F.when(F.col("generator") == "year_anchor", 0).when(late | _turn(plan.year).isNotNull(), 1)
        out.append(F.min_by(raw, F.when(raw["year_anchor"] & level.isNotNull(), F.struct(level, (~F.col("cjk")).cast("int"), F.col("length"), raw["text"]))).alias("_year"))
    if plan.exact:
        out.append(F.min_by(raw, F.when(raw["exact_collaboration"], F.coalesce(place(0, zero, _turn(plan.exact)), "_late"))).alias("_exact"))
    return out


def _injected(df: DataFrame, wanted: Column, i: Injection) -> DataFrame:
    there = F.exists(F.slice("chosen", 1, i.window), lambda e: e["text"] == wanted["text"])
    rest = F.filter("chosen", lambda e: e["text"] != wanted["text"])
    moved = F.concat(F.slice(rest, 1, i.slot), F.array(wanted), F.slice(rest, i.slot + 1, F.size(rest) + 1)) if i.slot else F.concat(F.array(wanted), rest)
    return df.withColumn("chosen", F.when(wanted.isNull() | there, F.col("chosen")).otherwise(moved))


def _replaced(df: DataFrame, wanted: Column, when: Column, gives_way, most: int) -> DataFrame:
    """The wanted entry instead of the last of the first `most` that gives way, else of the last of them; at the end where there is room."""
    there = F.exists(F.slice("chosen", 1, most), lambda e: e["text"] == wanted["text"])
    out = df.withColumn("_slot", F.when(wanted.isNull() | ~when | there, -1).when(F.size("chosen") < most, F.size("chosen")).otherwise(
        F.coalesce(F.array_max(F.filter(F.transform(F.slice("chosen", 1, most), lambda e, k: F.when(gives_way(e), k)), lambda k: k.isNotNull())), F.lit(most - 1))
    ))
    put = F.transform(F.concat("chosen", F.slice(F.array(wanted), 1, (F.col("_slot") == F.size("chosen")).cast("int"))), lambda e, k: F.when(k == F.col("_slot"), wanted).otherwise(e))
    once = F.filter("_put", lambda e, k: F.array_position(F.transform("_put", lambda x: F.lower(x["text"])), F.lower(e["text"])) == k + 1)
    out = out.withColumn("_put", put).withColumn("chosen", F.when(F.col("_slot") < 0, F.col("chosen")).otherwise(once))
    return out.drop("_slot", "_put")
