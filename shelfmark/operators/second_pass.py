"""Which items are searched a second time, for what, and what both passes give together. All items at once: signals of the first pass
are aggregates by item, and the second pass reads only the rows of items that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import matching, queries

# Words that name no person, and marks of works.
STOP = ("beethoven", "spring", "appassionata", "sonata", "sonatas", "violin", "piano", "ludwig", "van", "no", "op", "major", "minor", "complete", "collection")
CJK_STOP = ("热情", "春天", "奏鸣曲", "钢琴", "小提琴", "贝多芬", "路德维希", "第二十三", "第五", "op")
CJK_STOP_WHOLE = ("贝多芬", "路德维希", "凡贝多芬")
CHAMBER = ("spring", "appassionata", "sonata", "春天", "热情", "奏鸣曲")
NAMED = ("appassionata", "spring", "热情", "春天")
NAMED_WORKS = ("appassionata", "spring", "op57", "op.57", "op 57", "op24", "op.24", "op 24", "热情", "春天")
PROBED = ("sonatas", "quartets", "trios", "sonata collection", "quartet collection", "trio collection")
BUNDLES = ("sonata", "奏鸣曲", "quartet", "四重奏", "trio", "三重奏")
OPUS = r"(?iU)\bop\.?\s*(?:24|57)\b"


def is_opus_probe() -> Column:
    """Of described rows: asks for one of the two named works, or their opus."""
    return ~F.col("q_slash") & (queries.any_of(F.col("q_lower"), NAMED) | F.col("q_lower").rlike(OPUS) | queries.any_of(F.col("q_lower"), ("op24", "op57")))


def _said(counts: str, n: Column, keep: Column, most: int) -> Column:
    """Of counted tokens those that are kept, `most` at most: by count, then length, then text."""
    order = F.struct((-n).alias("n"), (-F.length("token")).alias("l"), F.col("token").alias("t"))
    return F.transform(F.slice(F.array_sort(F.collect_list(F.when(keep, order))), 1, most), lambda v: v["t"]).alias(counts)


def wanted(facts: DataFrame, item: str) -> DataFrame:
    """item, chamber, joint, opus (what its queries ask for), duo_tokens: up to four Latin words that at least two of its queries' words are,
    solo_tokens: up to three: Latin words seen twice, or Chinese ones of three and more characters, which may be seen once.

    Facts are read once: a row for each word, counted by item and word, then by item."""
    latin = F.filter(F.regexp_extract_all("q_lower", F.lit("[A-Za-z]{3,}"), 0), lambda x: ~x.isin(*STOP))
    chunks = F.transform(F.regexp_extract_all("q_text", F.lit("[一-鿿·]{2,}"), 0), lambda x: F.replace(x, F.lit("·"), F.lit("")))
    segments = F.filter(F.split("q_text", r"(?U)[·•・／/|,，、\s]+"), lambda x: x != "")
    last = F.when(F.col("q_cjk"), F.slice(segments, -1, 1)).otherwise(F.array().cast("array<string>"))
    names = F.filter(F.concat(chunks, last), lambda x: (F.length(x) >= 3) & ~x.isin(*CJK_STOP_WHOLE) & ~queries.any_of(x, CJK_STOP))
    marked = lambda xs, of_latin: F.transform(xs, lambda x: F.struct(x.alias("token"), F.lit(of_latin).alias("latin")))
    flags = {"chamber": queries.any_of(F.col("q_lower"), CHAMBER), "joint": F.col("q_collaboration"), "opus": is_opus_probe()}
    ever = [F.bool_or(k).alias(k) for k in flags]
    words = facts.select(item, *(c.alias(k) for k, c in flags.items()), F.explode_outer(F.concat(marked(latin, 1), marked(names, 0))).alias("x"))
    counted = words.groupBy(item, F.col("x.token").alias("token")).agg(*ever, F.sum("x.latin").alias("latin"), F.count("x.token").alias("n"))
    n, of_latin = F.col("n"), F.col("latin")
    return counted.groupBy(item).agg(*ever, _said("duo_tokens", of_latin, of_latin >= 2, 4), _said("solo_tokens", n, (n >= 2) | F.col("token").rlike("[一-鿿]"), 3))


def triggers(asked: DataFrame, first: DataFrame, item: str = "item", query: str = "query", text: str = "text") -> DataFrame:
    """item, duo_tokens, solo_tokens, duo, solo: whether the first pass (item, text: a row's title and notes) lacks what the queries look for.

    duo: a chamber work and several people are asked for, and no row names two of them. solo: a named work is asked for, and no row holds
    it with one of the people. Items without rows count as lacking."""
    known = wanted(queries.described(asked, query).filter("q_length > 0"), item)
    seen = first.select(item, matching.plain(F.col(text)).alias("_hay"))
    held = lambda tokens: F.size(F.filter(tokens, lambda x: F.contains("_hay", x)))
    two, one = held("duo_tokens") >= 2, (held("solo_tokens") >= 1) & queries.any_of(F.col("_hay"), NAMED_WORKS)
    out = known.join(seen, item, "left").groupBy(*known.columns).agg(F.bool_or(two).alias("_two"), F.bool_or(one).alias("_one"))
    duo = F.col("chamber") & F.col("joint") & (F.size("duo_tokens") >= 2) & ~F.coalesce("_two", F.lit(False))
    solo = F.col("opus") & (F.size("solo_tokens") >= 1) & ~F.coalesce("_one", F.lit(False))
    return out.select(item, "duo_tokens", "solo_tokens", duo.alias("duo"), solo.alias("solo"))


def probes(asked: DataFrame, triggered: DataFrame, item: str = "item", position: str = "position", query: str = "query", most: int = 6) -> DataFrame:
    """item, ordinal (from 1), query: what items with a trigger are asked again: trailers of the complete works that their queries name (duo), the two best
    queries for the named work (solo), then their other queries in order; each once, `most` at most."""
    again = queries.once(asked, item, position, query).join(triggered.filter("duo OR solo").select(item, "duo", "solo"), item)
    facts = queries.classified(queries.described(again, query))
    text = F.col("q_text")
    trailer = ~F.col("q_cjk") & ~F.col("q_slash") & ~F.contains("q_lower", F.lit("trailer")) & F.contains("q_lower", F.lit("complete")) & queries.any_of(F.col("q_lower"), PROBED) & F.col("q_collaboration")
    bare = F.trim(F.regexp_replace(text, queries.YEAR, ""))
    at = F.locate("complete ", F.lower(bare))
    focused = F.trim(F.regexp_replace(F.when(at > 0, F.substring(bare, at, F.length(bare))).otherwise(bare), r"\s+", " "))
    opus = F.struct(F.col("q_cjk").cast("int"), (~text.rlike(OPUS)).cast("int"), "r_focus", "q_length", F.col(position).alias("at"))
    one = lambda stage, order, c, keep: F.when(keep, F.struct(F.lit(stage).alias("stage"), order.alias("order"), c.alias("query")))
    best = F.slice(F.array_sort(F.collect_list(F.when(is_opus_probe() & F.col("solo"), F.struct(opus.alias("o"), text.alias("query"))))), 1, 2)
    rest = F.collect_list(F.struct(F.lit(2).alias("stage"), F.col(position).cast("long").alias("order"), text.alias("query")))
    trailers = F.collect_list(one(0, F.col(position).cast("long"), F.concat(focused, F.lit(" trailer")), trailer & F.col("duo")))
    per = facts.groupBy(item).agg(trailers.alias("_t"), best.alias("_s"), rest.alias("_r"))
    solo = F.transform("_s", lambda x, i: F.struct(F.lit(1).alias("stage"), i.cast("long").alias("order"), x["query"].alias("query")))
    ordered = F.transform(F.array_sort(F.concat("_t", solo, "_r")), lambda x: x["query"])
    once = F.filter(ordered, lambda x, i: F.array_position(F.transform(ordered, F.lower), F.lower(x)) == i + 1)
    rows = per.select(item, F.slice(once, 1, most).alias("_q")).select(item, F.posexplode_outer("_q").alias("ordinal", "query"))
    return rows.filter(F.col("query").isNotNull()).withColumn("ordinal", F.col("ordinal") + 1)


def both_passes(first: DataFrame, more: DataFrame, triggered: DataFrame, asked: DataFrame, item: str = "item", url: str = "url", text: str = "text") -> DataFrame:
    """item, url, text, pass (1 or 2), promoted: the first pass's rows, and those of `more` for items with a trigger that hold every word of one of
    their probes, each address once, the first pass's where both have it. Promoted: the one row of a triggered item that names two people and a
    complete set of works; titles that say complete, then shorter ones, then the address decide.

    `more` is read for triggered items only: what it is joined with has no other items."""
    words = F.filter(F.split(matching.plain(F.col("query")), r"[^a-z0-9一-鿿]+"), lambda x: (F.length(x) >= 2) | x.rlike("^[0-9]+$"))
    wanted = asked.select(item, words.alias("_words")).filter(F.size("_words") > 0).groupBy(item).agg(F.collect_set("_words").alias("_probes"))
    hay = matching.plain(F.col(text))
    again = more.join(wanted, item).withColumn("_hay", hay).filter(F.exists("_probes", lambda p: F.forall(p, lambda w: F.contains("_hay", w))))
    every = first.select(item, url, text, F.lit(1).alias("pass")).unionByName(again.select(item, url, text, F.lit(2).alias("pass")))
    once = every.groupBy(item, url).agg(F.min(F.struct("pass", text)).alias("x")).select(item, url, f"x.{text}", "x.pass")
    known = once.join(triggered.filter("duo OR solo").select(item, F.col("duo_tokens").alias("_tokens"), F.lit(True).alias("_again")), item, "left")
    two = F.size(F.filter(F.coalesce("_tokens", F.array().cast("array<string>")), lambda x: F.contains(hay, x))) >= 2
    bundle = F.coalesce("_again", F.lit(False)) & (F.size("_tokens") >= 2) & queries.any_of(hay, ("complete", "全集")) & queries.any_of(hay, BUNDLES) & two
    order = F.struct((~F.contains(hay, F.lit("complete"))).cast("int"), F.length(F.trim(text)), F.col(url))
    marked = known.withColumn("_order", F.when(bundle, order))
    best = marked.filter("_order IS NOT NULL").groupBy(item).agg(F.min("_order").alias("_best"))
    return marked.join(best, item, "left").select(item, url, text, "pass", F.coalesce(F.col("_order") == F.col("_best"), F.lit(False)).alias("promoted"))
