"""What a search query is: facts about its text, the classes it belongs to, and the orders within a class; all as columns of its row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import trimmed

# Marks of works, ensembles and months in queries.
WORKS = ("concerto", "concertos", "klavierkonzert", "钢协", "协奏曲")
ENSEMBLES = ("orchestra", "philharmonic", "symphony", "ensemble", "乐团", "爱乐", "交响")
LATIN_ENSEMBLES = ("orchestra", "philharmonic", "symphony", "ensemble")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CHAMBER = ("奏鸣曲", "三重奏", "四重奏", "春天", "热情", "sonata", "trio", "quartet", "spring", "appassionata")
BUNDLES = ("violin sonatas", "piano sonatas", "sonatas", "violin sonata collection", "piano sonata collection", "sonata collection", "quartets", "quartet collection", "trios", "trio collection")
NICKNAMES = ("appassionata", "spring")
NOT_CHAMBER = ("concerto", "symphony", "quartet", "trio")
SOLO_WORKS = ("钢琴奏鸣曲", "小提琴奏鸣曲", "op57", "op.57", "op24", "op.24")
NOT_ORCHESTRAL = ("concerto", "concertos", "klavierkonzert", "sonata", "quartet", "trio", "钢协", "协奏曲", "奏鸣曲", "四重奏", "三重奏", "海顿", "布鲁克纳", "贝多芬", "舒伯特", "舒曼")
COMMON_NAMES = ("piano", "concerto", "concertos", "op", "robert", "schumann", "orchestra", "philharmonic", "symphony", "ensemble", "budapest", "bppo")
YEAR, DECADE = r"(?U)\b(?:18|19|20)\d{2}\b", r"(?U)\b(?:18|19|20)\d0s\b"

#: Classes, in the order in which a choice of queries looks after them.
CLASSES = (
    "work_rescue", "year_anchor", "bundle_rescue", "year_collaboration", "exact_collaboration", "compact_duo", "duo_bundle", "nickname_surname", "nickname_year", "solo_cjk", "orchestral_context",
)


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks))


def _first(*cases: Column) -> Column:
    """The number, from 0, of the first case that holds; how many there are if none does."""
    out = F.lit(len(cases))
    for i in reversed(range(len(cases))):
        out = F.when(cases[i], i).otherwise(out)
    return out


def once(rows: DataFrame, item: str, position: str, query: str) -> DataFrame:
    """item, position, query: each item's trimmed queries, blank ones and repeats (whatever their case) left out, the first of each by position.
    Repeats are combined before the shuffle, and before anything is worked out for them."""
    texts = rows.select(item, position, trimmed(F.col(query)).alias(query)).filter(F.col(query) != "")
    first = texts.groupBy(item, F.lower(query).alias("_low")).agg(F.min_by(F.struct(position, query), position).alias("_x"))
    return first.select(item, "_x.*")


def described(rows: DataFrame, query: str = "query") -> DataFrame:
    """rows with facts about a query in columns of q_: the trimmed text, counts of tokens, words and names, marks of year, decade, month,
    work and ensemble. Null queries are ''."""
    text, low = F.col("q_text"), F.col("q_lower")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    named = rows.withColumn("q_text", trimmed(F.col(query))).withColumn("q_lower", F.lower("q_text"))
    facts = named.withColumns({
        "q_tokens": count(r"[A-Za-z0-9]+|[一-鿿]+"), "q_chunks": count(r"[一-鿿]+"), "q_words": count(r"(?U)\S+"), "q_digits": count(r"(?U)\d"), "q_long_latin": count(r"[A-Za-z]{3,}"),
        "q_names": F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'.-]*"), 0), lambda x: F.length(x) > 1), "q_length": F.length(text),
        "q_cjk": text.rlike(r"[一-鿿]"), "q_slash": F.contains(text, F.lit("/")), "q_dash": F.contains(text, F.lit(" - ")), "q_year": low.rlike(YEAR), "q_decade": low.rlike(DECADE),
        "q_month": any_of(low, MONTHS), "q_work": any_of(low, WORKS), "q_cjk_work": any_of(text, ("钢协", "协奏曲")), "q_ensemble": any_of(low, ENSEMBLES),
    })
    return facts.withColumn("q_collaboration", F.col("q_slash") | (F.size("q_names") >= 3))


def classified(facts: DataFrame) -> DataFrame:
    """described rows with a flag for each of CLASSES, and r_: structs that order queries, the smallest first."""
    c = F.col
    text, low = c("q_text"), c("q_lower")
    said, latin_only = c("q_length") > 0, ~c("q_cjk") & ~c("q_slash")
    names, rare = F.size("q_names"), F.size(F.filter("q_names", lambda x: ~F.lower(x).isin(*COMMON_NAMES)))
    joint = c("q_slash") | c("q_dash")
    bare_year = F.regexp_replace(low, YEAR, "")
    flags = {
        "work_rescue": c("q_work") & ~joint & ~c("q_ensemble") & (c("q_decade") | (c("q_year") & ((c("q_tokens") <= 4) | c("q_cjk_work")))),
        "year_anchor": c("q_year") & ~c("q_decade") & ~c("q_month") & ~c("q_work") & ~c("q_slash") & (c("q_tokens") <= 4),
        "bundle_rescue": F.contains(low, F.lit("concertos")) & ~joint & ~c("q_ensemble") & (c("q_tokens") <= 4),
        "year_collaboration": c("q_collaboration") & c("q_year") & ~c("q_month") & c("q_work"),
        "exact_collaboration": c("q_collaboration") & c("q_work") & ~c("q_year") & ~c("q_decade") & ~c("q_month") & (c("q_tokens") <= 12) & (rare >= 4),
        "compact_duo": c("q_cjk") & ~c("q_slash") & (c("q_digits") == 0) & names.between(2, 3) & ~any_of(low, LATIN_ENSEMBLES) & any_of(low, CHAMBER),
        "duo_bundle": said & latin_only & any_of(low, BUNDLES) & ~bare_year.rlike(r"(?U)\d") & (names >= 4),
        "nickname_surname": latin_only & any_of(low, NICKNAMES) & F.contains(low, F.lit("beethoven")) & ~any_of(low, NOT_CHAMBER) & names.between(3, 4),
        "nickname_year": latin_only & any_of(low, NICKNAMES) & c("q_year") & ~any_of(low, (*NOT_CHAMBER, "collection", "complete")) & names.between(3, 5),
        "solo_cjk": c("q_cjk") & ~c("q_slash") & any_of(text, SOLO_WORKS) & ~any_of(low, NOT_CHAMBER) & (c("q_tokens") >= 2),
        "orchestral_context": ~c("q_slash") & c("q_year") & ~any_of(low, NOT_ORCHESTRAL) & ~c("q_month") & c("q_tokens").between(4, 10) & (c("q_chunks") >= 2),
    }
    no = lambda b: F.when(b, 0).otherwise(1)  # noqa: E731  what has it comes first
    has = lambda b: F.when(b, 1).otherwise(0)  # noqa: E731  what has it comes last
    focus = F.struct(_first(c("q_cjk_work") & (c("q_long_latin") > 0), c("q_work")), no(c("q_long_latin") >= 2), no(c("q_digits") > 0), has(c("q_ensemble")), c("q_words"), c("q_length"))
    complete, hyphened = F.contains(low, F.lit("complete")), text.rlike(r"(?U)\b[A-Za-z]+-[A-Za-z]+\b")
    acronyms = F.exists("q_names", lambda x: ~x.rlike("[a-z]") & (F.length(x) <= 3))
    long_names = F.size(F.filter("q_names", lambda x: (F.length(x) > 2) & x.rlike("[a-z]")))
    trailer = F.contains(low, F.lit("trailer"))
    orders = {
        "r_focus": focus,
        "r_runtime": F.struct(
            _first(c("q_year") & c("q_collaboration"), c("q_year"), c("q_decade")), has((c("q_length") > 56) | (c("q_tokens") > 10)), has((c("q_length") > 40) | (c("q_tokens") > 7)),
            has(c("q_month") | (c("q_year") & (c("q_length") > 32))), has(c("q_slash")), focus, c("q_length"),
        ),
        "r_collaboration": F.struct(no(c("q_digits") > 0), no(names >= 3), no(c("q_slash")), has(c("q_ensemble")), c("q_length")),
        "r_context": F.struct(has(c("q_ensemble")), no(c("q_slash")), c("q_digits"), c("q_words"), c("q_length")),
        "r_work_rescue": F.struct(_first(c("q_cjk_work") & c("q_year"), c("q_decade"), c("q_year")), c("q_tokens"), c("q_length"), has(c("q_slash"))),
        "r_year_anchor": F.struct(no(c("q_cjk")), c("q_words"), c("q_length"), text),
        "r_bundle_rescue": F.struct(no(F.contains(low, F.lit("piano concertos"))), c("q_tokens"), c("q_length")),
        "r_year_collaboration": F.struct(has(c("q_slash")), has(acronyms), no(long_names >= 3), c("q_length")),
        "r_exact_collaboration": F.struct(no(F.contains(low, F.lit("op."))), has(c("q_ensemble") | F.contains(low, F.lit("bppo"))), has(c("q_slash")), c("q_tokens"), c("q_length")),
        "r_by_focus": F.struct(focus, c("q_length"), text),
        "r_duo_bundle": F.struct(
            _first(complete & c("q_year") & ~hyphened, complete & trailer, complete & c("q_year"), complete, c("q_year")), has(hyphened), c("q_words"), c("q_length"), focus, text,
        ),
        "r_solo_cjk": F.struct(no(any_of(text, ("钢琴奏鸣曲", "小提琴奏鸣曲"))), no(text.rlike(r"(?iU)op\.?\s*(?:24|57)")), c("q_length")),
        "r_orchestral_context": F.struct(has(text.rlike("[A-Za-z]")), c("q_tokens"), -c("q_chunks"), c("q_length")),
    }
    return facts.withColumns({k: v & said for k, v in flags.items()} | orders)
