"""Which of an item's queries to run: successive picks, and a choice that looks after each class. All items at once; what meets in one
row is one item's queries, some dozens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import queries


def pools(rows: DataFrame, item: str = "item", position: str = "position", query: str = "query") -> DataFrame:
    """item, pool: each item's queries by position, blank ones and repeats (whatever their case) left out, with their facts; n counts from 1."""
    facts = queries.classified(queries.described(rows, query)).filter("q_length > 0")
    held = F.struct(F.col(position).alias("_at"), F.col("q_text").alias("text"), F.col("q_collaboration").alias("collaboration"), "q_lower", "q_decade", *queries.CLASSES, *(c for c in facts.columns if c.startswith("r_")))
    # the first of each text in one pass, combined before the shuffle
    once = facts.groupBy(item, "q_lower").agg(F.min_by(held, position).alias("held"))
    ordered = once.groupBy(item).agg(F.array_sort(F.collect_list("held"), lambda a, b: F.when(a["_at"] < b["_at"], -1).otherwise(1)).alias("pool"))
    return ordered.withColumn("pool", numbered(F.col("pool")))


def numbered(pool: Column) -> Column:
    """The pool with n, each entry's place from 1."""
    return F.transform(pool, lambda x, i: x.withField("n", i + 1))


def best(pool: Column, rank, wanted) -> Column:
    """n of the entry of least rank among the wanted, the first of equals; null if there is none."""
    return F.array_min(F.transform(F.filter(pool, wanted), lambda x: F.struct(rank(x).alias("r"), x["n"].alias("n"))))["n"]


def picked(pooled: DataFrame, most: int) -> DataFrame:
    """pooled with `picks`, at most `most` places in ascending order: the first two and the last; of those between, the one of least focus
    rank, then of the rest the best that names several people, then the rest by context, richest first."""
    size = F.size("pool")
    head, tail = min(2, max(most, 0)), 1 if most > 2 else 0
    between = F.filter("pool", lambda x: (x["n"] > head) & (x["n"] <= size - tail))
    room = max(most, 0) - head - tail
    out = pooled.withColumn("_between", between)
    out = out.withColumn("_focused", best(F.col("_between"), lambda x: x["r_focus"], lambda x: F.lit(room > 0)))
    out = out.withColumn("_joint", best(F.col("_between"), lambda x: x["r_collaboration"], lambda x: x["collaboration"] & (x["n"] != F.col("_focused")) & F.lit(room > 1)))
    left = F.filter("_between", lambda x: ~x["n"].eqNullSafe(F.col("_focused")) & ~x["n"].eqNullSafe(F.col("_joint")))
    richest = F.array_sort(left, lambda a, b: F.when(a["r_context"] > b["r_context"], -1).when(a["r_context"] < b["r_context"], 1).otherwise(a["n"] - b["n"]))
    taken = F.filter(F.array(F.col("_focused"), F.col("_joint")), lambda x: x.isNotNull())
    out = out.withColumn("_taken", taken).withColumn("_rest", F.transform(richest, lambda x: x["n"]))
    ends = F.filter(F.transform("pool", lambda x: x["n"]), lambda n: (n <= head) | (n > size - tail))
    chosen = F.array_sort(F.concat(ends, F.col("_taken"), F.slice("_rest", 1, F.greatest(F.lit(room) - F.size("_taken"), F.lit(0)))))
    picks = F.when(size <= most, F.transform("pool", lambda x: x["n"])).otherwise(chosen if most > 0 else F.slice(F.transform("pool", lambda x: x["n"]), 1, 0))
    return out.withColumn("picks", picks).drop("_between", "_focused", "_joint", "_taken", "_rest")


@dataclass(frozen=True)
class Guarantee:
    """A class whose best query takes a slot: the last whose query is in none of the classes of `spared` (the first set of classes that leaves a slot
    counts), else the last slot. `always`: also where another query of the class is chosen already."""

    of: str
    rank: str
    spared: tuple[tuple[str, ...], ...]
    always: bool = False
    least: int = 4


_R, _Y, _B, _E, _C, _D, _N = "work_rescue", "year_anchor", "bundle_rescue", "exact_collaboration", "compact_duo", "duo_bundle", "nickname_surname"
_MOST = (_R, _Y, _B, _E, _C, _D)
#: In this order; "+" before a class asks for it instead.
GUARANTEES = (
    Guarantee(_R, "r_work_rescue", ((),), least=0),
    Guarantee(_Y, "r_year_anchor", ((_R, _B, "joint"),), always=True, least=0),
    Guarantee(_B, "r_bundle_rescue", ((_R, _Y), ("+" + _Y, _R), ("+" + _Y,), (_R,))),
    Guarantee("year_collaboration", "r_year_collaboration", ((_R, _Y, _B),), always=True),
    Guarantee(_E, "r_exact_collaboration", (("collaboration", _R, _Y, _B), ("collaboration", _R, _Y))),
    Guarantee(_C, "r_by_focus", ((_R, _B, _E),)),
    Guarantee(_D, "r_duo_bundle", ((_R, _B, _E, _C),)),
    Guarantee(_N, "r_by_focus", (_MOST,)),
    Guarantee("nickname_year", "r_by_focus", (_MOST,)),
    Guarantee("solo_cjk", "r_solo_cjk", ((*_MOST, _N),)),
    Guarantee("orchestral_context", "r_orchestral_context", (_MOST,)),
)


def guaranteed(df: DataFrame, g: Guarantee) -> DataFrame:
    """df (pool, chosen: places in the pool, joint: the place of the chosen query that names several people best, closed) after one class is looked
    after."""
    entry = lambda n: F.element_at("pool", n)
    out = df.withColumn("_best", best(F.col("pool"), lambda x: x[g.rank], lambda x: x[g.of]))

    def open_to(classes: tuple[str, ...]):
        def fits(n: Column) -> Column:
            keep = F.lit(True)
            for k in classes:
                keep = keep & (n != F.coalesce("joint", F.lit(0)) if k == "joint" else entry(n)[k[1:]] if k[0] == "+" else ~entry(n)[k])
            return keep

        return fits

    def last_open(classes: tuple[str, ...]) -> Column:
        fits = open_to(classes)
        return F.array_max(F.filter(F.transform("chosen", lambda n, i: F.when(fits(n), i)), lambda i: i.isNotNull()))

    taken = F.array_contains("chosen", F.col("_best")) if g.always else F.exists("chosen", lambda n: entry(n)[g.of])
    out = out.withColumn("_slot", F.when(F.col("_best").isNotNull() & ~taken & ~F.col("closed"), F.coalesce(*map(last_open, g.spared), F.size("chosen") - 1)))
    swapped = F.transform("chosen", lambda n, i: F.when(i == F.col("_slot"), F.col("_best")).otherwise(n))
    return out.withColumn("chosen", F.when(F.col("_slot").isNull(), F.col("chosen")).otherwise(swapped)).drop("_best", "_slot")


def prepared(pooled: DataFrame, most: int = 3) -> DataFrame:
    """pooled with `chosen`, at most `most` places of its pool, which is put in a new order: picks first. The first by runtime rank, then the
    guarantees, one after the other. With fewer than four slots a decade's query never drives out a year's, and the choice ends there."""
    seeded = picked(pooled, max(most + 2, 6))
    late = lambda x: (~F.array_contains(F.col("picks"), x["n"])).cast("int")
    order = lambda a, b: F.when(late(a) != late(b), late(a) - late(b)).otherwise(a["n"] - b["n"])
    out = seeded.withColumn("pool", F.array_sort("pool", order)).withColumn("pool", numbered(F.col("pool"))).drop("picks")
    by_runtime = F.array_sort("pool", lambda a, b: F.when(a["r_runtime"] < b["r_runtime"], -1).when(a["r_runtime"] > b["r_runtime"], 1).otherwise(a["n"] - b["n"]))
    out = out.withColumn("chosen", F.slice(F.transform(by_runtime, lambda x: x["n"]), 1, most))
    any_chosen = lambda k: F.exists("chosen", lambda n: F.element_at("pool", n)[k])
    rescue = F.element_at("pool", best(F.col("pool"), lambda x: x["r_work_rescue"], lambda x: x[_R]))
    ends = ~any_chosen(_R) & F.coalesce(rescue["q_decade"], F.lit(False)) & any_chosen(_Y) if most < 4 else F.lit(False)
    out = out.withColumn("closed", ends)
    for g in GUARANTEES:
        if g.least > most:
            continue
        names = F.filter("pool", lambda x: F.array_contains("chosen", x["n"]) & x["collaboration"])
        # of equal ranks the first of those chosen, not of the pool
        by_slot = F.array_min(F.transform(names, lambda x: F.struct(x["r_collaboration"], F.array_position(F.col("chosen"), x["n"]).alias("slot"), x["n"].alias("n"))))["n"]
        out = guaranteed(out.withColumn("joint", by_slot if "joint" in g.spared[0] else F.lit(None).cast("int")), g)
    return out.drop("joint", "closed")


def spelled(df: DataFrame, places: str, item: str = "item") -> DataFrame:
    """item, ordinal (from 1), query: a row for each chosen place."""
    each = df.select(item, F.transform(places, lambda n: F.element_at("pool", n)["text"]).alias("_texts"))
    # outer, then filtered: for a plain explode the optimizer writes a filter of its input and puts it, all steps written out, before them
    rows = each.select(item, F.posexplode_outer("_texts").alias("ordinal", "query"))
    return rows.filter(F.col("query").isNotNull()).withColumn("ordinal", F.col("ordinal") + 1)


def prepared_each(pooled: DataFrame, sizes: tuple[int, ...], item: str = "item") -> DataFrame:
    """item, most, ordinal (from 1), query: what is prepared of each size, of pools that are made once."""
    out = pooled.withColumnRenamed("pool", "_whole")
    for most in sizes:
        out = prepared(out.withColumn("pool", F.col("_whole")), most)
        out = out.withColumn(f"_of{most}", F.transform("chosen", lambda n: F.element_at("pool", n)["text"])).drop("chosen", "pool")
    each = out.select(item, F.explode(F.array(*(F.struct(F.lit(m).alias("most"), F.col(f"_of{m}").alias("texts")) for m in sizes))).alias("x"))
    rows = each.select(item, "x.most", F.posexplode_outer("x.texts").alias("ordinal", "query"))
    return rows.filter(F.col("query").isNotNull()).withColumn("ordinal", F.col("ordinal") + 1)
