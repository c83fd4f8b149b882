"""Lines of pipe-separated slots, as entered by hand: loose separators, a missing last slot, lists of names and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T

#: Slots of a line by kind of work; other kinds have four.
SLOTS = {"concerto": 5, "opera_vocal": 5, "chamber_solo": 4}
MISSING = "-"


def _squeezed(c: Column) -> Column:
    return T.trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def _given(c: Column) -> Column:
    return F.filter(c, lambda x: ~x.isin("", MISSING))


def lines(df: DataFrame, text: str, kind: str) -> DataFrame:
    """A row for each line that is not blank: line (from 0), slots, whether their number is the kind's, title, links.

    Null texts have no lines. A line that lacks just its last slot, the links, gets it as missing."""
    marks = F.regexp_replace(T.nfkc(F.col(text)), "[｜￨│┃┆丨]", "|")
    loose = F.regexp_replace(marks, r"(?U)[^\S\n]+[~～—–－]+[^\S\n]+", " | ")
    rows = F.filter(F.transform(F.split(loose, r"\r?\n"), _squeezed), lambda x: x != "")
    wanted = F.lit(4)
    for name, n in SLOTS.items():
        wanted = F.when(F.col(kind) == name, n).otherwise(wanted)
    out = df.select("*", F.posexplode(rows).alias("line", "_line")).withColumn("_n", wanted)
    slots = F.transform(F.split("_line", r"\|"), _squeezed)
    out = out.withColumn("slots", F.when(F.size(slots) == F.col("_n") - 1, F.concat(slots, F.array(F.lit(MISSING)))).otherwise(slots))
    last = F.try_element_at("slots", F.col("_n"))
    return out.select(
        *df.columns, "line", "slots", (F.size("slots") == F.col("_n")).alias("is_whole"),
        F.array_join(_given(F.slice("slots", 1, F.col("_n") - 1)), " - ").alias("title"),
        F.coalesce(F.array_distinct(_given(F.transform(F.split(last, ","), _squeezed))), F.array().cast("array<string>")).alias("links"),
    )


def names(slot: Column) -> Column:
    """The names that a slot lists with '+', without blanks and placeholders."""
    return F.coalesce(_given(F.transform(F.split(slot, r"\+"), _squeezed)), F.array().cast("array<string>"))
