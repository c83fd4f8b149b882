"""Scalar functions as column expressions; Unicode forms alone go through Arrow."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


# The Unicode blanks, and a byte order mark.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """'' for null; any Unicode blank and a byte order mark go from both ends."""
    return F.coalesce(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def lookup_key(c: Column) -> Column:
    """Letters and digits alone, without accents, in lower case."""
    return F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def years(c: Column) -> Column:
    """Four-digit years of 1600 to 2099, distinct, in order of sight."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b((?:16|17|18|19|20)[0-9]{2})\b"), 1))


def decade(year: Column) -> Column:
    return F.when(year.isNotNull() & (year != 0), (F.floor(year / 10) * 10).cast("bigint"))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Lower-case host without www., path without a closing slash; scheme, query and fragment go."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.concat(host_of(url), path)


def platform(url: Column, patterns: list[tuple[str, str]]) -> Column:
    """The first pattern's name that the host matches, else 'other'."""
    out = F.lit("other")
    for pattern, name in reversed(patterns):
        out = F.when(host_of(url).rlike(pattern), name).otherwise(out)
    return out


def strip_html(c: Column) -> Column:
    """Text without script, style and tags; entities stay (see unescape)."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def title_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def excerpt(c: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def seconds_of(clock: Column) -> Column:
    """h:mm:ss or m:ss as seconds; null where it is neither."""
    parts = F.transform(F.split(clock, ":"), lambda x: x.try_cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 60 + x)
    return F.when(clock.rlike(r"^[0-9]+(:[0-5]?[0-9]){1,2}$"), total)


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over code points."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda a, x: (a.bitwiseXOR(x) * 16777619).bitwiseAND(4294967295))


def acronym(c: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.filter(F.split(c, r"[\s-]+"), lambda t: t.rlike(r"^\p{L}")), lambda t: F.substring(t, 1, 1)), ""))


def contains_tokens(pool: Column, tokens: Column) -> Column:
    return F.forall(tokens, lambda t: F.contains(pool, t))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def half_even(c: Column, places: int) -> Column:
    """Rounded by the number's binary value, halves to the even digit: 2.675 is below its half and gives 2.67."""
    return F.regexp_replace(F.format_number(c, places), ",", "").cast("double")
