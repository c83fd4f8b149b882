"""Dates, life spans and Chinese numerals in prose as column expressions. Texts are taken as trimmed; null gives what '' gives."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = list(calendar.month_name)[1:]
_NAMES = "|".join(sorted({n for m in _MONTHS for n in (m, m[:3])} | {"Sept"}, key=len, reverse=True))
_YEAR = r"((?:19|20)[0-9]{2})"
#: The forms that a date may take.
CJK_DATE = _YEAR + r"\s*年\s*(1[0-2]|0?[1-9])\s*月(?:\s*(3[01]|[12]?[0-9])\s*日)?"
ENGLISH_DATE = rf"(?iU)\b({_NAMES})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+{_YEAR}\b"
ENGLISH_MONTH = rf"(?iU)\b({_NAMES})\.?\s*,?\s+{_YEAR}\b"
MONTH_DAYS = [
    r"(?:1[789]|20)[0-9]{2}\s*[./-]\s*([0-9]{1,2})\s*[./-]\s*([0-9]{1,2})",
    r"(?:1[789]|20)[0-9]{2}\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日?",
]
#: The forms of a life span at the head of a text; the first is looked for in its first round brackets.
_LIFE = r"(1[6-9][0-9]{2}|20[0-9]{2})"
IN_BRACKETS = rf"(?:^|[，,]\s*){_LIFE}[^()]{{0,48}}?-{_LIFE}"
AT_HEAD = [
    rf"^{_LIFE}年[^。！？!?;]{{0,48}}?-{_LIFE}年?",
    rf"^{_LIFE}\b[^.();]{{0,24}}?-\s*\b{_LIFE}\b",
    rf"^{_LIFE}年[^。！？!?;]{{0,48}}?{_LIFE}年[^。！？!?;]{{0,16}}(?:卒于|逝世|去世|病逝|去世于)",
    rf"(?i)^{_LIFE}[^.?!;]{{0,48}}?{_LIFE}[^.?!;]{{0,16}}(?:died|passed away)",
]


def _month(by: Column) -> Column:
    """A month's full name by its number or by its first three letters."""
    keys = [x for i, m in enumerate(_MONTHS, 1) for x in (F.lit(str(i)), F.lit(m), F.lit(m[:3].lower()), F.lit(m))]
    return F.try_element_at(F.create_map(*keys), by)


def performance_date(c: Column) -> Column:
    """'Month D, YYYY' or 'Month, YYYY' of the first date found, Chinese before English, whole before partial; else a year, else ''."""
    get = lambda p, i: F.regexp_extract(c, p, i)
    whole = lambda m, d, y: F.concat(m, F.lit(" "), d.cast("int").cast("string"), F.lit(", "), y)
    cjk = _month(get(CJK_DATE, 2).try_cast("int").cast("string"))
    english = lambda p: _month(F.lower(F.substring(get(p, 1), 1, 3)))
    out = (
        F.when(c.rlike(CJK_DATE) & (get(CJK_DATE, 3) != ""), whole(cjk, get(CJK_DATE, 3).try_cast("int"), get(CJK_DATE, 1)))
        .when(c.rlike(CJK_DATE), F.concat(cjk, F.lit(", "), get(CJK_DATE, 1)))
        .when(c.rlike(ENGLISH_DATE), whole(english(ENGLISH_DATE), get(ENGLISH_DATE, 2).try_cast("int"), get(ENGLISH_DATE, 3)))
        .when(c.rlike(ENGLISH_MONTH), F.concat(english(ENGLISH_MONTH), F.lit(", "), get(ENGLISH_MONTH, 2)))
        .otherwise(get(_YEAR, 1))
    )
    return F.coalesce(out, F.lit(""))


def month_days(c: Column) -> Column:
    """The distinct 'MM-DD' of all dates that name a year, sorted."""
    found = []
    for p in MONTH_DAYS:
        two = lambda i, p=p: F.transform(F.regexp_extract_all(c, F.lit(p), i), lambda x: F.lpad(x, 2, "0"))
        found.append(F.coalesce(F.zip_with(two(1), two(2), lambda m, d: F.concat(m, F.lit("-"), d)), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def chinese_number(c: Column) -> Column:
    """The number below 1,000 that Chinese digits and the units ten and hundred write; other characters count for nothing."""
    marks = F.split(F.translate(F.regexp_replace(c, "[^零一二两三四五六七八九十百]", ""), "零一二两三四五六七八九", "01223456789"), "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("held"))

    def step(a: Column, x: Column) -> Column:
        unit = F.when(x == "十", 10).when(x == "百", 100)
        added = F.when(a["held"] == 0, unit).otherwise(a["held"] * unit)
        return F.struct(
            (a["total"] + F.coalesce(added, F.lit(0))).alias("total"),
            F.when(unit.isNotNull(), 0).otherwise(F.coalesce(x.try_cast("int"), a["held"])).alias("held"),
        )

    return F.coalesce(F.aggregate(marks, start, step, lambda a: a["total"] + a["held"]), F.lit(0))


def life_span(c: Column) -> Column:
    """struct(birth, death) from the brackets near the head of a text or from its first sentence; null where there is none."""
    c = F.trim(F.translate(F.regexp_replace(c, r"(?U)\s+", " "), "—–－（）", "---()"))
    bracket = F.regexp_extract(F.substring(c, 1, 120), r"\(([^()]*)\)", 1)
    head = F.regexp_extract(c, r"^[^。！？!?;]*", 0)
    tries = [(bracket, IN_BRACKETS), *((head, p) for p in AT_HEAD)]
    year = lambda s, p, i: F.regexp_extract(s, p, i).try_cast("int")
    return F.coalesce(*(F.when(s.rlike(p), F.struct(year(s, p, 1).alias("birth"), year(s, p, 2).alias("death"))) for s, p in tries))
