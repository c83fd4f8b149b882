"""Other names that a work goes by: without its catalogue mark or key, by form and key, by number, by nickname. All in the form of matching.plain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import chinese_number
from .matching import plain, without_catalogue
from .text import trimmed

# Instruments of concertos, nicknames, what some numbers stand for, forms by their Chinese names.
INSTRUMENTS = [("violin", "小提琴|violin"), ("piano", "钢琴|鋼琴|piano|klavier"), ("cello", "大提琴|cello"), ("flute", "长笛|flute")]
NICKNAMES = [("appassionata|热情", ["appassionata", "热情奏鸣曲"]), ("spring|春天", ["spring", "春天奏鸣曲"])]
NUMBERS = [
    (r"piano sonata no 23|op\.57|op57", ["appassionata", "热情奏鸣曲", "第二十三钢琴奏鸣曲", "第二十三号钢琴奏鸣曲", "热情op57", "热情op.57"]), (r"violin sonata no 5|op\.24|op24", ["spring", "春天奏鸣曲"]),
]
FORMS = {"交响曲": "symphony", "协奏曲": "concerto", "奏鸣曲": "sonata"}
_FORM = "(交响曲|协奏曲|奏鸣曲)"


def without_key(c: Column) -> Column:
    bare = F.regexp_replace(trimmed(c), r"^[A-Ga-g]\s*(?:大调|小调)", "")
    bare = F.regexp_replace(bare, r"(?i)\b(?:in\s+)?[A-Ga-g][#b-]?\s*(?:major|minor|maj|min)\b", "")
    return trimmed(F.regexp_replace(bare, r"^[\s,;:()\-]+|[\s,;:()\-]+$", ""))


def keys(c: Column) -> Column:
    """'c minor' and 'c-minor' of the keys that a title names, in English or Chinese."""
    latin, chinese = r"(?i)\b([a-g])\s*(?:-| )?(major|minor|maj|min)\b", r"([A-Ga-g])\s*(大调|小调)"
    get = lambda p, i: F.regexp_extract(c, p, i)
    mode = F.when(F.lower(get(latin, 2)).startswith("maj"), "major").otherwise("minor")
    cn_mode = F.when(get(chinese, 2) == "大调", "major").otherwise("minor")
    both = lambda found, note, m: F.when(found, F.array(F.concat_ws(" ", F.lower(note), m), F.concat_ws("-", F.lower(note), m))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(both(get(latin, 1) != "", get(latin, 1), mode), both(get(chinese, 1) != "", get(chinese, 1), cn_mode)))


def aliases(c: Column) -> Column:
    """The distinct names, sorted; empty for ''."""
    text, norm = trimmed(c), plain(c)
    none = F.array().cast("array<string>")
    some = lambda test, values: F.when(test, values).otherwise(none)
    put = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    has = lambda pattern: text.rlike(pattern) | norm.rlike(pattern)
    instruments = F.array_compact(F.array(*(F.when(has(p), name) for name, p in INSTRUMENTS)))
    piano = has(INSTRUMENTS[1][1])
    chinese_key = r"([A-Ga-g])\s*(大调|小调)"
    short = F.concat(F.lower(F.regexp_extract(text, chinese_key, 1)), F.regexp_extract(text, chinese_key, 2), F.lit("钢协"))
    parts = [put(norm, plain(without_catalogue(text)), plain(without_key(text)))]
    parts += [some(F.contains(text, F.lit("协奏曲")) & piano, put("钢协")), some(F.contains(text, F.lit("协奏曲")) & piano & text.rlike(chinese_key), put(short))]
    parts += [some(text.rlike("协奏曲") & text.rlike("钢琴"), put("钢琴协奏曲", "钢协")), some(norm.rlike("concerto") & norm.rlike("piano"), put("piano concerto"))]
    with_key = lambda heads: F.flatten(F.transform(keys(text), lambda k: F.transform(heads, lambda h: F.concat_ws(" ", h, k))))
    bare = F.transform(instruments, lambda i: F.concat(i, F.lit(" concerto")))
    concerto, keyed = norm.rlike("concerto") | text.rlike("协奏曲"), F.size(keys(text)) > 0
    parts += [some(concerto & keyed, bare), some(concerto, with_key(F.concat(bare, F.transform(bare, lambda b: F.concat(b, F.lit(" in"))), put("concerto")))), some(concerto & piano, with_key(put("klavierkonzert")))]
    for chinese, english in (("奏鸣曲", "sonata"), ("交响曲", "symphony")):
        parts.append(some(norm.rlike(english) | text.rlike(chinese), with_key(put(english, f"{english} in"))))
    parts += [some(has(p), put(*values)) for p, values in NICKNAMES] + [some(norm.rlike(p), put(*values)) for p, values in NUMBERS]
    arabic, written = rf"第?\s*([0-9]+)\s*{_FORM}", rf"第?\s*([一二三四五六七八九十百两]+)\s*{_FORM}"
    number = F.when(text.rlike(arabic), F.regexp_extract(text, arabic, 1)).when(text.rlike(written), chinese_number(F.regexp_extract(text, written, 1)).cast("string"))
    form = F.when(text.rlike(arabic), F.regexp_extract(text, arabic, 2)).otherwise(F.regexp_extract(text, written, 2))
    english = F.try_element_at(F.create_map(*(F.lit(x) for kv in FORMS.items() for x in kv)), form)
    parts.append(some(number.isNotNull(), F.transform(put(" no ", " no. ", " no.", " n ", " "), lambda m: F.concat(english, m, number))))
    parts.append(some(number.isNotNull() & (english == "symphony"), F.array(F.concat(F.lit("sym "), number), F.concat(F.lit("sym"), number))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: x != "")))
