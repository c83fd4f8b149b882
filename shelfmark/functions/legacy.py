"""Old pages of recordings: their links, images and paragraphs by a parser, in Arrow batches; what the paragraphs say, as columns."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from shelfmark.functions import matching, rules

def _lists(first: str, second: str) -> ArrayType:
    return ArrayType(StructType([StructField(first, StringType()), StructField(second, StringType())]))


OUTLINE = StructType([StructField("links", _lists("href", "text")), StructField("images", _lists("src", "alt")), StructField("paragraphs", _lists("text", "link"))])
#: Elements that end an open paragraph.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# What the labels of paragraphs may hold (in Chinese and as written) or be (in English, letters alone).
DATES, DATES_EN = ("时间", "地点"), ("date", "time", "venue", "location")
ALBUMS, ALBUMS_EN = ("专辑", "唱片", "Album"), ("album",)
LABELS, LABELS_EN = ("发行商", "厂牌", "唱片公司", "Label"), ("label", "publisher")
RELEASES, RELEASES_EN = ("发行日期", "出版日期", "Date"), ("release", "release date", "date")
CREDITS = ("乐团", "乐队", "管弦乐团", "管弦乐队", "交响乐团", "交响乐队", "指挥", "独奏", "钢琴", "小提琴", "中提琴", "大提琴", "歌手", "组合", "合唱", "主演", "女高音", "女中音", "次女高音", "男高音", "男中音", "男低音", "ensemble", "chorus")
CREDITS_EN = ("orchestra", "conductor", "soloist", "violin", "piano", "cello", "soprano", "tenor", "baritone", "bass", "ensemble", "chorus", "choir")
ROLES = (
    ("conductor", ("指挥", "执棒"), ("conductor", "dirigent")), ("orchestra", ("乐团", "乐队", "管弦乐团", "管弦乐队", "交响乐团", "交响乐队"), ("orchestra", "philharmonic orchestra", "symphony orchestra", "philharmonic")),
    ("chorus", ("合唱",), ("chorus", "choir")), ("singer", ("女高音", "女中音", "次女高音", "男高音", "男中音", "男低音", "歌手", "主演"), ("soprano", "tenor", "baritone", "bass", "mezzo soprano", "singer", "vocal")),
    ("ensemble", ("组合", "四重奏", "三重奏"), ("ensemble", "quartet", "trio")),
)


class _Page(HTMLParser):
    """Collects links, images and paragraphs; a paragraph ends at its end tag or at the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[list] = []
        self.images: list[dict] = []
        self.paragraphs: list[dict] = []
        self._open: list[list] = []
        self._link: list | None = None
        self._skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = dict(attrs)
        if tag in _BLOCKS:
            self._close()
        if tag == "p":
            self._open = [[], None]
        elif tag == "a":
            self._link = [held.get("href"), []]
            self.links.append(self._link)
            if self._open and self._open[1] is None:
                self._open[1] = self._link
        elif tag == "img":
            self.images.append({"src": held.get("src"), "alt": held.get("alt")})
        elif tag in ("script", "style"):
            self._skip += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" or tag in _BLOCKS:
            self._close()
        elif tag == "a":
            self._link = None
        elif tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)

    def handle_data(self, data: str) -> None:
        if not self._skip:
            if self._open:
                self._open[0].append(data)
            if self._link:
                self._link[1].append(data)

    def _close(self) -> None:
        if self._open:
            text, link = self._open
            self.paragraphs.append({"text": "".join(text), "link": "".join(link[1]) if link else None})
        self._open = []


@F.pandas_udf(OUTLINE)
def outline(html: pd.Series) -> pd.DataFrame:
    """A page's links, images and paragraphs, in order; empty lists for null."""
    out = []
    for text in html:
        page = _Page()
        page.feed(text or "")
        page.close()
        page._close()
        out.append(([{"href": h, "text": "".join(t)} for h, t in page.links], page.images, page.paragraphs))
    return pd.DataFrame(out, columns=["links", "images", "paragraphs"])


def flat(c: Column) -> Column:
    """One blank for each run of blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x{a0}]+", " "))


def _says(label: Column, letters: Column, held: tuple[str, ...], equal: tuple[str, ...]) -> Column:
    out = letters.isin(*equal)
    for word in held:
        out = out | F.contains(label, F.lit(word))
    return out


def _letters(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z]+", " "))


def role_of(label: Column) -> Column:
    def tell(letters: Column) -> Column:
        out = F.lit("soloist")
        for role, held, equal in reversed(ROLES):
            out = F.when(_says(label, letters, held, equal), role).otherwise(out)
        return out

    return matching.let(_letters(label), tell)


def day_and_place(c: Column) -> Column:
    """struct(day, place): cut at the last full-width comma, else at the last comma, where something stands before it and after it no year does."""
    def at(mark: str) -> tuple[Column, Column]:
        return F.trim(F.regexp_extract(c, f"^(.+){mark}([^{mark}]*)$", 1)), F.trim(F.regexp_extract(c, f"^(.+){mark}([^{mark}]*)$", 2))

    cut = lambda mark: (at(mark)[1] != "") & ~at(mark)[1].rlike("^[0-9]{4}")
    pair = lambda a, b: F.struct(a.alias("day"), b.alias("place"))
    return F.when(cut("，"), pair(*at("，"))).when(cut(","), pair(*at(","))).otherwise(pair(c, F.lit("")))


def said(paragraphs: Column) -> Column:
    """kind, label, value, name of each paragraph that has a label: 'when', 'album', 'label', 'release', 'credit' or 'other'; name: the first link's text,
    else the value."""
    form = r"^([^：:]+)[：:]\s*(.+)$"

    def parts(text: Column) -> Column:
        return F.struct(flat(F.regexp_extract(text, form, 1)).alias("label"), flat(F.regexp_extract(text, form, 2)).alias("value"))

    def kind(x: Column, letters: Column) -> Column:
        says = lambda held, equal: _says(x["label"], letters, held, equal)
        return (
            F.when(says(DATES, DATES_EN), "when").when(says(ALBUMS, ALBUMS_EN), "album").when(says(LABELS, LABELS_EN), "label")
            .when(says(RELEASES, RELEASES_EN), "release").when(says(CREDITS, CREDITS_EN), "credit").otherwise("other")
        )

    # each step is a list of its own, so that a text that several places ask for is worked out once
    cut = F.transform(paragraphs, lambda p: F.struct(matching.let(flat(p["text"]), parts).alias("x"), p["link"].alias("link")))
    held = F.filter(cut, lambda c: c["x"]["value"] != "")
    return F.transform(held, lambda c: F.struct(
        matching.let(_letters(c["x"]["label"]), lambda letters: kind(c["x"], letters)).alias("kind"), c["x"]["label"].alias("label"), c["x"]["value"].alias("value"), F.coalesce(F.nullif(flat(c["link"]), F.lit("")), c["x"]["value"]).alias("name"),
    ))


def recording_fields(page: Column) -> dict[str, Column]:
    """links, images, credits and texts of an outlined page, of its column `said`: of a kind the last paragraph counts."""
    last = lambda kind: F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("said", lambda x: x["kind"] == kind), lambda x: x["value"])), -1), F.lit(""))
    when = matching.let(last("when"), day_and_place)
    links = F.filter(F.transform(page["links"], lambda x: F.struct(F.trim(x["href"]).alias("url"), flat(x["text"]).alias("title"))), lambda x: x["url"].rlike("^https?://"))
    credits = F.filter("said", lambda x: (x["kind"] == "credit") & ~F.lower(x["name"]).isin("", "-", "unknown", "未知"))
    return {
        "links": F.transform(links, lambda x: F.struct(rules.link_platform(x["url"]).alias("platform"), x["url"].alias("url"), F.lit("").alias("localPath"), x["title"].alias("title"), F.lit("external").alias("linkType"), F.lit("public").alias("visibility"))),
        "images": F.filter(F.transform(page["images"], lambda x: F.struct(F.trim(x["src"]).alias("src"), flat(x["alt"]).alias("alt"), F.lit("other").alias("kind"))), lambda x: x["src"] != ""),
        "credits": F.transform(credits, lambda x: F.struct(role_of(x["label"]).alias("role"), F.lit("").alias("personId"), x["name"].alias("displayName"), x["label"].alias("label"))),
        "performanceDateText": when["day"], "venueText": when["place"], "albumTitle": last("album"), "label": last("label"), "releaseDate": last("release"),
    }


def work_path(c: Column) -> Column:
    """struct(composer, groups, work, file) of a path of five parts and more; null for others."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n >= 5, F.struct(
        F.get(parts, 1).alias("composer"), F.slice(parts, F.lit(3), F.greatest(n - 4, F.lit(0))).alias("groups"), F.get(parts, n - 2).alias("work"), F.regexp_replace(F.get(parts, n - 1), r"(?i)\.htm$", "").alias("file"),
    ))


def name_pair(lead: Column, fallback: Column) -> Column:
    """struct(name, latin): 'Name (Latin)' at the start of a text, else the fallback."""
    form, text = r"^(.+?)[(（]([^()（）]+)[)）]", flat(lead)
    found = text.rlike(form)
    return F.struct(F.when(found, flat(F.regexp_extract(text, form, 1))).otherwise(flat(fallback)).alias("name"), F.when(found, flat(F.regexp_extract(text, form, 2))).otherwise("").alias("latin"))
