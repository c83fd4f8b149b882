"""What pages of known kinds hold: meta fields, links of result lists, embedded JSON. Patterns are as the pages write them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import trimmed, unescape

# Platforms of search results by words of the address.
PLATFORMS = [(r"youtube\.com|youtu\.be", "youtube"), (r"bilibili\.com", "bilibili"), (r"apple\.com", "apple_music"), (r"spotify\.com", "spotify"), (r"qobuz\.com", "qobuz")]


def _html(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def result_platform(url: Column) -> Column:
    out = F.lit("other")
    for pattern, name in reversed(PLATFORMS):
        out = F.when(F.lower(_html(url)).rlike(pattern), name).otherwise(out)
    return out


def meta(c: Column, key: str, attribute: str = "property") -> Column:
    """The content of a meta tag, attributes in either order, entities resolved; '' without one."""
    k = "".join(f"\\{x}" if not x.isalnum() else x for x in key)
    tries = [rf"""(?i)<meta[^>]+{attribute}=["']{k}["'][^>]+content=["']([^"']+)["']""", rf"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+{attribute}=["']{k}["']"""]
    return unescape(F.coalesce(*(F.nullif(F.regexp_extract(_html(c), p, 1), F.lit("")) for p in tries), F.lit("")))


def title(c: Column) -> Column:
    return unescape(trimmed(F.regexp_extract(_html(c), r"(?i)<title>([^<]+)</title>", 1)))


def seconds(c: Column) -> Column:
    """A length in seconds or as PT..M..S; 0 without one."""
    plain = lambda name: F.nullif(F.regexp_extract(_html(c), rf'(?i)"{name}":"([0-9]+)"', 1), F.lit("")).try_cast("int")
    part = lambda i: F.coalesce(F.regexp_extract(_html(c), r'(?i)"duration":"PT(?:([0-9]+)M)?(?:([0-9]+)S)?"', i).try_cast("int"), F.lit(0))
    return F.coalesce(plain("lengthSeconds"), plain("durationSeconds"), part(1) * 60 + part(2))


def uploader(c: Column) -> Column:
    tries = (r'(?i)"ownerChannelName":"([^"]+)"', r'(?i)"author":"([^"]+)"')
    return unescape(F.coalesce(*(F.nullif(F.regexp_extract(_html(c), p, 1), F.lit("")) for p in tries), F.lit("")))


def views(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(_html(c), r'(?i)"viewCount":"([0-9]+)"', 1).try_cast("long"), F.lit(0).cast("long"))


def first_image(c: Column) -> Column:
    """The first image's address that is no inlined data, as it is written."""
    found = F.transform(F.regexp_extract_all(_html(c), F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), 1), trimmed)
    return F.coalesce(F.get(F.filter(found, lambda x: (x != "") & ~x.startswith("data:")), 0), F.lit(""))


def video_links(c: Column) -> Column:
    ids = F.regexp_extract_all(_html(c), F.lit(r'"videoRenderer"[\s\S]{0,600}?"videoId":"([^"]+)"'), 1)
    return F.transform(ids, lambda x: F.concat(F.lit("https://www.youtube.com/watch?v="), x))


def redirect_target(url: Column) -> Column:
    """Where a search engine's counting link leads: its `u` is base64 after two marks; the link itself if it is none."""
    u = F.regexp_replace(F.regexp_extract(trimmed(url), "[?&]u=([^&]+)", 1), "^a1", "")
    padded = F.rpad(u, F.length(u) + F.pmod(-F.length(u), F.lit(4)), "=")
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(F.contains(trimmed(url), F.lit("bing.com/ck/a")) & (u != "") & decoded.startswith("http"), decoded).otherwise(trimmed(url))


@F.pandas_udf(StringType())
def _object_after(text: pd.Series, marker: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def one(t: str | None, m: str) -> str | None:
        at = (t or "").find(m)
        if at < 0:
            return None
        rest = t[at + len(m) :].lstrip()
        if not rest.startswith("{"):
            return None
        try:
            found, _ = decoder.raw_decode(rest)
        except ValueError:
            return None
        return canonical(found)

    return pd.Series([one(t, m) for t, m in zip(text, marker, strict=True)])


def object_after(text: Column, marker: str) -> Column:
    """The JSON object that follows a marker, in canonical form; null without a whole one."""
    return _object_after(text, F.lit(marker))


def canonical(value: object) -> str:
    """JSON with keys in order and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with keys in order at every level; null for what is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def with_base(base: Column, path: Column) -> Column:
    """A path under a site's base path, with one slash between them; full addresses and anchors stay as they are."""
    root = F.regexp_replace(F.concat(F.lit("/"), trimmed(base)), "/+", "/")
    bare = F.regexp_replace(root, "/$", "")
    return F.when(path.rlike(r"^(?:[a-z]+:|//|#)"), path).otherwise(F.concat(bare, F.lit("/"), F.regexp_replace(path, "^/+", "")))


def result_identity(url: Column) -> Column:
    """What a result is known by: a video's id with its platform, else the address in lower case without its last slashes; '' for none."""
    u = trimmed(url)
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    bv, av = F.lower(F.regexp_extract(u, "(?i)/(BV[0-9A-Za-z]+)/?", 1)), F.regexp_extract(u, "(?i)/av([0-9]+)", 1)
    watch = F.lower(F.regexp_extract(u, r"\?(?:[^#]*&)?v=([^&#]+)", 1))
    short = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*/+([^?#]*?)/*(?:[?#]|$)", 1))
    return (
        F.when(u == "", "").when(bv != "", F.concat(F.lit("bilibili:"), bv)).when(av != "", F.concat(F.lit("bilibili:av"), av))
        .when(F.contains(host, F.lit("youtube.com")) & (watch != ""), F.concat(F.lit("youtube:"), watch))
        .when(F.contains(host, F.lit("youtu.be")) & (short != ""), F.concat(F.lit("youtube:"), short)).otherwise(F.lower(F.regexp_replace(u, "/+$", "")))
    )
