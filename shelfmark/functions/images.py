"""Image candidates: which ones look wrong, and how well one serves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of images that show no person, and what a source adds to a score.
SUSPICIOUS = (
    r"(?i)(^|[^a-z])(logo|icon|badge|brand|site\s*logo|baike[-_ ]?logo|baidubaike|baidu[-_ ]?baike|baidu[-_ ]?logo|bd[-_ ]?logo|favicon|placeholder|sprite|"
    r"default[-_ ]?image|no[-_ ]?image|wordmark|signature|autograph|watermark)([^a-z]|$)"
)
SOURCE_BOOST = {"wikimedia-commons": 24, "wikipedia": 18, "wikidata": 18, "streaming": 16, "official-site": 14}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_suspicious(src: Column, source_url: Column, attribution: Column, title: Column) -> Column:
    return F.concat_ws(" ", _text(src), _text(source_url), _text(attribution), _text(title)).rlike(SUSPICIOUS)


def score(wanted: Column, src: Column, source_url: Column, kind: Column, attribution: Column, title: Column, width: Column, height: Column) -> Column:
    """By source, title, resolution and attribution, less what a shape far from a square, a watermark or a suspicious word costs; 0 at least."""
    w, h = F.coalesce(width, F.lit(0)).cast("double"), F.coalesce(height, F.lit(0)).cast("double")
    shape = F.when((w > 0) & (h > 0), F.abs(1 - w / F.nullif(h, F.lit(0.0))) * 25).otherwise(18.0)
    boost = F.lit(4)
    for name, n in SOURCE_BOOST.items():
        boost = F.when(kind == name, n).otherwise(boost)
    named = F.contains(F.lower(_text(source_url)), F.regexp_replace(F.lower(wanted), r"\s+", "-")) | F.contains(F.lower(_text(title)), F.lower(wanted))
    marked = F.concat_ws(" ", _text(title), _text(source_url)).rlike("(?i)watermark|sample|sprite")
    total = (
        boost + F.when(named, 8).otherwise(0) + F.least(F.least(w, h) / 40, F.lit(40.0)) + F.when(_text(attribution) != "", 4).otherwise(0)
        - shape - F.when(marked, 16).otherwise(0) - F.when(is_suspicious(src, source_url, attribution, title), 48).otherwise(0)
    )
    return F.greatest(F.lit(0.0), total)
