"""Named queries of matching and choosing over the relational tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.functions import images, matching, names, pages, rules
from shelfmark.functions import text as T
from shelfmark.operators import candidates, proposals

from .catalogue import query

_LABEL = "p_name || ' (No. ' || p_size || '), Op.' || p_partkey || ' [' || p_brand || '] & Co-\"' || p_type || '\"'"


def _label():
    return F.expr("""concat(p_name, ' (No. ', p_size, '), Op.', p_partkey, ' [', p_brand, '] & Co-"', p_type, '"')""")


@query(f"""WITH t AS (SELECT p_partkey, {_LABEL} AS c FROM part) SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(c), '[,.;:''"`()\\[\\]_/\\\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS search_text,
trim(regexp_replace(regexp_replace(lower(c), '[,.:;''"`()\\[\\]_/\\\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS search_query, regexp_replace(lower(c), '[\\s''"`,;:!?()\\[\\]{{}}_/\\\\|&-]+', '', 'g') AS name_key, regexp_replace(lower(c), '[^a-z0-9]+', '', 'g') AS lookup_key,
regexp_replace(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(lower(c), '[\\s:;,.''"`()\\[\\]{{}}<>|/\\\\_-]+', ' ', 'g')) AS match_text FROM t""")
def text_keys(t):
    """A text's keys for search, query, names, lookup, slug and matching, each by its own rule (ops F1, F2, F3, F4, F5, F8)."""
    c = _label()
    return t("part").select(
        "p_partkey", names.search_text(c).alias("search_text"), matching.search_query(c).alias("search_query"), names.name_key(c).alias("name_key"), T.lookup_key(c).alias("lookup_key"),
        T.slug(c).alias("slug"), matching.match_text(c).alias("match_text"),
    )


_PERSON = "concat(CASE s_suppkey % 3 WHEN 0 THEN 'José' ELSE 'Anna' END, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' Maria von der' WHEN 2 THEN ' de  la Luz' WHEN 3 THEN ' Van den' ELSE ' M. X.' END, ' ', CASE s_suppkey % 7 WHEN 0 THEN '卡拉扬' WHEN 1 THEN 'Díaz' ELSE concat('Berg', substr(s_name, 18)) END)"
_NOTED = "concat(CASE s_suppkey % 2 WHEN 0 THEN '卡拉扬' ELSE 'Chor' END, CASE s_suppkey % 4 WHEN 0 THEN concat(' (EN: Herbert ', substr(s_name, 16), ')') WHEN 1 THEN concat(', en： Choir ', s_suppkey) WHEN 2 THEN ' （EN: none）' ELSE ' (x)' END)"
_PARTS = f"list_filter(regexp_split_to_array(trim({_PERSON}), '\\s+'), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT s_suppkey, {_PARTS} AS w, trim({_PERSON}) AS whole, trim({_NOTED}) AS noted FROM supplier),
k AS (SELECT *, array_to_string(w[2:-2], ' ') AS mid FROM p), s AS (SELECT *, w[1] || CASE WHEN len(w) > 2 THEN regexp_extract(' ' || mid, '(?i)((?: (?:{"|".join(names.SURNAME_PARTICLES)}))*)$', 1) ELSE '' END || CASE WHEN len(w) > 1 THEN ' ' || w[-1] ELSE '' END AS short FROM k),
e AS (SELECT *, trim(regexp_extract(noted, '(?i)EN\\s*[:：]\\s*([^()]+?)(?:\\)|$)', 1)) AS found FROM s), f AS (SELECT *, regexp_replace(found, '^[ ,;|)]+|[ ,;|)]+$', '', 'g') AS bare_en FROM e)
SELECT s_suppkey, CASE WHEN regexp_matches(whole, '[A-Za-z]') AND NOT regexp_matches(whole, '[\\x{{4e00}}-\\x{{9fff}}]') AND len(w) >= 3 AND short <> whole THEN array_to_string(list_distinct([short]) || CASE WHEN strip_accents(short) <> short THEN [strip_accents(short)] ELSE [] END, ',') ELSE '' END AS variants,
CASE WHEN bare_en <> '' AND regexp_matches(bare_en, '[A-Za-z]') AND NOT regexp_matches(bare_en, '[\\x{{4e00}}-\\x{{9fff}}]') THEN bare_en ELSE '' END AS latin,
trim(regexp_replace(trim(regexp_replace(noted, '(?i)\\(\\s*EN\\s*[:：].*?\\)', '', 'g')), '(?i)[,，]\\s*EN\\s*[:：].*$', '')) AS bare FROM f""")
def latin_variants(t):
    """Short forms of Latin names with their particles, without accents, and names that annotations give (ops F15, F20, F7)."""
    c = F.expr(_NOTED)
    return t("supplier").select("s_suppkey", F.array_join(names.condensed_latin(F.expr(_PERSON)), ",").alias("variants"), matching.explicit_latin(c).alias("latin"), matching.without_annotations(c).alias("bare"))


_TOK = lambda c: f"list_filter(string_split_regex({c}, '[^a-z0-9]+'), lambda t: length(t) >= 2 OR regexp_matches(t, '^[0-9]+$'))"


@query(f"""WITH t AS (SELECT p_partkey, lower(p_name || ' j. w. radio symphony ' || p_type || ' no ' || p_size) AS hay, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'Big ' || upper(p_name) WHEN 2 THEN 'Johann Wolf' WHEN 3 THEN 'RS' ELSE 'Rotterdam Symphony Orchestra' END AS v FROM part),
k AS (SELECT *, {_TOK('lower(v)')} AS w, {_TOK('hay')} AS h FROM t), m AS (SELECT *, len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(hay, x))) = 0 AS whole FROM k)
SELECT p_partkey, whole OR (length(w[-1]) >= 4 AND contains(hay, w[-1])) OR (len(w) >= 2 AND regexp_matches(hay, '\\b' || array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '[\\.\\s]+') || '\\.?\\b')) AS is_named,
len(w) > 0 AND (whole OR (len(list_filter(w, lambda x: length(x) >= 2)) >= 2 AND contains(replace(replace(hay, '.', ''), ' ', ''), array_to_string(list_transform(list_filter(w, lambda x: length(x) >= 2), lambda x: substr(x, 1, 1)), '')))
 OR (v = 'RS' AND contains(array_to_string(list_transform(list_filter(h, lambda x: length(x) >= 2), lambda x: substr(x, 1, 1)), ''), 'rs'))
 OR (len(list_filter(w, lambda x: x NOT IN ('orchestra', 'philharmonic', 'symphony', 'ensemble', 'choir'))) > 0 AND len(list_filter(w, lambda x: x NOT IN ('orchestra', 'philharmonic', 'symphony', 'ensemble', 'choir') AND NOT contains(hay, x))) = 0)) AS is_ensemble FROM m""")
def name_matches(t):
    """Names and ensembles in a text: all words, surname, initials, acronyms (ops F6, F12, F13)."""
    k = F.col("p_partkey") % 5
    hay = matching.plain(F.expr("concat(p_name, ' J. W. radio symphony ', p_type, ' No. ', p_size)"))
    v = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("Big "), F.upper("p_name"))).when(k == 2, "Johann Wolf").when(k == 3, "RS").otherwise("Rotterdam Symphony Orchestra")
    return t("part").select("p_partkey", matching.name_matches(hay, v).alias("is_named"), matching.ensemble_matches(hay, v).alias("is_ensemble"))


@query("""WITH t AS (SELECT p_partkey, p_size, p_partkey % 3 AS k, (p_partkey % 40) * 40 AS s, CASE p_partkey % 4 WHEN 0 THEN 900 WHEN 1 THEN 720 WHEN 2 THEN 900 ELSE 0 END AS least FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'op' || p_size ELSE 'k' || p_size || 'a' END AS marks, CAST(CASE WHEN k = 0 THEN 0.06 WHEN k = 1 THEN -0.2 ELSE 0.0 END AS DOUBLE) AS fit, 'Work' AS bare, CAST(least AS INTEGER) AS least_seconds,
CAST(CASE WHEN s <= 0 OR least <= 0 THEN 0.0 WHEN s >= floor(least * 0.85) THEN CASE WHEN k = 0 THEN 0.05 ELSE 0.02 END WHEN s < greatest(240, floor(least * 0.35)) THEN -0.38 WHEN s < floor(least * 0.6) THEN -0.18 ELSE 0.0 END AS DOUBLE) AS length_fit FROM t""")
def work_marks(t):
    """Catalogue marks of works and how lengths fit them (ops F9, N8)."""
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Work, Op. "), n, F.lit(";"))).otherwise(F.concat(F.lit("Work K."), n, F.lit("a")))
    wanted = F.when(k == 0, F.concat(F.lit("Op. "), n)).when(k == 1, F.concat(F.lit("Op. "), n)).otherwise("")
    j = F.col("p_partkey") % 4
    title = F.when(j == 0, "Piano Concerto").when(j == 1, "奏鸣曲").when(j == 2, "Requiem").otherwise("Lied")
    least = matching.least_seconds(title, F.lit(None).cast("string"))
    hay = F.when(k == 0, "full x").otherwise("x")
    return t("part").select(
        "p_partkey", F.array_join(matching.catalogue_marks(text), ",").alias("marks"), matching.catalogue_fit(wanted, matching.plain(text)).alias("fit"), matching.without_catalogue(text).alias("bare"),
        least.alias("least_seconds"), matching.duration_fit(least, hay, (F.col("p_partkey") % 40) * 40).alias("length_fit"),
    )


@query("""WITH t AS (SELECT p_partkey, p_partkey % 8 AS k, p_name FROM part)
SELECT p_partkey, CAST(round(CASE k WHEN 0 THEN 0.05 + 0.03 + 0.05 + 0.05 + 0.04 WHEN 1 THEN -0.05 + 0.03 - 0.02 WHEN 2 THEN 0.03 + 0.05 - 0.02 + 0.01 + 0.03 WHEN 3 THEN -0.08 WHEN 4 THEN -0.06 WHEN 5 THEN -0.05 WHEN 6 THEN 0.05 ELSE 0.05 END, 4) AS DOUBLE) AS quality, k = 1 AS conflict,
CASE k WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' WHEN 3 THEN 'yellow' WHEN 4 THEN 'red' WHEN 5 THEN 'yellow' ELSE 'green' END AS zone, CASE k WHEN 4 THEN 'conflicting-credit:abe/bob/cid' WHEN 1 THEN 'low-evidence' WHEN 3 THEN 'low-evidence' WHEN 5 THEN 'low-evidence' ELSE 'high-confidence' END AS note FROM t""")
def title_quality(t):
    """How exactly titles name a recording, years that conflict, and the zone that follows (ops K2 for titles, P14, P15)."""
    k = F.col("p_partkey") % 8
    titles = ["Beethoven Concerto op.73 Pollini & Abbado 1976", "Some concerto 1999", "Beethoven: Emperor Concerto - Pollini", "remaster", "a & b [BD]", " ", "贝多芬", "OP. 73"]
    title = F.element_at(F.array(*map(F.lit, titles)), (k + 1).cast("int"))
    years, list_of = F.array(F.lit("1976")), lambda *x: F.array(*map(F.lit, x))
    q = matching.title_quality(title, years, list_of("concerto", "emperor"), F.lit("贝多芬"), F.lit("Ludwig van Beethoven"), F.lit("Op.73"), list_of("Maurizio Pollini"), F.when(k == 2, F.array().cast("array<string>")).otherwise(list_of("Claudio Abbado")), list_of("Maurizio Pollini"), k == 2)
    q = F.when(k == 7, matching.title_quality(title, years, list_of(), F.lit(""), F.lit(""), F.lit("Op. 73"), list_of(), list_of(), list_of(), F.lit(False))).otherwise(q)
    people = F.when(k == 4, list_of("bob", "abe", "cid", "dan")).otherwise(F.array().cast("array<string>"))
    z = rules.zone(F.lit(0.7), q, people, rules.collaborates(title), F.lit(True))
    return t("part").select("p_partkey", F.round(q, 4).alias("quality"), matching.year_conflict(title, years).alias("conflict"), z["zone"].alias("zone"), z["note"].alias("note"))


#: A page's text and what is looked for in it: work, composer, lead, orchestra, year.
_SEEN = "CASE WHEN p_partkey % 13 = 5 THEN ' - ' ELSE concat(p_name, '; ', CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END, ' (', 1950 + p_size % 6, ')', CASE p_partkey % 4 WHEN 0 THEN ', was born' WHEN 1 THEN ' live, born' WHEN 2 THEN ' 作曲家生平' ELSE '' END) END"
_SOUGHT = ("CASE WHEN p_partkey % 2 = 0 THEN concat('Large ', p_type) ELSE 'zzz.' END", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('Herr ', upper(split_part(p_name, ' ', 1))) END", "concat('Solti/', p_brand)", "CASE WHEN p_partkey % 5 = 0 THEN concat('Big [', split_part(p_name, ' ', 2), ']') ELSE 'Chicago' END", "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(1950 + p_partkey % 6 AS STRING) END")
_BLANKED = lambda c: f"trim(regexp_replace(lower({c}), '[\\s·:：;；,.，。''\"`()\\[\\]{{}}<>|/\\\\_-]+', ' ', 'g'))"
_HIT = lambda c: f"len(list_filter(string_split({_BLANKED(c)}, ' '), lambda x: x <> '' AND contains(hay, x))) > 0"


@query(f"""WITH t AS (SELECT *, {_BLANKED(_SEEN)} AS hay FROM part)
SELECT p_partkey, CAST(CASE WHEN hay = '' THEN 0 ELSE {" + ".join(f"CASE WHEN {_HIT(c)} THEN {n} ELSE 0 END" for c, n in zip(_SOUGHT[:4], (4, 2, 3, 2)))} + CASE WHEN {_SOUGHT[4]} <> '' AND contains(hay, {_SOUGHT[4]}) THEN 2 ELSE 0 END
- CASE WHEN regexp_matches(hay, 'biography|born|composer|founded|首席指挥|作曲家生平|担任') AND NOT regexp_matches(hay, 'album|recording|symphony|concert|live|交响曲|录音|演出') THEN 5 ELSE 0 END END AS INTEGER) AS score FROM t""")
def simple_matches(t):
    """Matches of a text by any word of work, composer, leads, orchestra and year (op K3)."""
    work, composer, lead, orchestra, year = map(F.expr, _SOUGHT)
    return t("part").select("p_partkey", matching.simple_match(F.expr(_SEEN), work, composer, F.array(lead), F.array(orchestra), year).alias("score"))


_CAND = """SELECT l_orderkey AS item, l_linenumber AS pos, ['youtube', 'bilibili', 'apple_music', 'other'][CAST(l_suppkey % 4 AS INTEGER) + 1] AS platform, ['green', 'yellow', 'red'][CAST(l_partkey % 3 AS INTEGER) + 1] AS zone,
CAST(round(l_discount * 10, 2) AS DOUBLE) AS confidence, CAST(round(l_tax, 2) AS DOUBLE) AS exactness, l_returnflag = 'R' AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS one FROM lineitem) WHERE one = 1"""


def _candidates(t):
    kinds = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    from shelfmark.operators import keyed

    one = keyed.first_per_key(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return one.select(
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("pos"), kinds(["youtube", "bilibili", "apple_music", "other"], "l_suppkey").alias("platform"), kinds(["green", "yellow", "red"], "l_partkey").alias("zone"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.round("l_tax", 2).alias("exactness"), (F.col("l_returnflag") == "R").alias("accepted"),
    )


@query(f"""SELECT item, pos, zone FROM (SELECT *, row_number() OVER (PARTITION BY item, platform, zone ORDER BY pos) AS r FROM ({_CAND})) WHERE r <= CASE zone WHEN 'green' THEN 3 WHEN 'yellow' THEN 2 ELSE 0 END""")
def zone_limits(t):
    """Three green and two yellow candidates a platform (op W3)."""
    return candidates.limit_by_zone(_candidates(t)).select("item", "pos", "zone")


@query(f"""WITH c AS ({_CAND}), r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(confidence) OVER w, 0.0) AS nxt, count(*) OVER (PARTITION BY item) AS n, coalesce(max(exactness) OVER (PARTITION BY item ORDER BY confidence DESC, pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -0.05) AS other FROM c WINDOW w AS (PARTITION BY item ORDER BY confidence DESC, pos))
SELECT item, pos FROM r WHERE r = 1 AND (confidence >= 0.58 OR (platform <> 'other' AND ((confidence >= 0.5 AND confidence - nxt >= 0.08) OR (confidence >= 0.5 AND exactness >= 0.1 AND exactness - other >= 0.03 - 1e-6) OR (confidence >= 0.45 AND n = 1 AND exactness >= 0.08) OR (confidence >= 0.45 AND exactness >= 0.08 AND exactness - other >= 0.05 - 1e-6) OR (confidence >= 0.5 AND n = 1))))""")
def dominant_candidates(t):
    """The candidate of an item that stands out (op R15)."""
    return candidates.dominant(_candidates(t)).select("item", "pos")


@query(f"""WITH c AS ({_CAND}), p AS (SELECT *, exactness >= 0.05 AND platform <> 'other' AS ok FROM c), f AS (SELECT *, coalesce(ok AND pos = min(CASE WHEN ok THEN pos END) OVER (PARTITION BY item, platform), false) AS champion FROM p),
a AS (SELECT *, sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY item) >= 2 AND accepted AS moved FROM f)
SELECT item, pos, champion, CAST(row_number() OVER (PARTITION BY item ORDER BY champion DESC, pos) AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY item ORDER BY moved DESC, pos) AS INTEGER) AS accepted_place FROM a""")
def champion_order(t):
    """A platform's champion first; accepted candidates first where there are enough (ops W5, O11)."""
    c = candidates.champions(_candidates(t), F.col("exactness") >= 0.05).withColumnRenamed("place", "_place")
    return candidates.accepted_first(c, 2).select("item", "pos", "champion", F.col("_place").alias("place"), F.col("place").alias("accepted_place"))


@query(f"""WITH c AS ({_CAND}), q AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos) AS r, row_number() OVER (PARTITION BY item, platform ORDER BY pos) AS k, first_value(exactness) OVER (PARTITION BY item ORDER BY pos) AS top FROM c WHERE confidence >= 0.45 AND exactness >= 0.05),
l AS (SELECT *, platform <> 'other' AND k = 1 AS lead_, max(CASE WHEN platform <> 'other' AND k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY item) AS has_lead FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos) AS n FROM l WHERE (has_lead = 1 AND lead_) OR (has_lead = 0 AND (r = 1 OR exactness >= top - 0.03)))
SELECT item, pos FROM n WHERE n <= CASE WHEN has_lead = 1 THEN 3 ELSE 2 END""")
def rescued_candidates(t):
    """Candidates that stand in: one a platform, else the first and one as exact (op W12)."""
    return candidates.rescued(_candidates(t), (F.col("confidence") >= 0.45) & (F.col("exactness") >= 0.05)).select("item", "pos")


@query(f"""SELECT item, ties, CASE WHEN ties >= 3 THEN least(4, ties) ELSE 2 END AS "limit" FROM (SELECT item, count(*) FILTER (abs(confidence - m) <= 0.01) AS ties FROM (SELECT *, max(confidence) OVER (PARTITION BY item) AS m FROM ({_CAND})) GROUP BY item)""")
def tie_limits(t):
    """How many candidates tie with the best, and the room that makes (ops W6; the tie rule of O10)."""
    return candidates.close_ties(_candidates(t))


@query(f"""WITH c AS ({_CAND}), s AS (SELECT item, max(CASE WHEN platform <> 'other' AND confidence >= 0.6 THEN confidence END) AS best, count(*) FILTER (platform <> 'other' AND confidence >= 0.6) AS n, list(confidence ORDER BY confidence DESC) AS l FROM c GROUP BY item)
SELECT item, coalesce(best >= 0.72, false) OR n >= 2 AS skip_fallback, l[1] >= 0.88 AND l[1] - coalesce(l[2], 0.0) >= 0.12 AND coalesce(l[2], 0.0) <= 0.45 AS skip_synthesis FROM s""")
def stage_skips(t):
    """Stages that an item's records make needless (op R10)."""
    return candidates.skips(_candidates(t).select("item", F.lit("u").alias("url"), "platform", F.col("confidence").alias("score")))


@query(f"""WITH c AS ({_CAND}) SELECT item, pos, round(confidence + exactness + CASE pos % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.03 + 0.02 + 0.06 ELSE -0.03 - 0.02 + 0.02 END + CASE WHEN pos % 2 = 0 THEN -0.08 ELSE 0.0 END + CASE WHEN pos % 2 = 0 THEN 0.04 ELSE -0.28 END, 4) AS total,
round(exactness + CASE pos % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.06 + 0.04 + 0.06 ELSE -0.08 - 0.05 + 0.02 END + CASE WHEN pos % 2 = 0 THEN 0.04 ELSE -0.28 END, 4) AS exact, greatest(0.0, least(0.99, least(1.0, confidence) * 0.7 + CASE WHEN exactness = 0 THEN 0.5 ELSE exactness END * 0.2 + CASE WHEN pos % 2 = 0 THEN 0.08 ELSE 0.0 END)) AS record_confidence,
CASE WHEN confidence < 0.45 THEN 'not_found' WHEN pos % 2 = 0 THEN 'partial' WHEN pos % 3 = 0 THEN 'partial' ELSE 'succeeded' END AS status FROM c""")
def candidate_keys(t):
    """What candidates are ordered by, records put in shape, their confidence, and an item's status (ops O6, A19, R12, R16)."""
    odd, third = F.col("pos") % 2, F.col("pos") % 3
    title = F.when(odd == 0, "Full remaster").otherwise("II. Adagio")
    seconds = F.when(third == 1, 100).when(third == 2, 0)
    keys = candidates.sort_keys(F.col("confidence"), F.col("exactness"), matching.packaging(title, F.lit(""), F.lit("http://u"), third != 0, F.lit(False)), seconds, F.when(third == 1, "Me").otherwise(" "), F.when(third == 1, 9000).otherwise(600), title)
    raw = _candidates(t).select("*", F.lit(" u ").alias("url"), F.lit("t").alias("title"), (F.col("exactness") * F.when(F.col("exactness") > 0.01, 100).otherwise(1)).alias("weight"), F.col("confidence").alias("score"), F.lit(-1).alias("seconds"), F.lit(None).cast("long").alias("views"))
    shaped = candidates.normalized_records(raw)
    confidence = rules.record_confidence(F.col("score"), F.col("weight"), F.when(odd == 0, "high-quality").otherwise("search"))
    status = rules.result_status(F.col("confidence"), odd != 0, F.lit(True), F.when(third == 0, F.array(F.lit("label"))).otherwise(F.array().cast("array<string>")))
    return shaped.select("item", "pos", keys["total"].alias("total"), keys["exact"].alias("exact"), confidence.alias("record_confidence"), status.alias("status"))


_IMAGE = {
    "src": "concat('https://img.example/', p_partkey, CASE WHEN p_size % 9 = 4 THEN '/favicon.ico' ELSE '.jpg' END)", "source": "concat('http://x/', CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '-') WHEN p_size % 7 = 2 THEN 'sprite' ELSE p_type END)",
    "kind": "CASE p_partkey % 7 WHEN 0 THEN 'wikimedia-commons' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'official-site' WHEN 3 THEN 'wikipedia' WHEN 4 THEN 'streaming' ELSE p_brand END", "credit": "CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END",
    "title": "CASE p_size % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_type, ' logo') WHEN 2 THEN concat('a sample of ', p_type) WHEN 3 THEN concat('logos', p_type) ELSE p_type END",
    "width": "CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey * 37 % 2400 END", "height": "p_size * 40",
}
_WRONG = r"(^|[^a-z])(logo|icon|badge|brand|site\s*logo|baike[-_ ]?logo|baidubaike|baidu[-_ ]?baike|baidu[-_ ]?logo|bd[-_ ]?logo|favicon|placeholder|sprite|default[-_ ]?image|no[-_ ]?image|wordmark|signature|autograph|watermark)([^a-z]|$)"


@query(f"""WITH t AS (SELECT p_partkey, p_name, {", ".join(f"{e} AS {n}" for n, e in _IMAGE.items())} FROM part), m AS (SELECT *, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h, regexp_matches(lower(concat_ws(' ', src, source, credit, title)), '{_WRONG}') AS wrong FROM t),
s AS (SELECT *, CASE kind WHEN 'wikimedia-commons' THEN 24 WHEN 'wikipedia' THEN 18 WHEN 'wikidata' THEN 18 WHEN 'streaming' THEN 16 WHEN 'official-site' THEN 14 ELSE 4 END + CASE WHEN contains(lower(source), replace(lower(p_name), ' ', '-')) OR contains(lower(title), lower(p_name)) THEN 8 ELSE 0 END
  + least(least(w, h) / 40, 40.0::DOUBLE) + CASE WHEN credit <> '' THEN 4 ELSE 0 END - CASE WHEN w > 0 AND h > 0 THEN abs(1 - w / h) * 25 ELSE 18.0::DOUBLE END - CASE WHEN regexp_matches(lower(concat_ws(' ', title, source)), 'watermark|sample|sprite') THEN 16 ELSE 0 END - CASE WHEN wrong THEN 48 ELSE 0 END AS total FROM m)
SELECT p_partkey, wrong AS is_suspicious, greatest(0::DOUBLE, total) AS score, CAST(row_number() OVER (PARTITION BY p_name ORDER BY greatest(0::DOUBLE, total) DESC, p_partkey) AS INTEGER) AS rank FROM s""")
def image_scores(t):
    """Scores of image candidates, those that look wrong, and the order of a name's candidates (ops K7, O7, P17)."""
    i = t("part").select("p_partkey", "p_name", *(F.expr(e).alias(n) for n, e in _IMAGE.items()))
    scored = i.select("p_partkey", "p_name", images.is_suspicious(F.col("src"), F.col("source"), F.col("credit"), F.col("title")).alias("is_suspicious"), images.score(F.col("p_name"), F.col("src"), F.col("source"), F.col("kind"), F.col("credit"), F.col("title"), F.col("width"), F.col("height")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("p_name").orderBy(F.desc("score"), "p_partkey"))).drop("p_name")


@query("""SELECT page_id, replace(trim(regexp_extract(html, '<title>([^<]+)</title>', 1)), '&amp;', '&') AS title, 'Kim' AS site, 'a b' AS uploader, CAST(page_id % 50 * 60 + 7 AS INTEGER) AS seconds, CAST(page_id * 3 AS BIGINT) AS views, 'https://www.youtube.com/watch?v=v' || page_id || ',https://www.youtube.com/watch?v=w' AS links,
'http://example.org/' || page_id AS target, '{"a":{"b":[1,2],"c":"}"},"z":' || page_id || '}' AS embedded, 'a' || page_id || '.png' AS image FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)""")
def page_fields(t):
    """Fields, links and embedded JSON of pages (ops U4, U5, U6)."""
    i = F.col("page_id").cast("string")
    put = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    made = put(
        F.coalesce("html", F.lit("")), '<meta content="Kim" property="og:site"><img src="data:x"><img alt=1 src=\'a', i, '.png\'>"author":"a b","duration":"PT', ((F.col("page_id") % 50)).cast("string"), 'M7S","viewCount":"', (F.col("page_id") * 3).cast("string"),
        '","videoRenderer":{"x":1,"videoId":"v', i, '"},"videoRenderer":{"videoId":"w"} state = {"z": ', i, ', "a": {"c": "}", "b": [1, 2]}};',
    )
    link = put("https://www.bing.com/ck/a?x=1&u=a1", F.regexp_replace(F.base64(F.concat(F.lit("http://example.org/"), i).cast("binary")), "=+$", ""), "&n=1")
    return t("pages").select(
        "page_id", pages.title(F.col("html")).alias("title"), pages.meta(made, "og:site").alias("site"), pages.uploader(made).alias("uploader"), pages.seconds(made).alias("seconds"), pages.views(made).alias("views"),
        F.array_join(pages.video_links(made), ",").alias("links"), pages.redirect_target(link).alias("target"), pages.object_after(made, "state =").alias("embedded"), pages.first_image(made).alias("image"),
    )


@query("""SELECT event_id, '{"a":[{"x":1,"y":' || k || '}],"k":' || k || '}' AS canonical, '{"a":[{"x":1,"y":' || k || '},{"b":"' || event_type || '"}],"k":' || k || '}' AS patched, CASE event_type WHEN 'error' THEN 'merge' WHEN 'view' THEN 'nothing-to-write,high-risk' WHEN 'click' THEN 'high-risk' ELSE '' END AS blockers
FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""")
def patched_json(t):
    """Canonical JSON, a path set in it, and what keeps a proposal from being applied (ops U8, P21, P20)."""
    document = F.concat(F.regexp_replace("props", "}$", ""), F.lit(', "a": [ {"y": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit(', "x": 1} ]}'))
    kind, risk = F.when(F.col("event_type") == "error", "merge").otherwise("update"), F.when(F.col("event_type").isin("view", "click"), "high").otherwise("low")
    return t("events").select(
        "event_id", pages.canonical_json(document).alias("canonical"), proposals.set_path(document, F.lit("a[1].b"), F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("patched"),
        F.array_join(proposals.blockers(kind, risk, F.when(F.col("event_type") == "view", 0).otherwise(1)), ",").alias("blockers"),
    )


@query("""WITH f AS (SELECT l_orderkey, 'p' || (l_partkey % 3) AS path, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS after FROM lineitem GROUP BY ALL), r AS (SELECT l_orderkey, max(l_suppkey % 3) AS r, string_agg(DISTINCT l_shipmode_, ',' ORDER BY l_shipmode_) AS sources FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY l_orderkey)
SELECT f.l_orderkey, string_agg(path || '=' || after, ',' ORDER BY path) AS fields, ['low', 'medium', 'high'][CAST(r AS INTEGER) + 1] AS risk, sources FROM f JOIN r USING (l_orderkey) GROUP BY ALL""")
def merged_proposals(t):
    """Proposals of one entity come to one: the first value of each path, all sources, the highest risk (op A29)."""
    lines = t("lineitem").select(
        "l_orderkey", (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_suppkey")).alias("pos"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("path"), F.col("l_suppkey").cast("string").alias("after"),
        F.col("l_returnflag").alias("source"), F.element_at(F.array(*map(F.lit, proposals.RISKS)), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("risk"),
    )
    out = proposals.merged(lines, ["l_orderkey"])
    shown = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("l_orderkey", shown.alias("fields"), "risk", F.array_join(F.array_sort("sources"), ",").alias("sources"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/site/a/' || page_id WHEN 1 THEN 'https://x/' ELSE '/site/b' END AS path, CASE page_id % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'apple_music' ELSE 'other' END AS platform FROM pages""")
def site_paths(t):
    """Paths under a site's base, and platforms of search results (ops U9, U2)."""
    k, i = F.col("page_id") % 3, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("//a/").substr(F.lit(2), F.lit(9)), i)).when(k == 1, "https://x/").otherwise("b")
    url = F.when(k == 0, "https://YOUTU.be/x").when(k == 1, "https://music.apple.com/").otherwise(F.lit(None))
    return t("pages").select("page_id", pages.with_base(F.lit("site/"), path).alias("path"), pages.result_platform(url).alias("platform"))
