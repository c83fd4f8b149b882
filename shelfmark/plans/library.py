"""Named queries over the sample library (shelfmark.plans.sample), each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import names, rules
from shelfmark.functions import text as T
from shelfmark.operators import display, indexes, library_audit, people

from . import sample
from .catalogue import query

_ZH = r"'[\x{3400}-\x{9fff}]'"
_ONCE = lambda x: f"list_filter({x}, lambda v, i: v <> '' AND list_position({x}, v) = i)"
# people and composers with what is shown of them
_SHOWN = lambda table: f"""SELECT *, CASE WHEN regexp_matches(name, {_ZH}) THEN name ELSE coalesce(list_filter(zh, lambda x: length(x) > length(prim) AND contains(x, prim))[1], list_filter(zh, lambda x: length(x) > length(prim))[1], name) END AS full_,
  list_filter(aliases, lambda x: regexp_matches(x, '^[A-Z0-9][A-Z0-9 .&/-]{{1,11}}$')) AS abbr FROM (
  SELECT *, coalesce(list_filter(zh, lambda x: length(x) < length(name))[1], list_filter(zh, lambda x: x <> name)[1], name) AS prim FROM (SELECT *, list_filter(aliases, lambda x: regexp_matches(x, {_ZH})) AS zh FROM {table}))"""  # noqa: E731


@query(f"""{sample.WITH}, s AS ({_SHOWN("people")}), e AS (SELECT id, prim, full_, abbr, "nameLatin" AS latin, list_concat(aliases, [name, "nameLatin"]) AS al,
  list_concat([CASE WHEN prim <> full_ THEN prim ELSE '' END, "nameLatin"], abbr) AS aside, countries FROM s), m AS (SELECT *, list_concat([prim, full_, latin], al, abbr, countries) AS tok FROM e)
SELECT id, prim AS primary_name, full_ AS full_name, latin, array_to_string({_ONCE('al')}, '|') AS aliases, array_to_string(abbr, '|') AS abbreviations, array_to_string({_ONCE('aside')}, ' / ') AS secondary_text,
  array_to_string({_ONCE('tok')}, '|') AS match_tokens, CASE WHEN prim <> full_ THEN prim ELSE '' END AS short_name, regexp_replace(trim(latin), '^.* ', '') AS surname FROM m""")
def entity_display(t):
    """What is shown of people and what they are searched by (ops P4, F10)."""
    d = names.display(F.col("name"), F.col("nameLatin"), F.col("aliases"))
    p = sample.people(t).withColumn("d", d).withColumn("s", names.search_texts(F.col("d"), F.col("countries"))).withColumn("w", names.website_display(F.col("d")))
    j = lambda c: F.array_join(c, "|")
    return p.select(
        "id", F.col("d.primary").alias("primary_name"), F.col("d.full").alias("full_name"), F.col("d.latin").alias("latin"), j("d.aliases").alias("aliases"), j("d.abbreviations").alias("abbreviations"),
        F.col("s.secondaryText").alias("secondary_text"), j("s.matchTokens").alias("match_tokens"), F.col("w.short").alias("short_name"), names.short_latin(F.col("nameLatin")).alias("surname"),
    )


# recordings with their title and what it is made of; the CTEs r_* follow the library's
_TITLES = f"""ps AS ({_SHOWN("people")}), rc AS (SELECT id, unnest(range(1, len(credits) + 1)) AS pos, unnest(credits) AS c FROM recordings),
rd AS (SELECT rc.id, pos, c.role AS role, ps.id AS pid, coalesce(ps.id, nullif(c."personId", ''), trim(regexp_replace(lower(c."displayName"), '[,.;:''"`()\\[\\]_/\\\\-]+', ' ', 'g'))) AS key, coalesce(prim, c."displayName") AS prim,
  CASE WHEN ps.id IS NULL THEN c."displayName" WHEN c.role IN ('orchestra', 'ensemble', 'chorus') THEN full_ ELSE prim END AS fulll,
  CASE WHEN ps.id IS NULL THEN c."displayName" WHEN c.role IN ('orchestra', 'ensemble', 'chorus') THEN coalesce(nullif("nameLatin", ''), full_) ELSE coalesce(nullif(regexp_replace("nameLatin", '^.* ', ''), ''), full_) END AS sec
  FROM rc LEFT JOIN ps ON ps.id = c."personId"),
rg AS (SELECT *, CASE role WHEN 'conductor' THEN 'c' WHEN 'orchestra' THEN 'o' WHEN 'ensemble' THEN 'g' WHEN 'chorus' THEN 'g' WHEN 'singer' THEN 'v' ELSE 's' END AS grp FROM rd WHERE key <> ''),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, grp, key ORDER BY pos) AS k FROM rg) WHERE k = 1),
r2 AS (SELECT * FROM r1 WHERE NOT (grp IN ('s', 'v') AND EXISTS (SELECT 1 FROM r1 x WHERE x.id = r1.id AND x.grp = 'c' AND x.key = r1.key))),
rl AS (SELECT id, grp, count(*) AS n, list(prim ORDER BY pos) AS prims, list(fulll ORDER BY pos) AS fulls, list(sec ORDER BY pos) AS secs FROM r2 GROUP BY id, grp),
rj AS (SELECT id, grp, n, array_to_string({_ONCE('prims')}, ' - ') AS p, array_to_string({_ONCE('fulls')}, ' - ') AS f, array_to_string({_ONCE('secs')}, ' - ') AS s FROM rl),
rp AS (SELECT id, {', '.join(f"coalesce(max(n) FILTER (grp = '{g}'), 0) AS n{g}, coalesce(max(p) FILTER (grp = '{g}'), '') AS p{g}, coalesce(max(f) FILTER (grp = '{g}'), '') AS f{g}, coalesce(max(s) FILTER (grp = '{g}'), '') AS s{g}" for g in 'cogsv')} FROM rj GROUP BY id),
rt AS (SELECT r.*, rp.* EXCLUDE (id), CASE WHEN lower(trim("workTypeHint")) IN ('orchestral', 'concerto', 'opera_vocal', 'chamber_solo') THEN lower(trim("workTypeHint")) ELSE 'unknown' END AS wt FROM recordings r JOIN rp USING (id)),
rf AS (SELECT *, CASE wt WHEN 'concerto' THEN 'concerto' WHEN 'opera_vocal' THEN 'opera' WHEN 'orchestral' THEN 'orchestral' WHEN 'chamber_solo' THEN CASE WHEN ng > 0 OR ns + nv > 1 THEN 'chamber' ELSE 'solo' END
  ELSE CASE WHEN nc > 0 OR no > 0 THEN 'orchestral' WHEN ng > 0 OR ns + nv > 1 THEN 'chamber' WHEN ns + nv = 1 THEN 'solo' ELSE 'unknown' END END AS family,
  coalesce(nullif("performanceDateText", ''), "venueText") AS wn, {_ONCE("[fo, fg]")} AS ens, {_ONCE("[so, sg]")} AS ens2 FROM rt),
rx AS (SELECT *, CASE WHEN family = 'concerto' THEN [pc, ps, array_to_string(ens, ' - '), wn] WHEN family = 'opera' THEN [pc, coalesce(nullif(pv, ''), ps), array_to_string(ens, ' - '), wn]
  WHEN family IN ('solo', 'chamber') THEN [coalesce(nullif(fg, ''), nullif(ps, ''), pv), "venueText", "performanceDateText"] ELSE [pc, array_to_string(ens, ' - '), wn] END AS a1,
  CASE WHEN family = 'concerto' THEN [sc, ss, array_to_string(ens2, ' - '), wn] WHEN family = 'opera' THEN [sc, coalesce(nullif(sv, ''), ss), array_to_string(ens2, ' - '), wn]
  WHEN family IN ('solo', 'chamber') THEN [coalesce(nullif(sg, ''), nullif(ss, ''), sv), "venueText", "performanceDateText"] ELSE [sc, array_to_string(ens2, ' - '), wn] END AS a2, ["performanceDateText", "venueText"] AS a3 FROM rf),
titles AS (SELECT id, family, coalesce(nullif(array_to_string({_ONCE('a1')}, ' - '), ''), nullif(trim(title), ''), '*') AS title, array_to_string({_ONCE('a2')}, ' - ') AS sub, array_to_string({_ONCE('a3')}, ' 路 ') AS meta_text, trim(notes) AS nt FROM rx)"""


@query(f"""{sample.WITH}, {_TITLES} SELECT id, family, title, coalesce(nullif(sub, ''), nullif(meta_text, ''), title) AS subtitle, meta_text, CASE WHEN length(nt) > 120 THEN trim(substr(nt, 1, 120)) || '…' ELSE nt END AS note_excerpt FROM titles""")
def recording_display(t):
    """Titles of recordings by family, from the people of their credits (ops P5, P6, J3)."""
    return display.recording_displays(sample.recordings(t), sample.people(t))


_COUNTS = """len(list_filter(credits, lambda c: c.role = 'conductor')) AS c, len(list_filter(credits, lambda c: c.role = 'orchestra')) AS o, len(list_filter(credits, lambda c: c.role IN ('soloist', 'instrumentalist'))) AS s,
len(list_filter(credits, lambda c: c.role = 'singer')) AS v, len(list_filter(credits, lambda c: c.role IN ('ensemble', 'chorus'))) AS g"""
_FAMILY = """CASE lower(trim("workTypeHint")) WHEN 'concerto' THEN 'concerto' WHEN 'opera_vocal' THEN 'opera' WHEN 'orchestral' THEN 'orchestral' WHEN 'chamber_solo' THEN CASE WHEN g > 0 OR s + v > 1 THEN 'chamber' ELSE 'solo' END
ELSE CASE WHEN c > 0 OR o > 0 THEN 'orchestral' WHEN g > 0 OR s + v > 1 THEN 'chamber' WHEN s + v = 1 THEN 'solo' ELSE 'unknown' END END"""
_MISSING = """array_to_string(list_filter([CASE WHEN f IN ('orchestral', 'opera') AND c = 0 THEN 'conductor' END, CASE WHEN f = 'concerto' AND s + v = 0 THEN 'soloist' END, CASE WHEN f = 'opera' AND s + v = 0 THEN 'singer_or_soloist' END,
CASE WHEN f IN ('orchestral', 'concerto', 'opera') AND o + g = 0 THEN 'orchestra_or_ensemble' END, CASE WHEN f = 'solo' AND s + v + o + g = 0 THEN 'soloist' END,
CASE WHEN f = 'chamber' AND o + g = 0 AND s + v < 2 THEN 'ensemble_or_multiple_soloists' END], lambda x: x IS NOT NULL), ',')"""


@query(f"""{sample.WITH}, n AS (SELECT id, "workTypeHint", {_COUNTS} FROM recordings), f AS (SELECT *, {_FAMILY} AS f FROM n)
SELECT id, CAST(c AS INTEGER) AS conductors, CAST(s AS INTEGER) AS soloists, f AS family, {_MISSING} AS missing FROM f""")
def missing_roles(t):
    """Credits counted by role, the family that follows, and the roles that are missing for it (ops A7, A8, P6)."""
    n = sample.recordings(t).withColumn("n", rules.count_roles(F.col("credits"))).withColumn("family", rules.family(F.col("workTypeHint"), F.col("n")))
    return n.select("id", "n.conductors", "n.soloists", "family", F.array_join(rules.missing_roles(F.col("family"), F.col("n")), ",").alias("missing"))


@query(f"""{sample.WITH}, x AS (SELECT w.id, lower(w.title || ' ' || w."titleLatin" || coalesce(' ' || string_agg(g.title || ' ' || array_to_string(g.path, ' '), ' ' ORDER BY g.id), '')) AS t FROM works w LEFT JOIN work_groups g ON list_contains(w."groupIds", g.id) GROUP BY w.id, w.title, w."titleLatin")
SELECT id, CASE WHEN regexp_matches(t, '协奏曲|concerto|concertante') THEN 'concerto' WHEN regexp_matches(t, '歌剧|声乐|清唱剧|弥撒|安魂曲|opera|vocal|oratorio|mass|requiem|cantata') THEN 'opera_vocal'
WHEN regexp_matches(t, '奏鸣曲|重奏|室内乐|独奏|无伴奏|变奏曲|sonata|quartet|quintet|trio|duo|chamber|solo|partita') THEN 'chamber_solo' WHEN regexp_matches(t, '交响|序曲|管弦|舞剧|芭蕾|组曲|symphon|orchestral|tone poem|overture|ballet|suite') THEN 'orchestral' ELSE 'unknown' END AS kind FROM x""")
def work_types(t):
    """The kind of a work by its titles and its groups (ops P7, J8, J16)."""
    groups = sample.works(t).select("id", F.explode("groupIds").alias("g")).join(sample.work_groups(t).select(F.col("id").alias("g"), "title", "path"), "g")
    texts = groups.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", F.concat(F.array("title"), F.col("path")).alias("x")))), lambda v: v["x"])).alias("more"))
    w = sample.works(t).join(texts, "id", "left")
    return w.select("id", rules.resolved_work_type(F.lit(""), F.concat(F.array("title", "titleLatin"), F.coalesce("more", names.none()))).alias("kind"))


@query(f"""{sample.WITH} SELECT id, CASE WHEN contains(title, 'Concerto') THEN '协奏曲/钢琴协奏曲' WHEN contains(title, 'Requiem') THEN '歌剧与声乐/安魂曲' WHEN contains(title, '交响曲') THEN '交响曲' WHEN contains(title, 'Quartet') THEN '室内乐与独奏/四重奏' ELSE '' END AS path,
CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN regexp_replace("titleLatin", ', Op. [0-9]+$', '') ELSE "titleLatin" END AS bare_title, title || ' / ' || CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN regexp_replace("titleLatin", ', Op. [0-9]+$', '') ELSE "titleLatin" END || ' / ' || catalogue AS search_title FROM works""")
def work_group_paths(t):
    """Groups of a work by its title; catalogue marks taken from the end of titles (ops P8, F9)."""
    bare = names.without_catalogue(F.col("titleLatin"), F.col("catalogue"))
    return sample.works(t).select("id", F.array_join(rules.group_path(F.concat_ws(" ", "title", bare, "catalogue")), "/").alias("path"), bare.alias("bare_title"), F.array_join(names.distinct(F.array("title", bare, "catalogue")), " / ").alias("search_title"))


@query(f"""{sample.WITH}, l AS (SELECT id, unnest(range(1, 4)) AS pos, unnest(links) AS l FROM recordings),
n AS (SELECT id, pos, CASE WHEN l.platform = '' THEN 'other' ELSE l.platform END AS platform, l.url AS url, l."localPath" AS path, trim(l.title) AS title, CASE WHEN l."linkType" = '' AND l.url = '' AND l."localPath" <> '' THEN 'local' ELSE 'external' END AS kind, CASE l.visibility WHEN 'local-only' THEN 'local-only' ELSE 'public' END AS vis FROM l)
SELECT id, pos - 1 AS pos, platform, kind, vis AS visibility, CASE WHEN kind = 'local' THEN '/__local-resource?path=' || replace(replace(path, '/', '%2F'), ' ', '+') ELSE url END AS href,
CASE platform WHEN 'youtube' THEN 'YouTube' WHEN 'apple-music' THEN 'Apple Music' ELSE '其他资源' END AS label, kind = 'external' AND vis = 'public' AND url <> '' AS on_site,
CASE WHEN kind = 'local' THEN '' WHEN NOT regexp_matches(url, '^https?://') THEN 'invalid-url' ELSE concat_ws(',', CASE WHEN platform = 'youtube' AND contains(url, 'bilibili') THEN 'platform-mismatch' END, CASE WHEN regexp_matches(title, '^https?://') THEN 'title-looks-like-url' END) END AS issues FROM n""")
def resource_links(t):
    """Links read, told by type, judged for the site and checked (ops P2, P10, S6, G17, U2)."""
    each = sample.recordings(t).select("id", F.posexplode("links").alias("pos", "l")).withColumn("l", rules.read_link(F.col("l")))
    return each.select(
        "id", F.col("pos").cast("bigint").alias("pos"), "l.platform", F.col("l.linkType").alias("kind"), "l.visibility", rules.link_href(F.col("l")).alias("href"), rules.platform_label(F.col("l.platform")).alias("label"),
        rules.is_renderable(F.col("l"), with_local=False).alias("on_site"), F.array_join(rules.link_issues(F.col("l")), ",").alias("issues"),
    )


@query(f"""{sample.WITH}, c AS (SELECT id, '/composers/' || slug || '/' AS href, name, "nameLatin", "sortKey" FROM composers)
SELECT p.id, CASE WHEN list_contains(roles, 'conductor') THEN '/conductors/' WHEN list_contains(roles, 'orchestra') THEN '/orchestras/' ELSE '/people/' END || slug || '/' AS href,
CASE p.roles[1] WHEN 'conductor' THEN 'primary' WHEN 'orchestra' THEN 'ensemble' WHEN 'ensemble' THEN 'ensemble' WHEN 'soloist' THEN 'secondary' ELSE 'secondary' END AS opera_part,
CASE p.roles[1] WHEN 'soloist' THEN 'primary' WHEN 'orchestra' THEN 'ensemble' WHEN 'ensemble' THEN 'ensemble' ELSE 'secondary' END AS concerto_part, CASE p.roles[1] WHEN 'soloist' THEN 'primary' WHEN 'orchestra' THEN 'ensemble' WHEN 'ensemble' THEN 'ensemble' ELSE 'secondary' END AS chamber_part,
CASE p.roles[1] WHEN 'conductor' THEN 'primary' WHEN 'orchestra' THEN 'ensemble' WHEN 'ensemble' THEN 'ensemble' ELSE 'secondary' END AS other_part FROM people p""")
def credit_parts(t):
    """Addresses by role, and the part that a role plays in each kind of work (ops P18, P19)."""
    part = lambda kind: rules.credit_bucket(F.lit(kind), F.col("roles")[0]).alias(f"{kind.split('_')[0] or 'other'}_part")
    return sample.people(t).select("id", rules.person_href(F.col("roles"), F.col("slug")).alias("href"), part("opera_vocal"), part("concerto"), part("chamber_solo"), part(""))


@query(f"""{sample.WITH} SELECT id, CASE WHEN country <> '' THEN 3 ELSE 0 END + CASE WHEN summary <> '' THEN 4 ELSE 0 END + least(len(aliases), 6) + CASE WHEN "nameLatin" <> '' THEN 3 ELSE 0 END AS quality,
name = 'Unknown' AS is_placeholder, contains(name, ' / ') AND (list_contains(roles, 'orchestra') OR list_contains(roles, 'ensemble')) AS is_composite, contains(slug, 'currently') AND (list_contains(roles, 'orchestra') OR list_contains(roles, 'ensemble')) AS is_polluted,
NOT (list_contains(roles, 'orchestra') OR list_contains(roles, 'ensemble')) AND country = '' AND summary = '' AND len(aliases) <= 1 AND name <> 'Unknown' AS is_thin FROM people""")
def person_rules(t):
    """Placeholders, composite and polluted groups, thin entries, and how much is known of a person (ops P11, K5, F3)."""
    p = sample.people(t)
    q = names.quality({c: F.col(c) for c in p.columns})
    return p.select(
        "id", q.cast("bigint").alias("quality"), names.is_placeholder_person(F.col("id"), F.col("name")).alias("is_placeholder"), names.is_composite(F.col("name"), F.col("roles")).alias("is_composite"),
        names.is_polluted(F.col("slug"), F.col("roles")).alias("is_polluted"), people.is_thin(p, False).alias("is_thin"),
    )


_KEY = lambda c: f"regexp_replace(lower({c}), '[\\s''\"`,;:!?()\\[\\]{{}}_/\\\\|&-]+', '', 'g')"


@query(f"""{sample.WITH}, c AS (SELECT DISTINCT c.role AS role, c."displayName" AS dn FROM (SELECT unnest(credits) AS c FROM recordings) UNION SELECT 'conductor', 'maestro' || s_suppkey || '!' FROM supplier UNION SELECT 'soloist', 'Dear Anna-von Maestro ' || s_suppkey FROM supplier),
k AS (SELECT role, dn, {_KEY('dn')} AS t FROM c), n AS (SELECT DISTINCT id, roles, {_KEY('n')} AS key FROM (SELECT id, roles, unnest(list_concat([name, "nameLatin"], aliases)) AS n FROM people WHERE name <> 'Unknown')),
q AS (SELECT id, CASE WHEN country <> '' THEN 3 ELSE 0 END + CASE WHEN summary <> '' THEN 4 ELSE 0 END + least(len(aliases), 6) + CASE WHEN "nameLatin" <> '' THEN 3 ELSE 0 END AS quality FROM people),
m AS (SELECT role, dn, n.id, max(CASE WHEN key = t THEN 100 + length(t) WHEN role NOT IN ('orchestra', 'ensemble', 'chorus') AND length(t) >= 5 AND (contains(key, t) OR contains(t, key)) THEN 10 + least(length(key), length(t)) ELSE 0 END) AS score
  FROM k JOIN n ON key <> '' WHERE t NOT IN ('', '-', 'unknown') AND CASE WHEN role IN ('orchestra', 'ensemble') THEN list_has_any(roles, ['orchestra', 'ensemble', 'chorus']) WHEN role = 'chorus' THEN list_has_any(roles, ['chorus', 'ensemble']) WHEN role = 'conductor' THEN list_contains(roles, 'conductor') WHEN role = 'singer' THEN list_contains(roles, 'singer') ELSE list_has_any(roles, ['soloist', 'instrumentalist']) END GROUP BY role, dn, n.id),
r AS (SELECT m.*, row_number() OVER w AS r, lead(score) OVER w AS second FROM m JOIN q USING (id) WHERE score > 0 WINDOW w AS (PARTITION BY role, dn ORDER BY CASE WHEN role IN ('orchestra', 'ensemble', 'chorus') THEN 0 ELSE -score END, quality DESC, id))
SELECT role, dn AS "displayName", id AS person FROM r WHERE r = 1 AND (role IN ('orchestra', 'ensemble', 'chorus') OR second IS NULL OR second < score)""")
def credit_persons(t):
    """The person that a credit's name means, by score; equal best scores mean nobody (ops J11, K5)."""
    own = sample.recordings(t).select(F.explode("credits").alias("c")).select("c.role", "c.displayName")
    s = t("supplier")
    made = s.select(F.lit("conductor").alias("role"), F.concat(F.lit("maestro"), F.col("s_suppkey").cast("string"), F.lit("!")).alias("displayName"))
    more = s.select(F.lit("soloist").alias("role"), F.concat(F.lit("Dear Anna-von Maestro "), F.col("s_suppkey").cast("string")).alias("displayName"))
    return people.person_for_credit(own.union(made).union(more), sample.people(t))


_SHOWN_C = _SHOWN("composers")
# what a person or a composer is found by
_SAID = """list_concat([prim, full_, "nameLatin"], aliases, [name, "nameLatin"], abbr, countries, [country])"""
_SUMMARY = "(trim(summary) IN ('', '暂无简介', '暂无简介。') OR regexp_matches(summary, '\\?{3,}'))"


@query(f"""{sample.WITH}, sp AS ({_SHOWN("people")}), sc AS ({_SHOWN_C}), named AS (SELECT 'composer' AS k, id, prim, full_, "nameLatin" AS latin FROM sc UNION ALL SELECT 'person', id, prim, full_, "nameLatin" FROM sp),
cr AS (SELECT r.id, r.title, unnest(credits) AS c FROM recordings r), cj AS (SELECT cr.*, p.id AS pid, p.roles FROM cr LEFT JOIN people p ON p.id = cr.c."personId")
SELECT k AS entity_type, id AS entity_id, 'name-normalization' AS category, k || ' ' || prim || ' missing canonical full name or latin name' AS message FROM named WHERE latin = '' OR full_ = ''
UNION ALL SELECT k, id, 'name-normalization', k || ' ' || prim || ' has no distinct short/full Chinese names' FROM named WHERE prim <> '' AND prim = full_ AND length(prim) <= 3
UNION ALL SELECT 'composer', id, 'country-missing', 'composer ' || prim || ' missing country' FROM sc WHERE country = ''
UNION ALL SELECT 'composer', id, 'relation-missing', 'composer ' || prim || ' has no linked works' FROM sc WHERE id NOT IN (SELECT "composerId" FROM works)
UNION ALL SELECT 'person', id, 'year-conflict', 'person ' || prim || ' has conflicting birth/death years' FROM sp WHERE "birthYear" > "deathYear"
UNION ALL SELECT 'person', id, 'summary-missing', 'person ' || prim || ' missing usable summary' FROM sp WHERE {_SUMMARY}
UNION ALL SELECT 'person', id, 'country-missing', 'person ' || prim || ' missing country' FROM sp WHERE country = ''
UNION ALL SELECT 'work', id, 'relation-missing', 'work ' || trim(title) || ' has no linked recordings' FROM works WHERE id NOT IN (SELECT "workId" FROM recordings)
UNION ALL SELECT 'work', id, 'summary-missing', 'work ' || trim(title) || ' missing usable summary' FROM works WHERE {_SUMMARY}
UNION ALL SELECT 'recording', id, 'relation-missing', 'recording ' || title || ' has no linked work' FROM recordings WHERE "workId" NOT IN (SELECT id FROM works)
UNION ALL SELECT 'recording', id, 'relation-missing', 'recording ' || title || ' has an unlinked ' || c.role || ' credit for ' || c."displayName" FROM cj WHERE c."personId" = ''
UNION ALL SELECT 'recording', id, 'relation-missing', 'recording ' || title || ' references a missing linked person ' || c."personId" FROM cj WHERE c."personId" <> '' AND pid IS NULL
UNION ALL SELECT 'recording', id, 'relation-mismatch', 'recording ' || title || ' links ' || c."displayName" || ' as ' || c.role || ' but person roles are ' || array_to_string(roles, '/') FROM cj WHERE pid IS NOT NULL AND NOT CASE
  WHEN c.role IN ('orchestra', 'ensemble') THEN list_has_any(roles, ['orchestra', 'ensemble', 'chorus']) WHEN c.role = 'chorus' THEN list_has_any(roles, ['chorus', 'ensemble']) WHEN c.role = 'conductor' THEN list_contains(roles, 'conductor')
  WHEN c.role = 'singer' THEN list_contains(roles, 'singer') ELSE list_has_any(roles, ['soloist', 'instrumentalist']) END""")
def library_data_issues(t):
    """Names, years, countries, summaries and relations that are missing or do not fit (op A9)."""
    return library_audit.data_issues(sample.library(t))


_REPLACED = f"""gv AS (SELECT id, trim(unnest(list_concat([name, "nameLatin", slug], aliases))) AS v FROM people WHERE list_has_any(roles, ['orchestra', 'ensemble'])),
gk AS (SELECT DISTINCT id, key FROM (SELECT id, v, {_KEY("trim(regexp_replace(regexp_replace(regexp_replace(v, '时间|地点|currently|current|chn', ' ', 'i'), '\\b[0-9]{4}\\b', ' ', 'g'), '\\s+', ' ', 'g'))")} AS key FROM gv) WHERE NOT regexp_matches(v, '^[A-Za-z0-9]{{2,6}}$') AND length(key) > 4),
gq AS (SELECT id, roles, slug, name, CASE WHEN country <> '' THEN 3 ELSE 0 END + CASE WHEN summary <> '' THEN 4 ELSE 0 END + least(len(aliases), 6) + CASE WHEN "nameLatin" <> '' THEN 3 ELSE 0 END AS q FROM people),
gm AS (SELECT DISTINCT a.id AS a, b.id AS b FROM gk a JOIN gk b ON a.id <> b.id AND (a.key = b.key OR (least(length(a.key), length(b.key)) >= 12 AND abs(length(a.key) - length(b.key)) <= 2
  AND (substr(a.key, 1, 8) = substr(b.key, 1, 8) OR contains(a.key, b.key) OR contains(b.key, a.key)) AND levenshtein(a.key, b.key) <= 2))),
gr AS (SELECT gm.a AS id, x.q AS qa, arg_max(gm.b, y.q * 100000000 - CAST(replace(gm.b, 'p', '') AS BIGINT)) AS replacement, max(y.q) AS qb FROM gm JOIN gq x ON x.id = gm.a JOIN gq y ON y.id = gm.b WHERE contains(x.slug, 'currently') AND y.name <> 'Unknown' GROUP BY ALL HAVING max(y.q) > x.q)"""


@query(f"{sample.WITH}, {_REPLACED} SELECT id, qb AS quality FROM gr")
def group_replacements(t):
    """The better entry that a poor or polluted group stands for, by shared or near names (ops J12, J13 for groups)."""
    found = people.group_replacements(sample.people(t))
    p = sample.people(t)
    q = p.select(F.col("id").alias("replacement"), names.quality({c: F.col(c) for c in p.columns}).cast("bigint").alias("quality"))
    return found.join(q, "replacement").select("id", "quality")


_AUDIT = f"""n AS (SELECT id, "workId", "workTypeHint", "legacyPath", {_COUNTS} FROM recordings), f AS (SELECT *, {_FAMILY} AS f FROM n), lack AS (SELECT *, {_MISSING} AS missing, CASE WHEN "legacyPath" <> '' THEN 'auto-fixable' ELSE 'manual-backfill' END AS hint FROM f)"""


@query(f"""{sample.WITH}, {_TITLES}, {_AUDIT}, {_REPLACED},
wt AS (SELECT w.id, lower(w.title || ' ' || w."titleLatin" || coalesce(' ' || string_agg(g.title || ' ' || array_to_string(g.path, ' '), ' '), '')) AS t FROM works w LEFT JOIN work_groups g ON list_contains(w."groupIds", g.id) GROUP BY w.id, w.title, w."titleLatin"),
wk AS (SELECT id, CASE WHEN regexp_matches(t, '协奏曲|concerto') THEN 'concerto' WHEN regexp_matches(t, '弥撒|mass|requiem') THEN 'opera_vocal' WHEN regexp_matches(t, 'quartet') THEN 'chamber_solo' WHEN regexp_matches(t, '交响') THEN 'orchestral' ELSE 'unknown' END AS k FROM wt),
rk AS (SELECT r.id, CASE WHEN lower(trim("workTypeHint")) IN ('orchestral', 'concerto', 'opera_vocal', 'chamber_solo') THEN lower(trim("workTypeHint")) ELSE 'unknown' END AS k, wk.k AS told FROM recordings r JOIN wk ON wk.id = r."workId"),
st AS (SELECT r.id, t.title, trim(regexp_replace(regexp_replace(lower(r.title), '[,.;:()\\[\\]_/-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(t.title), '[,.;:()\\[\\]_/-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM recordings r JOIN titles t USING (id) WHERE regexp_matches(r.title, '[|/-]'))
SELECT 'placeholder-entity' AS code, 'error' AS severity, 'composer' AS entity_type, id AS entity_id, name AS detail, CAST(NULL AS VARCHAR) AS hint FROM composers WHERE name = '-'
UNION ALL SELECT 'placeholder-entity', 'error', 'person', id, name, NULL FROM people WHERE name = 'Unknown'
UNION ALL SELECT 'placeholder-entity', 'error', 'recording', id, '-', NULL FROM recordings WHERE len(list_filter(credits, lambda c: c."displayName" = '-')) > 0
UNION ALL SELECT 'person-suspicious-ensemble-name', 'warning', 'person', id, name, NULL FROM people WHERE contains(name, ' / ') AND list_has_any(roles, ['orchestra', 'ensemble'])
UNION ALL SELECT 'person-polluted-group-identity', 'warning', 'person', p.id, CASE WHEN gr.id IS NULL THEN '' ELSE 'replaced' END, NULL FROM people p LEFT JOIN gr USING (id) WHERE contains(slug, 'currently') AND list_has_any(roles, ['orchestra', 'ensemble'])
UNION ALL SELECT 'recording-suspicious-metadata', 'warning', 'recording', id, d, NULL FROM (SELECT id, concat_ws('; ', CASE WHEN "performanceDateText" = '*' THEN 'performanceDateText contains placeholder ''*''' WHEN "performanceDateText" = 'Wien' AND "venueText" = '' THEN 'performanceDateText looks like venue text: Wien' END, CASE WHEN "venueText" = '*' THEN 'venueText contains placeholder ''*''' END) AS d FROM recordings) WHERE d <> ''
UNION ALL SELECT 'recording-missing-credit-role', 'error', 'recording', id, replace(missing, ',', ', '), hint FROM lack WHERE missing <> ''
UNION ALL SELECT 'recording-work-type-conflict', 'warning', 'recording', id, k || ' / ' || told, NULL FROM rk WHERE k <> 'unknown' AND told <> 'unknown' AND k <> told
UNION ALL SELECT 'recording-title-credit-mismatch', 'warning', 'recording', id, title, NULL FROM st WHERE a <> b AND a <> '' AND b <> ''""")
def library_audit_issues(t):
    """The seven scans of the library's audit (op A10)."""
    found = library_audit.audit(sample.library(t))
    return found.withColumn("detail", F.when((F.col("code") == "person-polluted-group-identity") & (F.col("detail") != ""), "replaced").otherwise(F.col("detail")))


@query(f"""{sample.WITH}, {_AUDIT} SELECT w."composerId" AS composer_id, w.id AS work_id, c.name AS composer_name, w.title AS work_title, count(*) AS item_count, array_to_string(list(l.id ORDER BY l.id), ',') AS recordings
FROM lack l JOIN works w ON w.id = l."workId" JOIN composers c ON c.id = w."composerId" WHERE l.missing <> '' AND l.hint = 'manual-backfill' GROUP BY ALL""")
def backfill_queue(t):
    """Recordings to complete by hand, by work (op A11)."""
    return library_audit.backfill_queue(sample.library(t)).withColumn("recordings", F.array_join("recordings", ","))


@query(f"""{sample.WITH}, e AS (SELECT w.id, w."composerId" AS c, unnest("groupIds") AS g FROM works w), cr AS (SELECT id, unnest(credits)."personId" AS p FROM recordings)
SELECT 'works.composerId' AS rule, id AS entity_id FROM works WHERE "composerId" NOT IN (SELECT id FROM composers) UNION ALL SELECT 'works.groupIds', e.id FROM e WHERE g NOT IN (SELECT id FROM work_groups)
UNION ALL SELECT 'works.groupIds.composer', e.id FROM e JOIN work_groups g ON g.id = e.g WHERE g."composerId" <> e.c UNION ALL SELECT 'recordings.workId', id FROM recordings WHERE "workId" NOT IN (SELECT id FROM works)
UNION ALL SELECT 'recordings.credits.personId', id FROM cr WHERE p <> '' AND p NOT IN (SELECT id FROM people)""")
def library_violations(t):
    """What makes a library invalid: repeated ids and references that lead nowhere (ops S2, G13, J7)."""
    return library_audit.violations(sample.library(t))


@query(f"""{sample.WITH}, {_TITLES.replace("FROM recordings)", "FROM moved)", 1).replace("FROM recordings r", "FROM moved r")
.replace("ps AS (", '''mc AS (SELECT id, unnest(range(1, len(credits) + 1)) AS pos, unnest(credits) AS c FROM recordings),
mm AS (SELECT mc.id, list({'role': c.role, 'personId': coalesce(k.canonical, c."personId"), 'displayName': c."displayName", 'label': c.label} ORDER BY pos) AS credits FROM mc LEFT JOIN (SELECT * FROM canonical WHERE canonical IN (SELECT id FROM people)) k ON k.alias = c."personId" GROUP BY mc.id),
moved AS (SELECT r.* EXCLUDE (credits), mm.credits FROM recordings r JOIN mm USING (id)), ps AS (''', 1)},
sp AS (SELECT *, CASE WHEN prim <> full_ THEN prim ELSE '' END AS short_ FROM ({_SHOWN("people")})), sc AS (SELECT *, CASE WHEN prim <> full_ THEN prim ELSE '' END AS short_ FROM ({_SHOWN_C})),
ca AS (SELECT p.id, coalesce(k.canonical, p.id) AS canonical FROM people p LEFT JOIN canonical k ON k.alias = p.id),
sw AS (SELECT w.*, CASE WHEN CAST(substr(w.id, 2) AS BIGINT) % 2 = 0 THEN regexp_replace("titleLatin", ', Op. [0-9]+$', '') ELSE "titleLatin" END AS bare, (SELECT coalesce(string_agg(g.title, ' / ' ORDER BY list_position(w."groupIds", g.id)), '') FROM work_groups g WHERE list_contains(w."groupIds", g.id)) AS gp FROM works w),
al AS (SELECT ca.canonical, flatten(list(list_concat([name, "nameLatin"], aliases) ORDER BY list_concat([name, "nameLatin"], aliases))) AS every FROM ca JOIN people USING (id) GROUP BY ca.canonical), {sample.RELEASED}, {sample.ARTICLES},
ix AS (SELECT 'composer' AS kind, id, full_ AS primary_text, array_to_string({_ONCE('list_concat([short_, "nameLatin"], abbr)')}, ' / ') AS secondary_text, '/composers/' || slug || '/' AS href, {_SAID} AS mt, list_concat(aliases, [name, "nameLatin"], abbr) AS ats FROM sc
UNION ALL SELECT CASE WHEN list_contains(roles, 'conductor') THEN 'conductor' WHEN list_contains(roles, 'orchestra') THEN 'orchestra' ELSE 'person' END, sp.id, full_, coalesce(nullif(array_to_string({_ONCE('list_concat([short_, "nameLatin"], abbr)')}, ' / '), ''), array_to_string(roles, ' / ')),
  CASE WHEN list_contains(roles, 'conductor') THEN '/conductors/' WHEN list_contains(roles, 'orchestra') THEN '/orchestras/' ELSE '/people/' END || slug || '/', list_concat({_SAID}, every), list_concat(aliases, [name, "nameLatin"], abbr) FROM sp JOIN al ON al.canonical = sp.id
UNION ALL SELECT 'workGroup', g.id, g.title, c.full_, '/composers/' || c.slug || '/#' || g.id, list_concat([g.title], g.path, [c.full_]), [] FROM work_groups g JOIN sc c ON c.id = g."composerId"
UNION ALL SELECT 'work', w.id, w.title || ' / ' || bare || ' / ' || catalogue, c.full_ || CASE WHEN gp <> '' THEN ' / ' || gp ELSE '' END, '/works/' || w.id || '/', list_concat([w.title, "titleLatin", catalogue], w.aliases, string_split(gp, ' / '), [c.full_]), w.aliases FROM sw w JOIN sc c ON c.id = w."composerId"
UNION ALL SELECT 'recording', r.id, t.title, w.title || coalesce(' / ' || c.full_, ''), '/recordings/' || r.id || '/', list_concat([t.title, w.title, w."titleLatin", w.catalogue, c.full_, r."performanceDateText", r."venueText", e."albumTitle", e.label],
  flatten(list_transform(list_concat(r.credits, m.credits), lambda x: [x."displayName", x.label, x."personId"]))), []
  FROM recordings r JOIN moved m ON m.id = r.id JOIN released e ON e.id = r.id JOIN titles t ON t.id = r.id JOIN works w ON w.id = r."workId" LEFT JOIN sc c ON c.id = w."composerId"
UNION ALL SELECT 'article', id, title, summary, '/columns/' || slug || '/', [title, slug, summary, markdown], [] FROM articles),
it AS (SELECT * EXCLUDE (mt, ats), list_transform(mt, lambda x: trim(coalesce(x, ''), '{T.BLANKS}')) AS mt, list_transform(ats, lambda x: trim(coalesce(x, ''), '{T.BLANKS}')) AS ats FROM ix),
io AS (SELECT * EXCLUDE (mt, ats), {_ONCE('mt')} AS mt, {_ONCE('ats')} AS ats FROM it)
SELECT kind, id, primary_text, secondary_text, href, array_to_string(mt, '|') AS match_tokens, array_to_string(ats, '|') AS alias_tokens, CAST(len(mt) AS BIGINT) AS n_tokens FROM io""")
def search_index(t):
    """Search entries of six kinds with what they are found by, people under their canonical entry (ops R1, J5)."""
    lib = sample.library(t)
    lib |= {"recordings": sample.released(lib["recordings"]), "articles": sample.articles(t)}
    out = indexes.search_index(lib, sample.person_links(t))
    return out.select(
        "kind", "id", "primary_text", "secondary_text", "href", F.array_join("match_tokens", "|").alias("match_tokens"), F.array_join("alias_tokens", "|").alias("alias_tokens"), F.size("match_tokens").cast("long").alias("n_tokens"),
    )


@query(f"""{sample.WITH}, c AS (SELECT "workId", unnest(credits)."personId" AS p FROM recordings), m AS (SELECT coalesce(k.canonical, p) AS p FROM c JOIN works w ON w.id = c."workId" JOIN composers x ON x.id = w."composerId" LEFT JOIN (SELECT * FROM canonical WHERE canonical IN (SELECT id FROM people)) k ON k.alias = c.p)
SELECT p.id AS person, (SELECT count(*) FROM m WHERE m.p = p.id) AS n FROM people p LEFT JOIN canonical k ON k.alias = p.id WHERE coalesce(k.canonical, p.id) = p.id""")
def appearances(t):
    """Credits of each canonical person (ops A2, J5)."""
    return indexes.appearances(sample.library(t), sample.person_links(t))


@query(f"""{sample.WITH}, c AS (SELECT id, "workId", unnest(credits) AS c FROM recordings), m AS (SELECT c.id, "workId", coalesce(k.canonical, c."personId") AS p FROM c LEFT JOIN (SELECT * FROM canonical WHERE canonical IN (SELECT id FROM people)) k ON k.alias = c."personId" WHERE c.role = 'conductor')
SELECT m.p AS person, w."composerId" AS composer, w.id AS work, array_to_string(list(m.id ORDER BY m.id), ',') AS recordings FROM m JOIN people p ON p.id = m.p AND list_contains(p.roles, 'conductor') JOIN works w ON w.id = m."workId" JOIN composers x ON x.id = w."composerId" GROUP BY ALL""")
def relationship_index(t):
    """Conductors, composers, works and recordings, grouped (op A3)."""
    return indexes.relationships(sample.library(t), sample.person_links(t), "conductor").withColumn("recordings", F.array_join("recordings", ","))


@query(f"""{sample.WITH}, one AS (SELECT "composerId" AS c, path, min(id) AS keep FROM work_groups GROUP BY ALL), m AS (SELECT g.id, keep FROM work_groups g JOIN one ON one.c = g."composerId" AND one.path = g.path),
e AS (SELECT w.id, m.keep, min(pos) AS pos FROM (SELECT id, unnest(range(1, len("groupIds") + 1)) AS pos, unnest("groupIds") AS g FROM works) w JOIN m ON m.id = w.g GROUP BY ALL)
SELECT 'work' AS kind, w.id, coalesce(string_agg(keep, ',' ORDER BY pos), '') AS groups FROM works w LEFT JOIN e USING (id) GROUP BY w.id UNION ALL SELECT 'group', keep, '' FROM (SELECT DISTINCT keep FROM e)""")
def normalized_groups(t):
    """Groups of one path merged, works pointed at what stays, unused groups gone (ops G3, J8)."""
    groups, works = indexes.normalized_groups(sample.work_groups(t), sample.works(t))
    return works.select(F.lit("work").alias("kind"), "id", F.array_join("groupIds", ",").alias("groups")).union(groups.select(F.lit("group"), "id", F.lit("")))


@query(f"""{sample.WITH}, w AS (SELECT DISTINCT "composerId" AS c, CASE WHEN contains(title, 'Concerto') THEN ['协奏曲', '钢琴协奏曲'] WHEN contains(title, 'Requiem') THEN ['歌剧与声乐', '安魂曲'] WHEN contains(title, '交响曲') THEN ['交响曲'] WHEN contains(title, 'Quartet') THEN ['室内乐与独奏', '四重奏'] END AS p FROM works),
x AS (SELECT DISTINCT c, p[1:i] AS p FROM (SELECT c, p, unnest(range(1, len(p) + 1)) AS i FROM w WHERE p IS NOT NULL)) SELECT c AS "composerId", array_to_string(p, '/') AS path FROM x WHERE NOT EXISTS (SELECT 1 FROM work_groups g WHERE g."composerId" = c AND g.path = p)""")
def missing_groups(t):
    """Groups that works ask for by their titles and that are not there yet, with those above them (op G2)."""
    wanted = sample.works(t).select("composerId", rules.group_path(F.col("title")).alias("path")).filter(F.size("path") > 0)
    return indexes.missing_groups(sample.work_groups(t), wanted).withColumn("path", F.array_join("path", "/"))


@query(f"""{sample.WITH} SELECT id, array_to_string(list_transform(list_filter(credits, lambda c: c."personId" NOT IN ('p7', 'p8')), lambda c: c.role || ':' || c."personId"), ',') AS credits FROM recordings""")
def unlinked_credits(t):
    """Credits of some people taken off recordings (op G6)."""
    r = sample.recordings(t)
    pairs = r.select("id", F.explode("credits.personId").alias("personId")).filter("personId IN ('p7', 'p8')")
    return indexes.unlink(r, pairs).select("id", F.array_join(F.transform("credits", lambda c: F.concat_ws(":", c["role"], c["personId"])), ",").alias("credits"))


@query(f"""{sample.WITH}, c AS (SELECT DISTINCT id, unnest(credits)."personId" AS p FROM recordings), k AS (SELECT c.id, c.p FROM c JOIN people ON people.id = c.p), m AS (SELECT r.id, r."workId" AS w FROM recordings r JOIN works ON works.id = r."workId"), o AS (SELECT w.id, w."composerId" AS c FROM works w JOIN composers x ON x.id = w."composerId")
SELECT 'recording' AS entity_type, id, 'work' AS other_type, w AS other FROM m UNION ALL SELECT 'recording', id, 'person', p FROM k UNION ALL SELECT 'work', w, 'recording', id FROM m UNION ALL SELECT 'work', id, 'composer', c FROM o UNION ALL SELECT 'person', p, 'recording', id FROM k UNION ALL SELECT 'composer', c, 'work', id FROM o""")
def entity_relations(t):
    """What each entity has to do with, one step away (op J17)."""
    return indexes.relations(sample.library(t))


@query(f"""{sample.WITH}, h AS (SELECT DISTINCT 'work' AS k, "workId" AS id, 'recording' AS b FROM recordings WHERE "workId" IN (SELECT id FROM works) UNION SELECT 'person', p, 'recording' FROM (SELECT unnest(credits)."personId" AS p FROM recordings) WHERE p IN (SELECT id FROM people)
UNION SELECT 'composer', "composerId", 'work' FROM works WHERE "composerId" IN (SELECT id FROM composers) UNION SELECT 'composer', "composerId", 'workGroup' FROM work_groups) SELECT k AS entity_type, id, string_agg(b, ',' ORDER BY b) AS held_by FROM h GROUP BY k, id""")
def delete_blockers(t):
    """Entities that something still needs (op J18)."""
    return indexes.delete_blockers(sample.library(t))


@query(f"""{sample.WITH} SELECT id, CASE CAST(substr(id, 2) AS BIGINT) % 4 WHEN 0 THEN 'conductor:' || credits[1]."personId" || ',orchestra:p6,soloist:' || credits[3]."personId" WHEN 1 THEN 'soloist:p7,instrumentalist:' WHEN 2 THEN 'singer:p8,ensemble:p4,conductor:p999' ELSE 'chorus:' || credits[1]."personId" END AS credits,
CASE CAST(substr(id, 2) AS BIGINT) % 4 WHEN 0 THEN 'orchestra=Wiener Philharmonic,chorus=Wiener choir' ELSE 'orchestra=X Orchestra & Someone' END AS parts FROM recordings""")
def credit_repair(t):
    """Credits that say the same are one; names of several groups are split by role (op D4; the order-free steps of G7)."""
    put = lambda name: F.array(F.struct(F.lit("orchestra").alias("role"), F.lit("p1").alias("personId"), F.lit(name).alias("displayName"), F.lit("").alias("label")))
    made = F.when(F.substring("id", 2, 12).cast("long") % 4 == 0, put("Wiener Philharmonic / choir")).otherwise(put("X Orchestra & Someone"))
    return sample.recordings(t).select(
        "id", F.array_join(F.transform(people.dedupe_credits(F.col("credits")), lambda c: F.concat_ws(":", c["role"], c["personId"])), ",").alias("credits"),
        F.array_join(F.transform(people.split_composite(made), lambda c: F.concat_ws("=", c["role"], c["displayName"])), ",").alias("parts"),
    )
