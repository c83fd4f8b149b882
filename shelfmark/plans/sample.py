"""A library made from the relational tables, as DataFrames and as SQL: suppliers are people, nations composers, parts works, orders recordings.

Both forms give the same rows; they hold the cases that the catalogue's rules ask for (placeholders, missing names and years, aliases in
chains and cycles, unlinked credits, unknown keys, composite names, links of every kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CREDIT = "struct<role:string,personId:string,displayName:string,label:string>"
_LINK = "struct<platform:string,url:string,localPath:string,title:string,linkType:string,visibility:string>"


def _from(t, table: str, *expressions: str) -> DataFrame:
    return t(table).selectExpr(*expressions)


def people(t) -> DataFrame:
    return t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left").selectExpr(
        "concat('p', s_suppkey) AS id",
        "CASE WHEN s_suppkey % 10 = 1 THEN concat('group-currently-', s_suppkey) ELSE concat('person-', s_suppkey) END AS slug",
        "CASE WHEN s_suppkey % 23 = 5 THEN 'Unknown' WHEN s_suppkey % 10 = 6 THEN concat('Radio / Choir (', s_suppkey, ')') WHEN s_suppkey % 3 = 0 THEN concat('指挥家', s_suppkey) ELSE concat('Maestro ', s_suppkey) END AS name",
        "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('Anna von Maestro', s_suppkey) END AS nameLatin",
        "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE n_name END AS country",
        "CASE WHEN s_suppkey % 4 = 0 THEN array() ELSE array(n_name) END AS countries",
        "CAST(1800 + s_suppkey % 100 AS INT) AS birthYear",
        "CAST(CASE WHEN s_suppkey % 13 = 0 THEN 1790 ELSE 1880 END + s_suppkey % 100 AS INT) AS deathYear",
        "CASE WHEN s_suppkey % 3 = 0 THEN array(concat('MS', s_suppkey), concat('家', s_suppkey)) WHEN s_suppkey % 3 = 1 THEN array(concat('大师', s_suppkey, '世')) ELSE array() END AS aliases",
        "CASE s_suppkey % 5 WHEN 0 THEN array('conductor') WHEN 1 THEN array('orchestra') WHEN 2 THEN array('soloist') WHEN 3 THEN array('singer', 'composer') ELSE array('ensemble') END AS roles",
        "CASE WHEN s_suppkey % 6 = 0 THEN '暂无简介' WHEN s_suppkey % 6 = 1 THEN '' ELSE concat('about ', s_suppkey) END AS summary",
        "lpad(CAST(s_suppkey * 10 AS STRING), 8, '0') AS sortKey",
    )


def composers(t) -> DataFrame:
    return _from(
        t, "nation", "concat('c', n_nationkey) AS id", "concat('composer-', n_nationkey) AS slug",
        "CASE WHEN n_nationkey % 9 = 4 THEN '-' WHEN n_nationkey % 2 = 0 THEN concat('作曲家', n_nationkey) ELSE n_name END AS name",
        "CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS nameLatin", "CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE 'X' END AS country",
        "CASE WHEN n_nationkey % 4 = 1 THEN array() ELSE array('X') END AS countries", "CAST(NULL AS INT) AS birthYear", "CAST(NULL AS INT) AS deathYear",
        "CASE WHEN n_nationkey % 3 = 0 THEN array(concat('曲', n_nationkey)) ELSE array() END AS aliases", "array('composer') AS roles", "'' AS summary",
        "lpad(CAST(n_nationkey AS STRING), 4, '0') AS sortKey",
    )


def work_groups(t) -> DataFrame:
    """Two levels a composer; every third second level is there twice."""
    each = "CASE k WHEN 0 THEN array('协奏曲') WHEN 1 THEN array('协奏曲', '钢琴协奏曲') ELSE array('协奏曲', '钢琴协奏曲') END"
    return t("nation").selectExpr("n_nationkey", "explode(CASE WHEN n_nationkey % 3 = 0 THEN array(0, 1, 2) ELSE array(0, 1) END) AS k").selectExpr(
        "concat('g', n_nationkey, '-', k) AS id", "concat('c', n_nationkey) AS composerId", f"element_at({each}, -1) AS title", "concat('g', k) AS slug", f"{each} AS path", "lpad(CAST(k AS STRING), 4, '0') AS sortKey",
    )


def works(t) -> DataFrame:
    return _from(
        t, "part", "concat('w', p_partkey) AS id", "concat('c', CASE WHEN p_partkey % 31 = 7 THEN 99 ELSE p_partkey % 20 END) AS composerId",
        "CASE WHEN p_partkey % 4 = 0 THEN array() WHEN p_partkey % 4 = 3 THEN array(concat('g', p_partkey % 20, '-0')) ELSE array(concat('g', p_partkey % 20, '-0'), concat('g', p_partkey % 20, '-', CASE WHEN p_partkey % 20 % 3 = 0 AND p_partkey % 4 = 2 THEN 2 ELSE 1 END)) END AS groupIds",
        "concat('w-', p_partkey) AS slug",
        "concat(p_name, CASE p_size % 5 WHEN 0 THEN ' Piano Concerto' WHEN 1 THEN ' 交响曲' WHEN 2 THEN ' String Quartet' WHEN 3 THEN ' Requiem Mass' ELSE '' END) AS title",
        "concat(p_type, CASE WHEN p_partkey % 2 = 0 THEN concat(', Op. ', p_size) ELSE '' END) AS titleLatin", "array(p_brand) AS aliases", "concat('Op. ', p_size) AS catalogue",
        "CASE WHEN p_partkey % 7 = 0 THEN 'what ????' WHEN p_partkey % 7 = 1 THEN '' ELSE p_type END AS summary", "lpad(CAST(p_partkey * 10 AS STRING), 8, '0') AS sortKey",
        "concat('2024-01-', lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0')) AS updatedAt",
    )


_WHO = "o_orderkey % 10 + 1"


def recordings(t) -> DataFrame:
    credit = lambda role, person, name, label="''": f"named_struct('role', '{role}', 'personId', {person}, 'displayName', {name}, 'label', {label})"
    return _from(
        t, "orders", "concat('r', o_orderkey) AS id", "CASE WHEN o_orderkey % 29 = 0 THEN 'w0' ELSE concat('w', o_custkey) END AS workId", "concat('r-', o_orderkey) AS slug",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('Stored - ', o_orderkey) ELSE concat('Stored ', o_orderkey) END AS title",
        "CASE o_orderkey % 6 WHEN 0 THEN 'concerto' WHEN 1 THEN 'Orchestral ' WHEN 2 THEN 'opera_vocal' WHEN 3 THEN 'chamber_solo' WHEN 4 THEN '' ELSE 'other' END AS workTypeHint",
        "lpad(CAST(o_orderkey AS STRING), 10, '0') AS sortKey", "o_orderkey % 11 = 0 AS isPrimaryRecommendation", "date_format(o_orderdate, 'yyyy-MM-dd') AS updatedAt",
        f"""CASE o_orderkey % 4
            WHEN 0 THEN array({credit('conductor', f"concat('p', {_WHO})", "'Con Ductor'")}, {credit('orchestra', "'p6'", "'Radio Orchestra'", "'live'")}, {credit('soloist', f"concat('p', {_WHO})", "'Con Ductor'")})
            WHEN 1 THEN array({credit('soloist', "'p7'", "'So Loist'")}, {credit('instrumentalist', "''", "'Pia Nist'")}, {credit('soloist', "'p7'", "'So Loist'")})
            WHEN 2 THEN array({credit('singer', "'p8'", "'Sin Ger'")}, {credit('ensemble', "'p4'", "'En Semble'")}, {credit('conductor', "'p999'", "'-'")})
            ELSE array({credit('chorus', f"concat('p', {_WHO})", "'Radio Choir'")}) END AS credits""",
        f"""array(
            named_struct('platform', CASE WHEN o_orderkey % 3 = 0 THEN 'youtube' ELSE '' END, 'url', concat('https://www.bilibili.com/video/', o_orderkey), 'localPath', '', 'title', concat(' T', o_orderkey), 'linkType', '', 'visibility', ''),
            named_struct('platform', 'other', 'url', CASE WHEN o_orderkey % 5 = 0 THEN 'ftp://x' ELSE '' END, 'localPath', concat('/a b/', o_orderkey), 'title', 'http://t', 'linkType', '', 'visibility', CASE WHEN o_orderkey % 2 = 0 THEN 'local-only' ELSE 'x' END),
            named_struct('platform', 'apple-music', 'url', 'https://music.apple.com/x', 'localPath', '', 'title', 'https://t', 'linkType', 'external', 'visibility', 'local-only')) AS links""",
        "CASE o_orderkey % 7 WHEN 0 THEN '*' WHEN 1 THEN 'Wien' WHEN 2 THEN '' ELSE date_format(o_orderdate, 'yyyy') END AS performanceDateText",
        "CASE o_orderkey % 8 WHEN 0 THEN '*' WHEN 1 THEN '' ELSE 'Hall' END AS venueText", "concat('note ', repeat('ab ', CAST(o_orderkey % 60 AS INT))) AS notes", "CASE WHEN o_orderkey % 9 = 0 THEN '/old/page' ELSE '' END AS legacyPath",
    )


def person_links(t) -> DataFrame:
    """Aliases of people: chains, a pair that point at each other and, of those, one that leads there."""
    return t("supplier").filter("s_suppkey % 10 IN (1, 2, 3, 4, 5)").selectExpr("concat('p', s_suppkey) AS alias", "concat('p', CASE s_suppkey % 10 WHEN 5 THEN s_suppkey - 1 WHEN 4 THEN s_suppkey + 1 WHEN 3 THEN s_suppkey + 1 ELSE s_suppkey + 7 END) AS canonical")


def released(recordings: DataFrame) -> DataFrame:
    """Recordings with an album's title, now and then blank, and a label."""
    return recordings.selectExpr(
        "*", "CASE CAST(substr(id, 2) AS BIGINT) % 3 WHEN 0 THEN '' WHEN 1 THEN concat(' Album of ', workId, ' ') ELSE concat('Album ', id) END AS albumTitle",
        "CASE CAST(substr(id, 2) AS BIGINT) % 5 WHEN 0 THEN '' ELSE concat('Label ', CAST(substr(id, 2) AS BIGINT) % 40) END AS label",
    )


def articles(t) -> DataFrame:
    """Documents as articles: the first line is the title, language and source the summary, the whole text the markdown."""
    return _from(
        t, "documents", "concat('a', doc_id) AS id", "concat('article-', doc_id) AS slug", "coalesce(nullif(trim(substr(split_part(text, '\n', 1), 1, 60)), ''), concat('Article ', doc_id)) AS title",
        "concat(coalesce(lang, ''), ' / ', coalesce(source, '')) AS summary", "coalesce(text, '') AS markdown",
    )


def library(t) -> dict[str, DataFrame]:
    return {"composers": composers(t), "people": people(t), "workGroups": work_groups(t), "works": works(t), "recordings": recordings(t)}


def _credit(role: str, person: str, name: str, label: str = "''") -> str:
    return f"{{'role': '{role}', 'personId': {person}, 'displayName': {name}, 'label': {label}}}"


_WHO_SQL = f"'p' || ({_WHO})"
#: The same as common table expressions of DuckDB.
WITH = f"""WITH RECURSIVE
people AS (SELECT 'p' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 1 THEN 'group-currently-' || s_suppkey ELSE 'person-' || s_suppkey END AS slug,
  CASE WHEN s_suppkey % 23 = 5 THEN 'Unknown' WHEN s_suppkey % 10 = 6 THEN 'Radio / Choir (' || s_suppkey || ')' WHEN s_suppkey % 3 = 0 THEN '指挥家' || s_suppkey ELSE 'Maestro ' || s_suppkey END AS name,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Anna von Maestro' || s_suppkey END AS "nameLatin", CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE n_name END AS country,
  CASE WHEN s_suppkey % 4 = 0 THEN []::VARCHAR[] ELSE [n_name] END AS countries, CAST(1800 + s_suppkey % 100 AS INTEGER) AS "birthYear",
  CAST(CASE WHEN s_suppkey % 13 = 0 THEN 1790 ELSE 1880 END + s_suppkey % 100 AS INTEGER) AS "deathYear",
  CASE WHEN s_suppkey % 3 = 0 THEN ['MS' || s_suppkey, '家' || s_suppkey] WHEN s_suppkey % 3 = 1 THEN ['大师' || s_suppkey || '世'] ELSE []::VARCHAR[] END AS aliases,
  CASE s_suppkey % 5 WHEN 0 THEN ['conductor'] WHEN 1 THEN ['orchestra'] WHEN 2 THEN ['soloist'] WHEN 3 THEN ['singer', 'composer'] ELSE ['ensemble'] END AS roles,
  CASE WHEN s_suppkey % 6 = 0 THEN '暂无简介' WHEN s_suppkey % 6 = 1 THEN '' ELSE 'about ' || s_suppkey END AS summary, lpad(CAST(s_suppkey * 10 AS VARCHAR), 8, '0') AS "sortKey"
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
composers AS (SELECT 'c' || n_nationkey AS id, 'composer-' || n_nationkey AS slug, CASE WHEN n_nationkey % 9 = 4 THEN '-' WHEN n_nationkey % 2 = 0 THEN '作曲家' || n_nationkey ELSE n_name END AS name,
  CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS "nameLatin", CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE 'X' END AS country, CASE WHEN n_nationkey % 4 = 1 THEN []::VARCHAR[] ELSE ['X'] END AS countries,
  CASE WHEN n_nationkey % 3 = 0 THEN ['曲' || n_nationkey] ELSE []::VARCHAR[] END AS aliases, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS "sortKey" FROM nation),
work_groups AS (SELECT 'g' || n_nationkey || '-' || k AS id, 'c' || n_nationkey AS "composerId", path[-1] AS title, 'g' || k AS slug, path, lpad(CAST(k AS VARCHAR), 4, '0') AS "sortKey"
  FROM (SELECT n_nationkey, k, CASE k WHEN 0 THEN ['协奏曲'] ELSE ['协奏曲', '钢琴协奏曲'] END AS path FROM (SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 3 = 0 THEN [0, 1, 2] ELSE [0, 1] END) AS k FROM nation))),
works AS (SELECT 'w' || p_partkey AS id, 'c' || CASE WHEN p_partkey % 31 = 7 THEN 99 ELSE p_partkey % 20 END AS "composerId",
  CASE WHEN p_partkey % 4 = 0 THEN []::VARCHAR[] WHEN p_partkey % 4 = 3 THEN ['g' || (p_partkey % 20) || '-0'] ELSE ['g' || (p_partkey % 20) || '-0', 'g' || (p_partkey % 20) || '-' || CASE WHEN p_partkey % 20 % 3 = 0 AND p_partkey % 4 = 2 THEN 2 ELSE 1 END] END AS "groupIds",
  'w-' || p_partkey AS slug, p_name || CASE p_size % 5 WHEN 0 THEN ' Piano Concerto' WHEN 1 THEN ' 交响曲' WHEN 2 THEN ' String Quartet' WHEN 3 THEN ' Requiem Mass' ELSE '' END AS title,
  p_type || CASE WHEN p_partkey % 2 = 0 THEN ', Op. ' || p_size ELSE '' END AS "titleLatin", [p_brand] AS aliases, 'Op. ' || p_size AS catalogue,
  CASE WHEN p_partkey % 7 = 0 THEN 'what ????' WHEN p_partkey % 7 = 1 THEN '' ELSE p_type END AS summary, lpad(CAST(p_partkey * 10 AS VARCHAR), 8, '0') AS "sortKey",
  '2024-01-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') AS "updatedAt" FROM part),
recordings AS (SELECT 'r' || o_orderkey AS id, CASE WHEN o_orderkey % 29 = 0 THEN 'w0' ELSE 'w' || o_custkey END AS "workId", 'r-' || o_orderkey AS slug, CASE WHEN o_orderkey % 3 = 0 THEN 'Stored - ' ELSE 'Stored ' END || o_orderkey AS title,
  CASE o_orderkey % 6 WHEN 0 THEN 'concerto' WHEN 1 THEN 'Orchestral ' WHEN 2 THEN 'opera_vocal' WHEN 3 THEN 'chamber_solo' WHEN 4 THEN '' ELSE 'other' END AS "workTypeHint", lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS "sortKey",
  o_orderkey % 11 = 0 AS "isPrimaryRecommendation", strftime(o_orderdate, '%Y-%m-%d') AS "updatedAt",
  CASE o_orderkey % 4 WHEN 0 THEN [{_credit('conductor', _WHO_SQL, "'Con Ductor'")}, {_credit('orchestra', "'p6'", "'Radio Orchestra'", "'live'")}, {_credit('soloist', _WHO_SQL, "'Con Ductor'")}]
    WHEN 1 THEN [{_credit('soloist', "'p7'", "'So Loist'")}, {_credit('instrumentalist', "''", "'Pia Nist'")}, {_credit('soloist', "'p7'", "'So Loist'")}]
    WHEN 2 THEN [{_credit('singer', "'p8'", "'Sin Ger'")}, {_credit('ensemble', "'p4'", "'En Semble'")}, {_credit('conductor', "'p999'", "'-'")}]
    ELSE [{_credit('chorus', _WHO_SQL, "'Radio Choir'")}] END AS credits,
  [{{'platform': CASE WHEN o_orderkey % 3 = 0 THEN 'youtube' ELSE '' END, 'url': 'https://www.bilibili.com/video/' || o_orderkey, 'localPath': '', 'title': ' T' || o_orderkey, 'linkType': '', 'visibility': ''}},
   {{'platform': 'other', 'url': CASE WHEN o_orderkey % 5 = 0 THEN 'ftp://x' ELSE '' END, 'localPath': '/a b/' || o_orderkey, 'title': 'http://t', 'linkType': '', 'visibility': CASE WHEN o_orderkey % 2 = 0 THEN 'local-only' ELSE 'x' END}},
   {{'platform': 'apple-music', 'url': 'https://music.apple.com/x', 'localPath': '', 'title': 'https://t', 'linkType': 'external', 'visibility': 'local-only'}}] AS links,
  CASE o_orderkey % 7 WHEN 0 THEN '*' WHEN 1 THEN 'Wien' WHEN 2 THEN '' ELSE strftime(o_orderdate, '%Y') END AS "performanceDateText", CASE o_orderkey % 8 WHEN 0 THEN '*' WHEN 1 THEN '' ELSE 'Hall' END AS "venueText",
  'note ' || repeat('ab ', CAST(o_orderkey % 60 AS INTEGER)) AS notes, CASE WHEN o_orderkey % 9 = 0 THEN '/old/page' ELSE '' END AS "legacyPath" FROM orders),
person_links AS (SELECT 'p' || s_suppkey AS alias, 'p' || CASE s_suppkey % 10 WHEN 5 THEN s_suppkey - 1 WHEN 4 THEN s_suppkey + 1 WHEN 3 THEN s_suppkey + 1 ELSE s_suppkey + 7 END AS canonical FROM supplier WHERE s_suppkey % 10 IN (1, 2, 3, 4, 5)),
walk AS (SELECT alias, canonical AS node, [alias] AS seen FROM person_links UNION ALL SELECT w.alias, l.canonical, list_append(w.seen, w.node) FROM walk w JOIN person_links l ON l.alias = w.node AND NOT list_contains(w.seen, w.node)),
canonical AS (SELECT alias, arg_max(node, len(seen)) AS canonical FROM walk GROUP BY alias)"""
#: released and articles as common table expressions; recordings and documents are there.
RELEASED = """released AS (SELECT id, CASE CAST(substr(id, 2) AS BIGINT) % 3 WHEN 0 THEN '' WHEN 1 THEN ' Album of ' || "workId" || ' ' ELSE 'Album ' || id END AS "albumTitle",
  CASE CAST(substr(id, 2) AS BIGINT) % 5 WHEN 0 THEN '' ELSE 'Label ' || (CAST(substr(id, 2) AS BIGINT) % 40) END AS label FROM recordings)"""
ARTICLES = """articles AS (SELECT 'a' || doc_id AS id, 'article-' || doc_id AS slug, coalesce(nullif(trim(substr(split_part(text, chr(10), 1), 1, 60)), ''), 'Article ' || doc_id) AS title,
  coalesce(lang, '') || ' / ' || coalesce(source, '') AS summary, coalesce(text, '') AS markdown FROM documents)"""
