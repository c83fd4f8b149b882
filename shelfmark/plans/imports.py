"""Named queries of batches, retrieval requests and results, and of what changes between two states of a library, each with SQL that gives the
same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import batch_merge, differences, registry, retrieval

from . import sample
from .catalogue import query

#: Rows of the sample library that a batch's base lacks, by collection.
_NEW = {"composers": "CAST(substr(id, 2) AS INT) % 4 = 3", "people": "CAST(substr(id, 2) AS INT) % 3 = 2", "workGroups": "id LIKE '%-1'", "works": "CAST(substr(id, 2) AS INT) % 5 = 4", "recordings": "CAST(substr(id, 2) AS INT) % 10 = 7"}
_CONFIRMED = {"composers": "CAST(substr(id, 2) AS INT) % 8 = 2", "people": "CAST(substr(id, 2) AS INT) % 9 = 1", "works": "CAST(substr(id, 2) AS INT) % 20 = 9", "recordings": "CAST(substr(id, 2) AS INT) % 10 IN (3, 7)"}


def _batch(t):
    draft = sample.library(t)
    base = {k: df.filter(f"NOT ({_NEW[k]})") for k, df in draft.items()}
    confirmed = None
    for kind, wanted in _CONFIRMED.items():
        part = draft[kind].filter(wanted).select(F.lit(kind).alias("kind"), "id")
        confirmed = part if confirmed is None else confirmed.unionByName(part)
    return base, draft, confirmed


_TABLES = {"composers": "composers", "people": "people", "workGroups": "work_groups", "works": "works", "recordings": "recordings"}
_SELECTION = f"""{sample.WITH},
confirmed AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, id FROM {_TABLES[k]} WHERE {w}" for k, w in _CONFIRMED.items())}),
base AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, id FROM {_TABLES[k]} WHERE NOT ({w})" for k, w in _NEW.items())}),
from_recordings AS (SELECT DISTINCT * FROM (SELECT 'works' AS kind, "workId" AS id FROM recordings JOIN confirmed c ON c.kind = 'recordings' AND c.id = recordings.id
  UNION ALL SELECT 'people', trim(x."personId") FROM (SELECT id, unnest(credits) AS x FROM recordings) r JOIN confirmed c ON c.kind = 'recordings' AND c.id = r.id) WHERE id <> '' AND (kind, id) NOT IN (FROM base) AND (kind, id) NOT IN (FROM confirmed)),
chosen_works AS (SELECT id FROM confirmed WHERE kind = 'works' UNION SELECT id FROM from_recordings WHERE kind = 'works'),
from_works AS (SELECT DISTINCT * FROM (SELECT 'composers' AS kind, "composerId" AS id, works.id AS w FROM works UNION ALL SELECT 'workGroups', unnest("groupIds"), id FROM works) WHERE w IN (FROM chosen_works) AND id <> '' AND (kind, id) NOT IN (FROM base) AND (kind, id) NOT IN (FROM confirmed)),
selected AS (SELECT kind, id, 0 AS steps FROM confirmed UNION ALL SELECT kind, id, 1 FROM from_recordings
  UNION ALL SELECT kind, id, min(CASE WHEN w IN (SELECT id FROM confirmed WHERE kind = 'works') THEN 1 ELSE 2 END) FROM from_works GROUP BY kind, id)"""


@query(f"{_SELECTION} SELECT kind, id, CAST(steps AS INTEGER) AS steps FROM selected")
def batch_selection(t):
    """What confirmed drafts bring with them: works, composers, groups and people that the library lacks (op G11)."""
    base, draft, confirmed = _batch(t)
    return batch_merge.selection(confirmed, draft, base)


@query(f"""{_SELECTION}, had AS (SELECT kind, count(*) AS n FROM base GROUP BY kind), every AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, id FROM {_TABLES[k]}" for k in _TABLES)}),
merged AS (SELECT kind, id FROM base UNION SELECT kind, id FROM selected JOIN every USING (kind, id)) SELECT kind, count(*) AS n, count(*) - any_value(had.n) AS added, min(id) AS first_id, max(id) AS last_id FROM merged JOIN had USING (kind) GROUP BY kind""")
def batch_merged(t):
    """A library's collections after a batch (op G11): how many entries, how many of them new."""
    base, draft, confirmed = _batch(t)
    after = batch_merge.merged(base, draft, batch_merge.selection(confirmed, draft, base))
    count = lambda lib: batch_merge.ids(lib).groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return count(after).join(count(base).select("kind", F.col("n").alias("had")), "kind").select("kind", "n", (F.col("n") - F.col("had")).alias("added"), "first_id", "last_id")


@query(f"""{sample.WITH} SELECT r.id AS "itemId", r."workId", coalesce(w."composerId", '') AS "composerId", CASE WHEN o % 5 = 0 AND lower(trim(r."workTypeHint")) IN ('orchestral', 'concerto', 'opera_vocal', 'chamber_solo') THEN lower(trim(r."workTypeHint")) ELSE 'unknown' END AS "workTypeHint",
CASE WHEN o % 5 = 0 THEN trim(r.title || ' | live ') ELSE '' END AS "sourceLine", r.title, coalesce(c.name, '') AS "composerName", coalesce(c."nameLatin", '') AS "composerNameLatin", coalesce(w.title, '') AS "workTitle", coalesce(w."titleLatin", '') AS "workTitleLatin", coalesce(w.catalogue, '') AS catalogue,
r."performanceDateText", r."venueText", '' AS "albumTitle", r.notes, CAST(len(credits) AS BIGINT) AS n_credits, trim(credits[1]."displayName") AS first_credit, trim(links[1].title) AS first_link, CAST(8 AS BIGINT) AS n_fields
FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS o FROM recordings) r LEFT JOIN works w ON w.id = r."workId" LEFT JOIN composers c ON c.id = w."composerId" """)
def retrieval_requests(t):
    """Requests for all recordings, with what is known of each (op J19)."""
    lib = sample.library(t)
    overrides = lib["recordings"].filter("CAST(substr(id, 2) AS BIGINT) % 5 = 0").select("id", "workTypeHint", F.concat("title", F.lit(" | live ")).alias("sourceLine"))
    asked = retrieval.requests(lib, overrides)
    known = ("title", "composerName", "composerNameLatin", "workTitle", "workTitleLatin", "catalogue", "performanceDateText", "venueText", "albumTitle", "notes")
    return asked.select(
        "itemId", "workId", "composerId", "workTypeHint", "sourceLine", *(F.col(f"seed.{k}").alias(k) for k in known), F.size("seed.credits").cast("long").alias("n_credits"), F.get("seed.credits", 0)["displayName"].alias("first_credit"),
        F.get("seed.links", 0)["title"].alias("first_link"), F.size("requestedFields").cast("long").alias("n_fields"),
    )


def _results(t):
    """Results for recordings, and for one that there isn't: one in seven failed, some in part; values old, new, blank."""
    n = F.col("o_orderkey")
    shape = "array<struct<platform:string,url:string,title:string>>"
    link = lambda platform, url, title: F.struct(F.lit(platform).alias("platform"), url.alias("url"), F.lit(title).alias("title"))
    image = lambda src, source, by, title: F.struct(src.alias("src"), F.lit(source).alias("sourceUrl"), F.lit(by).alias("attribution"), F.lit(title).cast("string").alias("title"))
    return t("orders").select(
        F.when(n % 50 == 49, F.concat(F.lit("x"), n.cast("string"))).otherwise(F.concat(F.lit("r"), n.cast("string"))).alias("item"), F.when(n % 7 == 0, "failed").when(n % 7 == 1, "partial").otherwise("succeeded").alias("status"),
        ((n % 10) / 10).alias("confidence"), F.when(n % 3 == 0, "Hall ").when(n % 3 == 1, " ").otherwise(F.col("o_orderpriority")).alias("venueText"), F.when(n % 4 == 0, F.date_format("o_orderdate", "yyyy")).alias("performanceDateText"), F.when(n % 6 == 0, "Label A").alias("label"),
        F.when(n % 4 == 1, F.array(link("", F.concat(F.lit(" https://www.youtube.com/watch?v="), n.cast("string")), " New "), link("bilibili", F.concat(F.lit("HTTPS://www.bilibili.com/video/"), n.cast("string")), "again"))).cast(shape).alias("links"),
        F.when(n % 8 == 1, F.array(link("other", F.lit("https://a.example/"), "a"))).cast(shape).alias("link_candidates"),
        F.when(n % 9 == 4, F.array(image(F.concat(F.lit("https://i.example/"), n.cast("string")), "", " by ", None), image(F.lit(" "), "x", "", ""))).alias("images"), F.array(F.lit("w")).alias("warnings"),
    )


@query(f"""{sample.WITH}, res AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 50 = 49 THEN 'x' ELSE 'r' END || o_orderkey AS item, CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'succeeded' END AS status, (o_orderkey % 10) / 10.0 AS confidence,
  CASE o_orderkey % 3 WHEN 0 THEN 'Hall' WHEN 1 THEN '' ELSE o_orderpriority END AS venue, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y') ELSE '' END AS day, CASE WHEN o_orderkey % 6 = 0 THEN 'Label A' ELSE '' END AS label FROM orders),
met AS (SELECT res.*, r.title, r."venueText" AS v, r."performanceDateText" AS d, r.links AS l FROM res JOIN recordings r ON r.id = item WHERE status <> 'failed'),
counted AS (SELECT *, (venue <> '' AND venue <> trim(v))::INT AS a, (day <> '' AND day <> trim(d))::INT AS b, (label <> '')::INT AS c, 1 AS e, CASE WHEN o % 9 = 4 THEN 1 ELSE 0 END AS i,
  2 + (o % 5 = 0)::INT + CASE WHEN o % 4 = 1 THEN 1 ELSE 0 END AS n_new FROM met)
SELECT 'proposal-' || item AS id, CASE WHEN status = 'partial' OR confidence < 0.7 THEN 'medium' ELSE 'low' END AS risk, array_to_string(list_filter([CASE WHEN b = 1 THEN 'performanceDateText:' || d || '>' || day END, CASE WHEN a = 1 THEN 'venueText:' || v || '>' || venue END, CASE WHEN c = 1 THEN 'label:>Label A' END], lambda x: x IS NOT NULL), '|') AS changes,
CAST(n_new AS BIGINT) AS n_links_after, CAST(CASE WHEN o % 8 = 1 THEN 1 ELSE 0 END + CASE WHEN o % 4 = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_links, CASE WHEN i = 1 THEN 'https://i.example/' || o || ' https://i.example/' || o || ' by' ELSE '' END AS image FROM counted""")
def result_proposals(t):
    """What results of retrieval change in the recordings that they are for (op J20)."""
    found = retrieval.proposals(sample.recordings(t), _results(t))
    texts = F.filter("fields", lambda x: x["path"] != "links")
    links = F.filter("fields", lambda x: x["path"] == "links")
    after = F.coalesce(F.size(F.from_json(F.get(links, 0)["after"], "array<struct<url:string>>")).cast("long"), F.lit(0).cast("long"))
    image = F.get("images", 0)
    return found.select(
        "id", "risk", F.array_join(F.transform(texts, lambda x: F.concat(x["path"], F.lit(":"), x["before"], F.lit(">"), x["after"])), "|").alias("changes"), after.alias("n_links_after"), F.size("links").cast("long").alias("n_links"),
        F.coalesce(F.concat_ws(" ", image["src"], image["sourceUrl"], image["attribution"]), F.lit("")).alias("image"),
    )


def _states(t):
    p = F.col("p_partkey")
    row = lambda df: df.select(p.alias("id"), F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size"), F.array("p_brand", "p_type").alias("tags")).alias("more")).alias("part"), "p_type")
    before = row(t("part").filter(p % 13 != 5))
    changed = t("part").filter(p % 17 != 3).withColumns({"p_name": F.when(p % 5 != 0, F.col("p_name")), "p_size": F.col("p_size") + F.when(p % 7 == 0, 1).otherwise(0), "p_brand": F.when(p % 11 == 0, "Brand").otherwise(F.col("p_brand"))})
    return before, row(changed).withColumn("extra", F.when(F.col("id") % 19 == 0, "new"))


_STATES = """WITH b AS (SELECT p_partkey AS id, p_name AS name, p_size AS size, '["' || p_brand || '","' || p_type || '"]' AS tags FROM part WHERE p_partkey % 13 <> 5),
a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS size, '["' || CASE WHEN p_partkey % 11 = 0 THEN 'Brand' ELSE p_brand END || '","' || p_type || '"]' AS tags, CASE WHEN p_partkey % 19 = 0 THEN 'new' END AS extra FROM part WHERE p_partkey % 17 <> 3),
d AS (SELECT id, '' AS path, NULL AS before, NULL AS after, 'added' AS change FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, '', NULL, NULL, 'removed' FROM b WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT id, 'part.name', b.name, a.name, 'cleared' FROM b JOIN a USING (id) WHERE a.name IS NULL UNION ALL SELECT id, 'part.more.size', CAST(b.size AS VARCHAR), CAST(a.size AS VARCHAR), 'changed' FROM b JOIN a USING (id) WHERE a.size <> b.size
UNION ALL SELECT id, 'part.more.tags', b.tags, a.tags, 'changed' FROM b JOIN a USING (id) WHERE a.tags <> b.tags UNION ALL SELECT id, 'extra', NULL, extra, 'set' FROM b JOIN a USING (id) WHERE extra IS NOT NULL)"""


@query(f"{_STATES} FROM d")
def field_differences(t):
    """Every field that differs between two states of a table, with its path, and rows of one state alone (ops J20, A27)."""
    return differences.rows(*_states(t), "id")


@query(f"{_STATES} SELECT path, change, count(*) AS n FROM d GROUP BY ALL")
def difference_report(t):
    """How often each field changed (op A27)."""
    return differences.summary(differences.rows(*_states(t), "id"))


#: Entries of a registry and of a library, in both dialects: names that some, one or none of the others have.
_OLD = {"entry": "concat('r', c_custkey)", "role": "CASE WHEN c_custkey % 2 = 0 THEN 'conductor' ELSE 'soloist' END"}
_OLD_VALUES = ("concat('Name ', c_custkey % 60)", "CASE WHEN c_custkey % 4 = 0 THEN concat('name-', c_custkey % 7) ELSE concat('Own ', c_custkey) END", "CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END")
_NEW_ENTRY = {"entry": "concat('p', p_partkey)", "role": "CASE WHEN p_partkey % 3 = 0 THEN 'conductor' ELSE 'soloist' END"}
_NEW_VALUES = ("concat('NAME ', p_partkey % 50)", "concat(p_name, ' ', p_partkey)", "CASE WHEN p_partkey % 40 = 1 THEN 'Machinery' ELSE p_brand END")


def _registry(t):
    make = lambda df, head, values: df.select(*(F.expr(e).alias(n) for n, e in head.items()), F.array(*map(F.expr, values)).alias("values"))
    return make(t("customer"), _OLD, _OLD_VALUES), make(t("part").filter("p_partkey < 45 OR p_partkey % 40 = 1"), _NEW_ENTRY, _NEW_VALUES)


_EXPLODED = lambda table, head, values, where="true": f"SELECT {head['entry']} AS entry, {head['role']} AS role, unnest([0, 1, 2]) AS pos, trim(unnest([{', '.join(values)}])) AS v FROM {table} WHERE {where}"
_ROUTED = f"""WITH o AS (SELECT *, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS k FROM ({_EXPLODED("customer", _OLD, _OLD_VALUES)})), n AS (SELECT *, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS k FROM ({_EXPLODED("part", _NEW_ENTRY, _NEW_VALUES, "p_partkey < 45 OR p_partkey % 40 = 1")})),
m AS (SELECT DISTINCT o.entry, n.entry AS target FROM o JOIN n USING (role, k) WHERE k <> ''), c AS (SELECT entry, count(*) AS n, min(target) AS target FROM m GROUP BY entry),
r AS (SELECT DISTINCT o.entry, CASE WHEN c.n IS NULL THEN 'append' WHEN c.n = 1 THEN 'merge' ELSE 'ambiguous' END AS route, CASE WHEN c.n = 1 THEN c.target END AS target FROM o LEFT JOIN c USING (entry))"""


@query(f"{_ROUTED} FROM r")
def registry_routes(t):
    """Where entries of a registry go by how many entries of the library they match (op G14)."""
    return registry.routes(*_registry(t))


@query(f"""{_ROUTED}, g AS (SELECT r.target AS entry, 1 AS late, o.entry AS src, o.pos, o.v, o.k FROM o JOIN r USING (entry) WHERE route = 'merge' AND k <> '' AND (EXISTS (FROM n WHERE n.entry = r.target AND n.k = o.k) OR NOT EXISTS (FROM n WHERE n.entry <> r.target AND n.k = o.k))),
e AS (SELECT entry, 0 AS late, entry AS src, pos, v, k FROM n WHERE k <> '' UNION ALL FROM g UNION ALL SELECT o.entry, 0, o.entry, pos, v, k FROM o JOIN r USING (entry) WHERE route = 'append' AND k <> ''),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY entry, k ORDER BY late, src, pos) = 1) SELECT entry, string_agg(v, '|' ORDER BY late, src, pos) AS names FROM f GROUP BY entry""")
def registry_synced(t):
    """The registry afterwards: derived entries with what merged ones give, and those that match nothing (op G14)."""
    entries, _ = registry.synced(*_registry(t))
    return entries.select("entry", F.array_join("values", "|").alias("names"))
