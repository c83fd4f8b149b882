"""Named catalogue queries over the relational tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import dates
from shelfmark.functions import text as T
from shelfmark.operators import audit, batch, evidence, hierarchy, jobs, keyed, resolve, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


@query("""SELECT o.o_orderkey, o.o_custkey, coalesce(c.c_name, 'unknown') AS customer, coalesce(n.n_name, 'unknown') AS nation, strftime(o.o_orderdate, '%Y-%m-%d') AS updated
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE r = 1""")
def latest_per_parent(t):
    """One row per parent, the latest, with names (ops W1, J2)."""
    last = t("orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("o")).select("o_custkey", "o.*")
    named = last.join(t("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select("o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("unknown")).alias("customer"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), day("o_orderdate").alias("updated"))


@query("""WITH h AS (SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('2024-01-15:' || c_custkey, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS hash FROM customer)
SELECT c_custkey, hash FROM h ORDER BY hash, c_custkey LIMIT 12""")
def daily_picks(t):
    """A day's top k by hash of day and id (op O5)."""
    return t("customer").select("c_custkey", T.fnv1a(F.concat(F.lit("2024-01-15:"), F.col("c_custkey").cast("string"))).alias("hash")).orderBy("hash", "c_custkey").limit(12)


@query("""SELECT 'order.customer' AS rule, CAST(o_orderkey AS VARCHAR) AS entity_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
UNION ALL SELECT 'line.part', l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'order.key', CAST(o_orderkey AS VARCHAR) FROM orders GROUP BY o_orderkey HAVING count(*) > 1""")
def fk_violations(t):
    """Referential and key violations (ops J7, G13); a seventh of the customers counts as missing."""
    customers = t("customer").filter("c_custkey % 7 <> 0")
    return audit.union([
        audit.missing_parents(t("orders"), ["o_orderkey"], "o_custkey", customers, "c_custkey", "order.customer"),
        audit.missing_parents(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", t("part"), "p_partkey", "line.part"),
        audit.duplicate_keys(t("orders"), "o_orderkey", "order.key"),
    ])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 300000)")
def unused_parents(t):
    """Parents without children of a kind (op J7)."""
    orders = t("orders").filter("o_orderpriority = '1-URGENT' OR o_totalprice > 300000")
    return audit.unused_parents(t("customer"), "c_custkey", orders, "o_custkey").select("c_custkey", "c_name")


# chains of up to nine links; 400 more in one chain; pairs that point at each other, and aliases that lead to them
_LINKS = """SELECT p_partkey AS alias, CASE WHEN p_partkey <= 400 AND p_partkey < (SELECT max(p_partkey) FROM part) THEN p_partkey + 1 WHEN p_partkey % 10 = 9 THEN p_partkey - 9 WHEN p_partkey % 10 = 6 THEN p_partkey - 1 ELSE p_partkey + 1 END AS canonical
FROM part WHERE (p_partkey <= 400 AND p_partkey < (SELECT max(p_partkey) FROM part)) OR p_partkey % 10 IN (1, 2, 3, 4, 5, 6, 9) OR p_partkey % 30 = 8"""


@query(f"""WITH RECURSIVE l AS ({_LINKS}), walk(alias, node, seen) AS (SELECT alias, canonical, [alias] FROM l
UNION ALL SELECT w.alias, l.canonical, list_append(w.seen, w.node) FROM walk w JOIN l ON l.alias = w.node WHERE NOT list_contains(w.seen, w.node))
SELECT alias, arg_max(node, len(seen)) AS canonical FROM walk GROUP BY alias""")
def alias_closure(t):
    """Follows alias links to their end, or to the first node that is met again (op J4)."""
    p, last = F.col("p_partkey"), t("part").agg(F.max("p_partkey").alias("last"))
    rows, chain = t("part").join(F.broadcast(last)), (p <= 400) & (p < F.col("last"))
    links = rows.filter(chain | (p % 10).isin(1, 2, 3, 4, 5, 6, 9) | (p % 30 == 8))
    return resolve.alias_closure(links.select(p.alias("alias"), F.when(chain, p + 1).when(p % 10 == 9, p - 9).when(p % 10 == 6, p - 1).otherwise(p + 1).alias("canonical")))


@query("""SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def issue_facets(t):
    """Independent counts in one pass (ops A5, A23)."""
    return audit.facets(t("orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = n_nationkey GROUP BY n_name")
def zero_filled_counts(t):
    """Counts with zeros for absent categories (op A6)."""
    facts = t("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return audit.zero_filled(t("nation").select("n_nationkey", "n_name"), "n_nationkey", facts).select("n_name", "n")


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def nested_relationship(t):
    """Nation, customers, orders, grouped bottom up (ops A2, A3, A12, A13)."""
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    held = t("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return held.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"))


@query("""WITH p AS (SELECT r_name AS a, n_name AS b, s_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT a AS node, NULL AS parent, a AS label, 1 AS depth, count(*) AS leaves FROM p GROUP BY a
UNION ALL SELECT a || '/' || b, a, b, 2, count(*) FROM p GROUP BY a, b UNION ALL SELECT a || '/' || b || '/' || c, a || '/' || b, c, 3, count(*) FROM p GROUP BY a, b, c""")
def tree_nodes(t):
    """All nodes of a hierarchy from its leaves' paths (ops A4, G1, G2)."""
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return hierarchy.path_nodes(s, F.array("r_name", "n_name", "s_name"))


@query("""SELECT section, decade, count(*) AS n, min(p_name) AS first_name FROM (SELECT CASE WHEN upper(substr(trim(p_name), 1, 1)) BETWEEN 'A' AND 'Z' THEN upper(substr(trim(p_name), 1, 1)) ELSE '#' END AS section,
CAST(floor(p_size / 10) * 10 AS BIGINT) AS decade, p_name FROM part WHERE p_size <> 0) GROUP BY section, decade""")
def directory_sections(t):
    """Directory rows by initial and decade (ops O4, P9, N4)."""
    return t("part").filter("p_size <> 0").select(search.section(F.col("p_name")).alias("section"), T.decade(F.col("p_size")).alias("decade"), "p_name").groupBy("section", "decade").agg(F.count("*").alias("n"), F.min("p_name").alias("first_name"))


_POOL = """SELECT 'part' AS kind, p_partkey AS id, p_name AS label, [lower(p_name), lower(p_brand), lower(p_type)] AS pool FROM part
UNION ALL SELECT 'supplier', s_suppkey, s_name, [lower(s_name)] FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, [lower(c_name), lower(c_mktsegment)] FROM customer"""


def _pool(t):
    low = lambda *c: F.array(*[F.lower(F.col(x)) for x in c])
    return audit.union([
        t("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), low("p_name", "p_brand", "p_type").alias("pool")),
        t("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), low("s_name").alias("pool")),
        t("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), low("c_name", "c_mktsegment").alias("pool")),
    ])


_HIT = "len(list_filter(pool, lambda p: contains(p, 'er'))) > 0 AND len(list_filter(pool, lambda p: contains(p, '00'))) > 0"


@query(f"SELECT kind, id, label FROM ({_POOL}) WHERE {_HIT}")
def token_search(t):
    """Every token in some text of a row (ops R1, R2)."""
    return _pool(t).filter(search.matches(F.col("pool"), ["er", "00"])).select("kind", "id", "label")


@query(f"""SELECT kind, id, kind_rank, CAST(position AS INTEGER) AS position, pages, CAST(ceil(position / 10.0) AS BIGINT) AS page FROM (SELECT kind, id, CAST(list_position(['supplier', 'customer', 'part'], kind) AS BIGINT) AS kind_rank,
row_number() OVER (PARTITION BY kind ORDER BY label, id) AS position, CAST(ceil(count(*) OVER (PARTITION BY kind) / 10.0) AS BIGINT) AS pages FROM ({_POOL}) WHERE {_HIT})""")
def search_pages(t):
    """Every hit with its page within its kind (ops W2; R3 without the rule for later pages)."""
    hits = _pool(t).filter(search.matches(F.col("pool"), ["er", "00"]))
    return search.pages_by_kind(hits, ["supplier", "customer", "part"], ["label", "id"], 10).select("kind", "id", "kind_rank", "position", "pages", "page")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), 'a') ORDER BY p_name, p_partkey LIMIT 100")
def owner_search(t):
    """A query's text anywhere in the joined text, the first 100 (ops R4, O13)."""
    return t("part").filter(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand")), F.lit("a"))).orderBy("p_name", "p_partkey").limit(100).select("p_partkey", "p_name")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def first_wins_dedupe(t):
    """The first row of each text (ops D1, W10)."""
    return t("documents").groupBy(F.col("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY lower(event_type) ORDER BY event_id) AS r FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS event_type FROM events)) WHERE r = 1")
def ci_dedupe(t):
    """First of each value whatever its case (ops D2)."""
    e = t("events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"))
    return keyed.fold_case(e, "event_type", ["event_id"])


@query("SELECT user_id, min(event_id) AS first_pos, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins_dedupe(t):
    """First position, last value (ops D3, J21)."""
    return keyed.last_wins(t("events"), "user_id", "event_type", F.col("event_id"))


@query("""WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS rank FROM events),
u AS (SELECT event_type, user_id, min(rank) AS rank FROM r GROUP BY ALL)
SELECT user_id, count(*) AS occurrences, CAST(min(rank) AS INTEGER) AS best_rank, round(list_reduce(list_prepend(0.0::DOUBLE, list_sort(list(1.0::DOUBLE / (10 + rank + 1)))), lambda a, x: a + x), 9) AS score FROM u WHERE rank < 200 GROUP BY user_id HAVING count(*) >= 2""")
def rrf_fusion(t):
    """Reciprocal-rank fusion of one list an event type (op D7)."""
    from pyspark.sql import Window

    r = t("events").withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")) - 1)
    r = r.filter(F.col("rank") < 200)  # in the window itself: each list's head alone is sorted and sent on
    return keyed.reciprocal_rank_fusion(r.groupBy("event_type", "user_id").agg(F.min("rank").alias("rank")), "user_id", "event_type", "rank", depth=50).withColumn("score", F.round("score", 9))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS pos FROM events),
k AS (SELECT user_id, min({'late': CASE WHEN pos > 2 THEN 1 ELSE 0 END, 'pos': pos, 'event_type': event_type}) AS s FROM p GROUP BY user_id)
SELECT user_id, s.event_type AS event_type, CAST(s.late AS INTEGER) AS late, CAST(s.pos AS INTEGER) AS pos FROM k ORDER BY late, pos, event_type, user_id LIMIT 30""")
def coverage_merge(t):
    """Some of every source first, then the rest (ops D5, D8, D9, W4)."""
    return keyed.coverage_merge(t("events"), "event_type", "user_id", [F.desc("value"), F.asc("event_id")], 2, 30)


@query("""SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
WHERE rank <= CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END""")
def capped_topk(t):
    """Top rows of each key under a cap by class (a part of W3, W5, O10 and W12)."""
    cap = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "R", 2).otherwise(1)
    return keyed.top_per_key(t("lineitem"), ["l_suppkey", "l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], cap).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "rank")


@query("""WITH v AS (SELECT event_type, CAST(user_id % 50 AS BIGINT) AS item, CAST(floor(value / 50) AS BIGINT) AS bucket, count(DISTINCT user_id) AS sources, max(CAST((user_id % 100) / 100.0 AS DECIMAL(18, 6))) AS mx, CAST(sum(CAST((user_id % 100) / 100.0 AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS av FROM events GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY item, event_type ORDER BY sources DESC, mx DESC, bucket) AS r FROM v)
SELECT item, event_type, bucket, sources, CAST(mx AS DOUBLE) AS max_confidence, mx >= 0.85 OR (sources >= 2 AND av >= 0.65) AS accepted FROM b WHERE r = 1""")
def field_vote(t):
    """Votes of several sources on a field (ops A18, W7)."""
    e = t("events").select((F.col("user_id") % 50).alias("item"), "event_type", F.floor(F.col("value") / 50).alias("bucket"), "user_id")
    return evidence.field_vote(e, ["item", "event_type"], "bucket", "user_id", (F.col("user_id") % 100) / F.lit(100))


@query("""SELECT user_id, requests, failures, avg_latency, failures / requests AS failure_rate, CASE WHEN requests >= 2 AND (failures >= 1 OR avg_latency >= 2500) THEN 'degraded' WHEN requests >= 2 AND failures = 0 AND avg_latency <= 1000 THEN 'healthy' ELSE 'observing' END AS health
FROM (SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS avg_latency FROM events GROUP BY user_id)""")
def host_health(t):
    """Statistics and state of each host (op A20)."""
    return evidence.host_health(t("events"), "user_id", F.col("event_type") == "error", F.col("value"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value >= 100) AS slow, count(DISTINCT user_id) AS hosts FROM events GROUP BY 1""")
def access_report(t):
    """Events, failures, slow ones and hosts by day (ops A21, A17)."""
    return t("events").groupBy(day("ts").alias("day")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") >= 100).alias("slow"), F.count_distinct("user_id").alias("hosts"))


@query("""SELECT lang AS variant, count(*) AS evaluated, count(*) FILTER (n_chars >= 200 AND quality = 1) AS final_hit, count(*) FILTER (quality = 1) AS candidate_hit FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def hit_metrics(t):
    """Hits by variant and over all (ops R17, A22)."""
    j = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumnRenamed("lang", "variant")
    good = F.col("quality") == 1
    return evidence.hit_metrics(j, "variant", {"final_hit": (F.col("n_chars") >= 200) & good, "candidate_hit": good})


_NAME = "p_name || ' ' || p_brand || ' ' || p_type || (p_partkey % 3)"


@query(f"""WITH n AS (SELECT p_partkey AS id, {_NAME} AS name FROM part), m AS (SELECT min(id) AS id, name FROM n WHERE length(name) >= 12 GROUP BY name)
SELECT x.id AS a, y.id AS b, CAST(levenshtein(x.name, y.name) AS INTEGER) AS distance FROM m x JOIN m y ON substr(x.name, 1, 8) = substr(y.name, 1, 8) AND x.id < y.id AND abs(length(x.name) - length(y.name)) <= 2 AND levenshtein(x.name, y.name) <= 2
UNION ALL SELECT m.id, n.id, 0 FROM n JOIN m USING (name) WHERE m.id < n.id""")
def near_duplicates(t):
    """Names within two edits, met by prefix and length: classes of equal names with their members, and near pairs of classes (op F11; a part of J11 to J13)."""
    return resolve.near_names(t("part"), "p_partkey", F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type", (F.col("p_partkey") % 3).cast("string")))


@query("""WITH k AS (SELECT DISTINCT c_custkey AS id, unnest([c_mktsegment || c_nationkey, 'bal' || CAST(floor(c_acctbal / 10) AS BIGINT)]) AS k FROM customer),
g AS (SELECT k, count(*) AS n, min(id) AS target, list(id ORDER BY id) AS ids FROM k GROUP BY k HAVING count(*) > 1)
SELECT target, n, min(k) AS key FROM g GROUP BY target, n, ids""")
def merge_signatures(t):
    """Groups that share a key, each group once (ops J14, J15, G15)."""
    keys = F.array(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")), F.concat(F.lit("bal"), F.floor(F.col("c_acctbal") / 10).cast("string")))
    return resolve.merge_signatures(t("customer"), "c_custkey", keys)


@query(r"""SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS years FROM (SELECT doc_id, list_filter(y, lambda x, i: list_position(y, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, regexp_extract_all(text || ' 1987 and 2003', '\b((?:16|17|18|19|20)[0-9]{2})\b', 1) AS y FROM documents))""")
def year_extract(t):
    """Years of a text (ops N1, P15)."""
    return t("documents").select("doc_id", F.array_join(T.years(F.concat("text", F.lit(" 1987 and 2003"))), ",").alias("years"))


@query(r"""SELECT p_partkey, trim(regexp_replace(p_name || ', op. ' || p_size, '[ ,]*\b(op|kv|bwv)\.? ?[0-9]+\b', '', 'gi')) AS title, CAST(regexp_extract(p_name || ', op. ' || p_size, '\bop\.? ?([0-9]+)', 1) AS BIGINT) AS number FROM part""")
def catalogue_strip(t):
    """Catalogue marks parsed and stripped (op F9)."""
    s = F.concat("p_name", F.lit(", op. "), F.col("p_size").cast("string"))
    return t("part").select("p_partkey", F.trim(F.regexp_replace(s, r"(?i)[ ,]*\b(op|kv|bwv)\.? ?[0-9]+\b", "")).alias("title"), F.regexp_extract(s, r"\bop\.? ?([0-9]+)", 1).cast("bigint").alias("number"))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS canonical,
CASE WHEN regexp_matches(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', ''), '(^|\.)example\.com$') THEN 'example' WHEN regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '\.org$') THEN 'org' ELSE 'other' END AS platform FROM pages""")
def url_canonical(t):
    """Canonical address and platform (ops U1, U2, P10, G17)."""
    u = F.col("url")
    return t("pages").select("page_id", T.canonical_url(u).alias("canonical"), T.platform(u, [(r"(^|\.)example\.com$", "example"), (r"\.org$", "org")]).alias("platform"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS digest,
nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '') AS title FROM pages""")
def html_text(t):
    """Text with entities as they are, and title of a page (a part of U3 and U4)."""
    return t("pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"), T.title_of(F.col("html")).alias("title"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT props) AS shapes FROM events GROUP BY event_type")
def json_props(t):
    """Distinct texts of embedded JSON by type; nothing is parsed."""
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("props").alias("shapes"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'negative-balance' AS code, 'error' AS severity FROM customer WHERE c_acctbal < 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'large-balance', 'warning' FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'large-order', 'info' FROM orders WHERE o_totalprice > 400000""")
def audit_union(t):
    """The frame of rule scans, one scan a table; the library's own rules are in shelfmark.plans.library."""
    c, o = F.col("c_acctbal"), F.col("o_totalprice")
    return audit.union([
        audit.rules(t("customer"), F.col("c_custkey"), {"negative-balance": ("error", c < 0), "large-balance": ("warning", c > 9000)}),
        audit.rules(t("orders"), F.col("o_orderkey"), {"large-order": ("info", o > 400000)}),
    ])


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 3 THEN o_custkey - 1 ELSE o_custkey END AS o_custkey FROM orders""")
def merge_rewire(t):
    """Foreign keys of merged parents rewritten (ops G3, G4)."""
    k = F.col("c_custkey")
    moved = t("customer").filter(k % 5 == 3).select(k.alias("old_id"), (k - 1).alias("new_id"))
    return hierarchy.merge_rewire(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", moved)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS patched, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS before, o_orderstatus AS reverted FROM orders""")
def patch_apply_revert(t):
    """Patches applied, what their snapshots keep, and the rows after reverting them (op G12)."""
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    patched, snapshots = hierarchy.apply_patches(rows, "o_orderkey", "o_orderstatus", rows.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("after")))
    reverted = hierarchy.revert(patched, "o_orderkey", "o_orderstatus", snapshots).withColumnRenamed("o_orderstatus", "reverted")
    shown = patched.withColumnRenamed("o_orderstatus", "patched").join(snapshots.select("o_orderkey", "before"), "o_orderkey", "left")
    return shown.join(reverted, "o_orderkey").select("o_orderkey", "patched", "before", "reverted")


@query("""WITH a AS (SELECT p_partkey, 'small' AS group_name, 0::BIGINT AS used_before FROM part WHERE p_size <= 25 ORDER BY p_partkey LIMIT 5),
b AS (SELECT p.p_partkey, 'even' AS group_name, count(a.p_partkey) AS used_before FROM part p LEFT JOIN a USING (p_partkey) WHERE p.p_partkey % 2 = 0 GROUP BY p.p_partkey ORDER BY used_before, p.p_partkey LIMIT 5),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT p.p_partkey, 'any' AS group_name, count(ab.p_partkey) AS used_before FROM part p LEFT JOIN ab USING (p_partkey) GROUP BY p.p_partkey ORDER BY used_before, p.p_partkey LIMIT 5)
SELECT * FROM ab UNION ALL SELECT * FROM c""")
def fair_sample(t):
    """Groups in turn pick what was picked least (op W9)."""
    return keyed.fair_sample(t("part"), "p_partkey", {"small": F.col("p_size") <= 25, "even": F.col("p_partkey") % 2 == 0, "any": F.lit(True)}, 5, F.col("p_partkey"))


@query("""SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations""")
def ordinal_fill(t):
    """The last header carried forward (ops S8, W11)."""
    c = t("conversations").select("conv_id", "turn", "role")
    return keyed.carry_forward(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "last_user_turn").drop("role")


@query("""SELECT s_suppkey, count(*) AS n, max(l_shipdate) = (SELECT max(l_shipdate) FROM lineitem) AS is_latest FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) GROUP BY s_suppkey""")
def selection_semi(t):
    """A conjunction of optional selections through semi joins (ops P12, P13, J6)."""
    s = t("supplier").join(t("nation").filter(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi")
    last = t("lineitem").agg(F.max("l_shipdate").alias("m"))
    per = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("d"))
    return s.join(per, "s_suppkey").join(F.broadcast(last)).select("s_suppkey", "n", (F.col("d") == F.col("m")).alias("is_latest"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice - lead(o_totalprice) OVER w AS gap, first_value(o_totalprice) OVER w - o_totalprice <= 1000 AS is_close FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def close_ties(t):
    """Gap to the next and closeness to the best (ops W6, R15, A25)."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") - F.lead("o_totalprice").over(w)).alias("gap"), (F.first("o_totalprice").over(w) - F.col("o_totalprice") <= 1000).alias("is_close"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'green' WHEN p_size >= 20 THEN 'yellow' ELSE 'red' END AS zone, CASE WHEN regexp_matches(lower(p_type), 'steel') THEN 'metal' WHEN regexp_matches(lower(p_type), 'brass|copper|tin|nickel') THEN 'alloy' ELSE 'none' END AS hint FROM part""")
def zones(t):
    """Two small decision tables as columns; the library's own are in shelfmark.functions.rules."""
    k = F.lower("p_type")
    return t("part").select("p_partkey", F.when(F.col("p_size") >= 40, "green").when(F.col("p_size") >= 20, "yellow").otherwise("red").alias("zone"), F.when(k.rlike("steel"), "metal").when(k.rlike("brass|copper|tin|nickel"), "alloy").otherwise("none").alias("hint"))


@query("""SELECT c_custkey, 'c' || lpad(CAST(c_custkey * 10 AS VARCHAR), 9, '0') AS sort_key, CASE WHEN r = 1 THEN b ELSE b || '-' || r END AS slug FROM (SELECT c_custkey, lower(c_mktsegment) AS b, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS r FROM customer)""")
def unique_slugs(t):
    """Padded sort keys and suffixed slugs (ops O14, F8)."""
    n = keyed.top_per_key(t("customer").withColumn("b", F.lower("c_mktsegment")), ["b"], ["c_custkey"], F.lit(1 << 30), "r")
    return n.select("c_custkey", F.concat(F.lit("c"), F.lpad((F.col("c_custkey") * 10).cast("string"), 9, "0")).alias("sort_key"), F.when(F.col("r") == 1, F.col("b")).otherwise(F.concat("b", F.lit("-"), F.col("r").cast("string"))).alias("slug"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 60)) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS t FROM documents)""")
def excerpts(t):
    """Clipped texts (op F14)."""
    return t("documents").select("doc_id", T.excerpt(F.col("text"), 60).alias("excerpt"))


@query("""SELECT event_id, (v // 3600) || ':' || lpad(CAST((v // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(v % 60 AS VARCHAR), 2, '0') AS clock, v AS seconds FROM (SELECT event_id, event_id % 10000 AS v FROM events)""")
def durations(t):
    """Clock texts to seconds (op N8)."""
    v = F.col("event_id") % 10000
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    clock = F.concat(F.floor(v / 3600).cast("string"), F.lit(":"), two(F.floor(v / 60) % 60), F.lit(":"), two(v % 60))
    return t("events").select("event_id", clock.alias("clock")).withColumn("seconds", T.seconds_of(F.col("clock")))


@query("""SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) GROUP BY word HAVING count(*) >= 2) ORDER BY n DESC, length(word) DESC, word LIMIT 40""")
def frequent_tokens(t):
    """The most frequent tokens, counted over all rows (ops R9d, A14, A15)."""
    words = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), F.desc(F.length("word")), "word").limit(40)


@query("""SELECT n_name || '|' || s AS query, CAST(row_number() OVER (ORDER BY n_nationkey, k) AS INTEGER) AS pos FROM nation, (SELECT unnest(['live', 'studio', 'full']) AS s, unnest([1, 2, 3]) AS k)""")
def query_shapes(t):
    """Leads times shapes in order (op J25; three of the ten shapes of R7)."""
    from pyspark.sql import Window

    q = t("nation").select("n_nationkey", "n_name", F.posexplode(F.array(*map(F.lit, ["live", "studio", "full"]))).alias("k", "s"))
    return q.select(F.concat("n_name", F.lit("|"), "s").alias("query"), F.row_number().over(Window.orderBy("n_nationkey", "k")).alias("pos"))


@query("SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS final, arg_max(o_orderpriority, o_orderkey) AS last_priority FROM orders")
def global_stats(t):
    """Global counts, with the value of the last row by key (ops A1, A16, S7)."""
    return t("orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, upper(c_name) || '!' FROM customer WHERE c_custkey % 4 = 0""")
def upsert(t):
    """Rows replaced by key (op D13)."""
    c = t("customer").select("c_custkey", "c_name")
    return hierarchy.upsert(c, c.filter("c_custkey % 4 = 0").withColumn("c_name", F.concat(F.upper("c_name"), F.lit("!"))), "c_custkey")


@query("""SELECT o_orderkey, array_to_string(list(p_name ORDER BY l_linenumber, p_name), '; ') AS parts, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def ordered_children(t):
    """Children joined and listed in their order (ops J1, J8)."""
    j = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    per = j.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("x"), F.count("*").alias("lines"))
    return per.join(t("orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.array_join(F.col("x.p_name"), "; ").alias("parts"), "lines")


@query("""SELECT k AS brand, min(p) AS part FROM (SELECT p_brand || '/' || p_size || '/' || p_partkey % 7 AS k, p_type AS p FROM part) GROUP BY k HAVING count(DISTINCT p) = 1""")
def alias_lookup(t):
    """Keys of one value; ambiguous keys drop out (op J9)."""
    key = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    return resolve.unambiguous(t("part").select(key.alias("brand"), F.col("p_type").alias("part")), "brand", "part")


@query("""WITH e AS (SELECT p_brand AS k, ['conductor', 'global', 'orchestra', 'other'][CAST(p_partkey % 4 AS INTEGER) + 1] AS role, p_partkey AS id FROM part), w AS (SELECT DISTINCT p_brand AS k, CASE WHEN p_size % 2 = 0 THEN 'orchestra' ELSE 'nobody' END AS wanted FROM part)
SELECT k, wanted, arg_min(id, CASE WHEN role = wanted THEN 0 WHEN role = 'global' THEN 1 ELSE 2 END * 1000000000000 + id) AS id FROM w JOIN e USING (k) GROUP BY k, wanted""")
def role_lookup(t):
    """The entry of a key for a role: of that role, else one for all, else the first (op J10)."""
    entries = t("part").select(F.col("p_brand").alias("k"), F.element_at(F.array(*map(F.lit, ["conductor", "global", "orchestra", "other"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("role"), F.col("p_partkey").alias("id"))
    wanted = t("part").select(F.col("p_brand").alias("k"), F.when(F.col("p_size") % 2 == 0, "orchestra").otherwise("nobody").alias("wanted")).distinct()
    return resolve.by_role(wanted, entries, "k", "wanted", "role", "id")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%B, %Y') ELSE strftime(o_orderdate, '%Y') END AS date_text,
CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%m-%d') WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%m-%d') ELSE '' END AS month_days FROM orders""")
def performance_dates(t):
    """Dates in prose, Chinese and English (ops N2, N3)."""
    d = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    c = F.when(k == 0, F.concat(F.lit("现场 "), d("yyyy年M月d"), F.lit("日"))).when(k == 1, F.concat(F.lit("Live, "), d("MMM. d"), F.lit("th, "), d("yyyy"))).when(k == 2, d("MMMM yyyy")).otherwise(d("'in 'yyyy/M/d"))
    return t("orders").select("o_orderkey", dates.performance_date(c).alias("date_text"), F.array_join(dates.month_days(c), ",").alias("month_days"))


@query("SELECT c_custkey, CAST(c_custkey % 999 + 1 AS INTEGER) AS number FROM customer")
def chinese_numbers(t):
    """Chinese numerals (op N7)."""
    n = F.col("c_custkey") % 999 + 1
    digit = lambda x: F.element_at(F.array(*map(F.lit, "零一二三四五六七八九")), (x + 1).cast("int"))
    h, z, e = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    written = F.concat(F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise(""), F.when((z == 1) & (h == 0), "十").when(z > 0, F.concat(digit(z), F.lit("十"))).when((h > 0) & (e > 0), "零").otherwise(""), F.when(e > 0, digit(e)).otherwise(""))
    return t("customer").select("c_custkey", dates.chinese_number(written).alias("number"))


@query("""SELECT c_custkey, CASE WHEN k = 3 THEN NULL ELSE b END AS birth, CASE WHEN k = 3 THEN NULL ELSE b + 60 END AS death FROM (SELECT c_custkey, CAST(1600 + c_custkey % 300 AS INTEGER) AS b, c_custkey % 4 AS k FROM customer)""")
def life_spans(t):
    """Life spans at the head of prose (op N5)."""
    b = (1600 + F.col("c_custkey") % 300).cast("string")
    d, k = (1660 + F.col("c_custkey") % 300).cast("string"), F.col("c_custkey") % 4
    put = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    c = F.when(k == 0, put("Composer（", b, ", Bonn–", d, "）")).when(k == 1, put(b, "年生于维也纳，", d, "年去世。")).when(k == 2, put(b, " – ", d, ", pianist")).otherwise(put("Born in ", b))
    return t("customer").select("c_custkey", dates.life_span(c).alias("s")).select("c_custkey", "s.birth", "s.death")


@query("""SELECT p_partkey, CAST(0 AS INTEGER) AS line, p_partkey % 3 < 2 AS is_whole, p_brand || ' - ' || p_name || CASE WHEN p_partkey % 3 = 2 THEN '' ELSE ' - ' || p_size END AS title,
CASE WHEN p_partkey % 3 = 0 THEN 'a.org/' || p_partkey || ',b.org' ELSE '' END AS links, p_brand || ';x' AS lead_names FROM part""")
def batch_lines(t):
    """Lines of slots entered by hand (op F18): loose separators, a missing last slot, lists of names and links."""
    k, put = F.col("p_partkey") % 3, lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    brand, name, size, key = F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    c = F.when(k == 0, put(" ", brand, "｜", name, " — ", size, " | a.org/", key, ", b.org,b.org")).when(k == 1, put("\n", brand, "|", name, "  |", size)).otherwise(put(brand, " ~ ", name))
    out = batch.lines(t("part").select("p_partkey", c.alias("text"), F.lit("chamber_solo").alias("kind")), "text", "kind")
    lead = batch.names(F.concat(F.col("slots")[0], F.lit(" + x+ - ")))
    return out.select("p_partkey", "line", "is_whole", "title", F.array_join("links", ",").alias("links"), F.array_join(lead, ";").alias("lead_names"))


@query("""WITH j AS (SELECT o_orderkey, o_orderdate + INTERVAL 90 DAY AS deadline, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 60 DAY END AS stopped, o_orderkey % 2 = 0 AS ok FROM orders),
r AS (SELECT j.*, CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'N' THEN 'partial' ELSE 'failed' END AS status, l_shipdate <= least(deadline, coalesce(stopped, deadline)) AS timely FROM j JOIN lineitem ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (timely) AS a, count(*) FILTER (timely AND status = 'succeeded') AS g, count(*) FILTER (timely AND status <> 'failed') AS s FROM r GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(a, 0) AS accepted, CASE WHEN coalesce(n, 0) = 0 THEN 'failed' WHEN a < n AND stopped IS NOT NULL THEN 'canceled' WHEN a < n THEN 'timed_out' WHEN g = a THEN 'succeeded' WHEN ok AND s > 0 THEN 'partial' ELSE 'failed' END AS state FROM j LEFT JOIN c USING (o_orderkey)""")
def job_states(t):
    """Jobs' final states; late results are discarded (op T2): orders are jobs, their lines results."""
    later = lambda n: F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAYS")
    work = t("orders").select("o_orderkey", later(90).alias("deadline"), F.when(F.col("o_orderkey") % 5 == 0, later(60)).alias("stopped_at"), (F.col("o_orderkey") % 2 == 0).alias("partial_ok"))
    status = F.when(F.col("l_returnflag") == "A", "succeeded").when(F.col("l_returnflag") == "N", "partial").otherwise("failed")
    return jobs.final_states(work, t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), status.alias("status"), F.col("l_shipdate").alias("at")), "o_orderkey").drop("completed")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT CASE WHEN l_suppkey % 50 <> 0 THEN l_suppkey END))""")
def whole_batches(t):
    """Batches with a missing or repeated item id are rejected whole (op T4)."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_suppkey") % 50 != 0, F.col("l_suppkey")).alias("item"))
    return jobs.whole_batches(lines, "l_orderkey", "item").drop("item")


@query("""SELECT CAST(min(p_partkey // 2) AS BIGINT) AS id, arg_min(p_name, 1000000000 * (1000 - length(p_name)) + p_partkey) AS summary, ['low', 'medium', 'high'][max(p_size % 3) + 1] AS risk,
CASE WHEN bool_or(p_size % 4 = 0) THEN 'applied' WHEN bool_and(p_size % 4 < 3) THEN 'ignored' ELSE 'pending' END AS status, count(*) AS merged, max(p_partkey) AS last FROM part GROUP BY p_partkey // 4""")
def proposal_fold(t):
    """Proposals of one id or one meaning are folded (op D6): four parts hang together, through an id, a key and an id."""
    p = F.col("p_partkey")
    key = F.when(p % 4 == 0, F.concat(F.lit("a"), p)).when(p % 4 == 3, F.concat(F.lit("z"), p)).otherwise(F.concat(F.lit("m"), F.floor(p / 4)))
    rows = t("part").select(
        F.col("p_partkey").alias("row"), F.floor(p / 2).cast("long").alias("id"), key.alias("meaning"), F.col("p_name").alias("summary"),
        F.when(F.col("p_size") % 3 == 0, "low").when(F.col("p_size") % 3 == 1, "medium").otherwise("high").alias("risk"),
        F.when(F.col("p_size") % 4 == 0, "applied").when(F.col("p_size") % 4 < 3, "ignored").otherwise("pending").alias("status"),
        F.lit("unseen").alias("review"), F.array(p.cast("string")).alias("sources"),
    )
    out = jobs.fold_proposals(resolve.hang_together(rows, "row", ["id", "meaning"]), "component", "row")
    return out.select("id", "summary", "risk", "status", "merged", F.element_at("sources", -1).cast("long").alias("last"))
