"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are counted by language and source in tasks, a bounded number at a time, then by shuffle; terms in at least three of a
language's documents are kept, with their postings (source and count). Group and term give p, language and term give q (parts of 10^9, add-one
smoothed, in exact decimals), and f = (p - q)^2 div q.

Terms: a group's terms with p > q lie in buckets by count (each number below 16, quarter octaves above); the largest p and least q of a
bucket bound its f. Buckets are opened best bound first until they hold k terms, then those whose bound isn't strictly below
the k-th value: no unseen term can rank. Pairs: a term that neither or one of two sources holds adds what depends on the sources' own
counts alone, so that sum comes from histograms of counts; postings add what both hold, equal postings once with their number. All
ordered pairs of a language's sources are the result, as many rows as it has; no pairs of documents are made.

Null texts, languages and sources count as ''. Texts without terms still make their group; a language without kept terms has pairs of value 0. Repeated
rows count as often as they stand. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Different (group, term) entries that a task holds before it hands them on; bytes of a text that are split at a time.
HELD, SLICE = 300_000, 1 << 20
#: Bytes to bytes: A-Z lowered, other ASCII bytes that are no letters made blanks.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_ADDED = "lang string, source string, term string, n long, documents long"


def term_counts(text: str) -> Counter:
    """Occurrences of each term, the text split in slices that end at a blank."""
    data, found, start = text.encode().translate(_LETTERS), Counter(), 0
    while start < len(data):
        stop = len(data) if start + SLICE >= len(data) else data.find(b" ", start + SLICE)
        stop = len(data) if stop < 0 else stop
        found.update(data[start:stop].split())
        start = stop
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([documents[t] for t in part])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(common.values(batch.column(0)), common.values(batch.column(1)), common.values(batch.column(2), 64), strict=True):
            n, documents = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            found = term_counts(text)
            n.update(found)
            documents.update(found.keys())
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, total, postings (source, n) of terms in at least `least` of the language's documents. docs has lang, source, text without nulls."""
    counts = docs.select("lang", "source", "text").mapInArrow(common.frugal(_count), _ADDED)
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return terms.filter(F.col("documents") >= least).drop("documents")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + terms)), exact."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) div CAST({total} + {terms} AS DECIMAL(19, 0))")


def f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def groups_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, held (terms), n (rows of postings, as held), count (their sum), kept (the language's terms), whole (its sum), base (p of terms
    that the source lacks, null where the language keeps none). One row a group that occurs."""
    every = docs.select("lang", "source").distinct()
    own = terms.select("lang", F.explode("postings").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.count(F.lit(1)).alias("held"), F.sum("x.n").alias("count"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("whole"))
    out = every.join(own, ["lang", "source"], "left").join(langs, ["lang"], "left").fillna(0, ["held", "count", "kept", "whole"])
    return out.withColumn("n", F.col("held")).withColumn("base", F.when(F.col("kept") > 0, share("0", "count", "greatest(kept, 1)")))


def shares(terms: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """lang, source, term, n, p, q, base: a row for each posting."""
    postings = terms.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("n_term"))
    met = common.lookup(postings, groups, ["lang", "source"], total)
    return met.select("lang", "source", "term", F.col("n_term").alias("n"), share("n_term", "count", "kept").alias("p"), share("total", "whole", "kept").alias("q"), "base")


def ranked(rows: DataFrame, k: int | None = None) -> DataFrame:
    """rank by group: value descending, item ascending; of the first k only, which each task finds among its own rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = rows.withColumn("rank", rank)
    return out.filter(F.col("rank") <= k) if k else out


def top_terms(each: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of each group's k terms of largest f with p > q."""
    above = each.filter("p > q").withColumn("bucket", F.expr("CASE WHEN n < 16 THEN n ELSE CAST(floor(4 * log2(CAST(n AS DOUBLE))) AS BIGINT) END"))
    bounds = above.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count(F.lit(1)).alias("n")).withColumn("bound", F.expr(f("p", "q")))
    best = Window.partitionBy("lang", "source").orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = common.spool(bounds.drop("p", "q").withColumn("before", F.coalesce(F.sum("n").over(best), F.lit(0))))
    total = int(bounds.agg(F.sum("n")).first()[0] or 0)
    key = ["lang", "source", "bucket"]

    def opened(buckets: DataFrame) -> DataFrame:
        met = common.lookup(above.drop("n"), buckets.select(*key, "n"), key, total)
        return met.select("lang", "source", F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))

    first = common.spool(ranked(opened(bounds.filter(F.col("before") < k)), k))
    last = first.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    # groups without a k-th term have no bucket left
    more = common.spool(bounds.filter(F.col("before") >= k).join(last, ["lang", "source"]).filter("bound >= kth").drop("kth"))
    if more.isEmpty():
        return first
    return ranked(first.drop("rank").unionByName(opened(more)), k)


def pair_sums(each: DataFrame, groups: DataFrame, spread: int = 32) -> DataFrame:
    """lang, source, item (another source of the language), value: f summed over all kept terms, p of source and q of item. A language's
    sources meet in `spread` parts of one side."""
    mine = groups.select("lang", "source", "held", "kept", "base", F.pmod(F.hash("source"), F.lit(spread)).alias("part"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("held_item"), F.col("base").alias("base_item"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    pairs = mine.join(others, ["lang", "part"]).filter("source <> item")
    neither = pairs.select("lang", "source", "item", F.expr(f"CASE WHEN kept > 0 THEN (kept - held - held_item) * {f('base', 'base_item')} ELSE 0 END").alias("value"))
    # a source's own terms against every other source's p of terms that it lacks
    histogram = each.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("h"))
    met = histogram.join(pairs.filter("kept > 0").select("lang", "source", "item", "base_item"), ["lang", "source"])
    own = met.groupBy("lang", "source", "item").agg(F.expr(f"sum(h * {f('p', 'base_item')})").alias("as_source"), F.expr(f"sum(h * {f('base_item', 'p')})").alias("as_item"))
    own = common.spool(own)
    # equal postings of a language's terms, once
    lists = each.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "base"))).alias("held")).groupBy("lang", "held").agg(F.count(F.lit(1)).alias("h"))
    two = lists.filter(F.size("held") > 1).select("lang", "h", "held", F.explode("held").alias("s")).select("lang", "h", "s", F.explode("held").alias("o")).filter("s.source <> o.source")
    both = f"h * ({f('s.p', 'o.p')} - {f('s.p', 'o.base')} - {f('s.base', 'o.p')} + {f('s.base', 'o.base')})"
    both = two.groupBy("lang", F.col("s.source").alias("source"), F.col("o.source").alias("item")).agg(F.expr(f"sum({both})").alias("value"))
    swapped = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("as_item").alias("value"))
    every = neither.unionByName(own.select("lang", "source", "item", F.col("as_source").alias("value"))).unionByName(swapped).unionByName(both)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, k: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = common.spool(kept_terms(read, least))
    groups = common.spool(groups_of(read, terms))
    each = common.spool(shares(terms, groups, int(groups.agg(F.sum("held")).first()[0] or 0)))
    found = ranked(pair_sums(each, groups)).withColumn("part", F.lit("pair")).unionByName(top_terms(each, k).withColumn("part", F.lit("term")))
    return found.select("lang", "source", "part", "item", "value", "rank")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (SELECT lang, source, r, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang)
      LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT *, 1 + ({SCALE} * (n + 1)) // CAST(sum(n) OVER w + count(*) OVER w AS BIGINT) AS p,
             1 + ({SCALE} * (total + 1)) // CAST(sum(total) OVER w + count(*) OVER w AS BIGINT) AS q FROM c WINDOW w AS (PARTITION BY lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {TOP}
"""
