"""Mixing sources to target weights: a low-discrepancy schedule of equal blocks of words.

Sources, in code-point order with null last, weigh 5, 2, 1, 5, ... and share all words by weight; no target exceeds `TIMES` times its source's
words. A source's documents, in an order shuffled by digest, form a stream of words that repeats itself, cut into blocks of `block` words.
A target of w words wants ceil(w / block) slots, so slots laid end to end are the cumulative weights; the golden-ratio lattice
(consecutive Fibonacci numbers p and q: slot t has the point t * p mod q) deals them out in time, ranks number a source's slots in order of
time, and the slot of rank r takes block r. Every source takes exactly the whole words of its target.

Sources of any number, size and name go by range partitions; a source of very many documents is cut into runs by digest. Rows that
are equal in id, source and text are counted first and told apart by `copy` again, so that copies of a row never fill one task.
Null texts have no words; null sources are a source, apart from the empty name. Documents without words take none. An empty table
gives no rows. Other columns of docs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, TIMES, BLOCK = (5, 2, 1), 3, 512
#: Documents of a run at most, on average, and slots or copies that one row is expanded into.
RUN, SPAN = 50_000, 65_536


def words_of(text: str) -> Column:
    """Number of runs of characters other than blank and \\x09 to \\x0D: each becomes one letter, then the blanks go."""
    runs = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    return F.length(F.translate(runs, " \t\n\x0b\f\r", "")).cast("long")


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each distinct (doc_id, source, text): key (orders sources, null last), doc_id, size, digest, copies."""
    return (
        docs.select(
            F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1")).alias("key"), F.col(doc_id).alias("doc_id"), words_of(text).alias("size"),
            F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))).cast("binary")).alias("digest"),
        ).groupBy("key", "doc_id", "size", "digest").agg(F.count(F.lit(1)).alias("copies"))
    )


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df written in range partitions of `order`, which must be unique, with the partition's number in `part`."""
    return common.spool(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def scanned(df: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """A ranged frame with, for each name, the sum of an expression over all rows before. What meets in one task is one row a partition."""
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("part").agg(*(F.sum(F.expr(e)).alias(f"_{n}") for n, e in sums.items()))
    parts = parts.select("part", *(F.coalesce(F.sum(f"_{n}").over(across), F.lit(0)).alias(f"_{n}") for n in sums))
    rows = df.withColumns({n: F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)) for n, e in sums.items()})
    return rows.join(F.broadcast(parts), "part").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(*(f"_{n}" for n in sums))


def targets(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, source_size, target, words (whole words of the target), documents, slots and first (slots of all sources before).

    Shares above TIMES times a source's size go back to the others by weight. In order of size / weight the sources that stop are a
    prefix, so two running sums replace the rounds."""
    sized = groups.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("documents"))
    by_name = ranged(sized, "key")
    turn = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighed = scanned(by_name, ["key"], place="1").withColumn("weight", turn.cast("long")).drop("part", "place")
    # size / weight, without fractions
    lcm = 1
    for w in WEIGHTS:
        lcm *= w
    order = ["reach", "key"]
    by_reach = ranged(weighed.withColumn("reach", F.col("source_size") * F.expr(f"{lcm} div weight")), *order)
    whole = by_reach.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights = (int(x or 0) for x in whole)
    dec = lambda c: c.cast("decimal(19,0)")
    before = scanned(by_reach, order, gone=f"{TIMES} * source_size", left="weight")
    stops = dec(F.col("weight")) * dec(F.lit(total) - F.col("gone")) > dec(TIMES * F.col("source_size")) * dec(F.lit(weights) - F.col("left"))
    marked = common.spool(before.withColumn("stops", stops).drop("gone", "left"))
    stopped = marked.filter("stops").agg(F.sum(TIMES * F.col("source_size")), F.sum("weight")).first()
    total, weights = total - int(stopped[0] or 0), weights - int(stopped[1] or 0)
    share = (F.col("weight") * F.lit(total)).cast("double") / F.lit(float(max(weights, 1)))
    aimed = marked.withColumn("target", F.when(F.col("stops"), (TIMES * F.col("source_size")).cast("double")).otherwise(share))
    aimed = aimed.withColumn("words", F.floor("target")).withColumn("slots", F.expr(f"(words + {block - 1}) div {block}"))
    return scanned(aimed, order, first="slots").select("key", "source_size", "documents", "target", "words", "slots", "first")


def of_source(left: DataFrame, sources: DataFrame, total: int) -> DataFrame:
    """left's rows with their source's columns: sources of over a thousandth of all rows (below a thousand, whatever the input) are
    broadcast, the others meet their rows by shuffle."""
    large = F.col("documents") > total // 1000
    few = F.broadcast(sources.filter(large))
    return left.join(few, "key").unionByName(left.join(few.select("key"), "key", "left_anti").join(sources.filter(~large), "key"))


def before(df: DataFrame, order: list[str], value: str, digits: int) -> DataFrame:
    """df with `at`, the sum of value over the rows of its key with a smaller `digest` (further columns of order break ties). Keys are cut
    into runs by the digest's first digits; the runs' own sums are found in the same way."""
    run = F.left("digest", F.lit(digits)).alias("run")
    rows = df.withColumn("run", run) if digits else df.withColumn("run", F.lit(""))
    inside = Window.partitionBy("key", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    if not digits:
        return rows.drop("run")
    runs = df.groupBy("key", run).agg(F.sum(value).alias("sum")).withColumnRenamed("run", "digest")
    runs = before(runs, ["digest"], "sum", max(digits - 3, 0)).select("key", F.col("digest").alias("run"), F.col("at").alias("from"))
    return rows.join(runs, ["key", "run"]).withColumn("at", F.col("at") + F.col("from")).drop("run", "from")


def lattice(slots: int) -> tuple[int, int]:
    """q and the inverse of p modulo q, for the least pair of consecutive Fibonacci numbers with q >= slots: point u comes at time
    u * inverse mod q."""
    p, q = 1, 2
    while q < slots:
        p, q = q, p + q
    if q >= 1 << 41:
        raise ValueError("more than 2^40 slots: choose larger blocks")
    return q, pow(p, -1, q)


def schedule(sources: DataFrame) -> DataFrame:
    """key, time, rank: each source's slots, with their rank in order of time. Times are distinct, with gaps where the lattice has more points."""
    q, inverse = lattice(int(sources.agg(F.sum("slots")).first()[0] or 0))
    strides = sources.filter("slots > 0").select("key", "first", "slots", F.expr(f"explode(sequence(0, (slots - 1) div {SPAN}))").alias("stride"))
    points = strides.repartition("key", "stride").select("key", F.expr(f"explode(sequence(first + stride * {SPAN}, least(first + slots, first + (stride + 1) * {SPAN}) - 1))").alias("u"))
    # u * inverse mod q in two steps of at most 62 bits
    time = F.expr(f"(((u div 1048576) * {inverse}L % {q}L) * 1048576 + (u % 1048576) * {inverse}L) % {q}L")
    timed = points.select("key", time.alias("time")).withColumn("span", F.expr(f"time div {SPAN}"))
    inside = Window.partitionBy("key", "span").orderBy("time")
    spans = timed.groupBy("key", "span").count()
    spans = spans.withColumn("from", F.coalesce(F.sum("count").over(Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # hints, as Spark takes what few rows are expanded into for small and would broadcast it
    return timed.withColumn("in", F.row_number().over(inside) - 1).join(spans.drop("count").hint("merge"), ["key", "span"]).select("key", "time", (F.col("in") + F.col("from")).alias("rank"))


def placed(docs: DataFrame, block: int = BLOCK, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The distinct documents with their place in their source's stream, and the sources."""
    groups = common.spool(counted(docs, **columns))
    sources = common.spool(targets(groups, block))
    total, digits = groups.count(), 0
    while 16**digits * RUN < total:
        digits += 1
    laid = before(groups.withColumn("length", F.col("size") * F.col("copies")), ["digest", "doc_id", "size"], "length", digits)
    return common.spool(of_source(laid, sources, total)), sources


def pieces(laid: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: time, key, doc_id, digest, size, copy, pass (from 0), start (word of the document, from 0), words. Sorted by time, rank in
    the block and start, it is the training order; blocks are whole but for each source's last."""
    passes = laid.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(TIMES - 1))))
    held = passes.withColumn("begin", F.expr("at + pass * source_size")).withColumn("end", F.expr("least(begin + length, words)")).filter("begin < end")
    cut = held.withColumn("rank", F.expr(f"explode(sequence(begin div {block}, (end - 1) div {block}))"))
    cut = cut.withColumns({"lo": F.expr(f"greatest(begin, rank * {block}) - begin"), "hi": F.expr(f"least(end, (rank + 1) * {block}) - begin")})
    each = cut.withColumn("copy", F.expr("explode(sequence(lo div size, (hi - 1) div size))"))
    each = each.withColumns({"start": F.expr("greatest(lo - copy * size, 0)"), "stop": F.expr("least(hi - copy * size, size)")})
    blocks = each.select("key", "rank", "doc_id", "digest", "size", "copy", "pass", "start", (F.col("stop") - F.col("start")).alias("n"))
    return schedule(sources).hint("merge").join(blocks, ["key", "rank"]).withColumnRenamed("n", "words")


def mixed(docs: DataFrame, block: int = BLOCK, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted), a row for each of docs."""
    laid, sources = placed(docs, block, **columns)
    own = ["key", "doc_id", "digest", "size", "copy"]
    strides = laid.select("key", "doc_id", "digest", "size", "copies", "source_size", "target", F.expr(f"explode(sequence(0, (copies - 1) div {SPAN}))").alias("stride"))
    copies = strides.repartition("key", "digest", "stride").withColumn("copy", F.expr(f"explode(sequence(stride * {SPAN}, least(copies, (stride + 1) * {SPAN}) - 1))"))
    nothing = {"source_size": F.lit(None).cast("long"), "target": F.lit(None).cast("double")}
    took = pieces(laid, sources, block).select(*own, "words").withColumns(nothing)
    every = copies.select(*own, "source_size", "target", F.lit(0).cast("long").alias("words")).unionByName(took)
    sums = every.groupBy(*own).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken"))
    return sums.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', coalesce(text, ''))) AS digest FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(3 * source_size) OVER w, 0) AS gone, coalesce(sum(weight) OVER w, 0) AS lft
      FROM g WINDOW w AS (ORDER BY source_size * (10 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, weight * (total - gone) > 3 * source_size * (weights - lft) AS stops FROM r),
u AS (SELECT *, total - coalesce(sum(3 * source_size) FILTER (WHERE stops) OVER (), 0) AS rest, weights - coalesce(sum(weight) FILTER (WHERE stops) OVER (), 0) AS among FROM s),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(greatest(among, 1) AS DOUBLE) END AS target FROM u),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(pos + size, words) - pos) + greatest(0, least(pos + source_size + size, words) - pos - source_size)
       + greatest(0, least(pos + 2 * source_size + size, words) - pos - 2 * source_size) AS taken
FROM p
"""
