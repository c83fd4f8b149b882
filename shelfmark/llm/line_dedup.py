"""Line dedup over overlapping windows of consecutive lines.

Lines end at a newline. Each window of `window` lines is hashed (two 64-bit hashes over the lines) and written once; windows found
more than once anywhere are joined back to their places, and every place but the first (smallest id, then text hash, then line)
marks its lines. A window that very many places share is joined by broadcast (common.lookup). Marked lines are removed; overlapping
marks merge. Windows of blank lines alone never count, and texts of fewer lines than a window stay as they are. A very long text is
one row of many windows: its windows are rows of their own, its marks one array of line numbers.

Null texts stay null with 0 lines. Rows that repeat both id and text count as one place and get one result. Rows with a null id
come first. Other columns pass through untouched, whatever their names; n_lines and n_removed are replaced. Empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 3


def _strip(window: int):
    @F.pandas_udf("struct<text:string,n:long>")
    def strip(text: pd.Series, at: pd.Series) -> pd.DataFrame:
        kept, n = [], []
        for t, p in zip(text, at, strict=True):
            if t is None:
                kept.append(None), n.append(0)
                continue
            lines = t.split("\n")
            edge = np.zeros(len(lines) + 1, np.int64)
            np.add.at(edge, p, 1), np.add.at(edge, np.asarray(p) + window, -1)
            covered = np.cumsum(edge)[:-1] > 0
            kept.append("\n".join(x for x, c in zip(lines, covered, strict=True) if not c)), n.append(int(covered.sum()))
        return pd.DataFrame({"text": kept, "n": n})

    return strip


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with `text` stripped of repeated windows, plus n_lines and n_removed (long)."""
    docs = docs.drop("n_lines", "n_removed")
    row, at, cut, who, what = common.fresh(docs, "_row", "_at", "_cut", "_who", "_what")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), F.split("text", "\n", -1).alias("l"))
    part = lambda i, salt: F.xxhash64(F.lit(salt), *[F.get("l", i + k) for k in range(window)])
    filled = lambda i: F.trim(F.translate(F.concat_ws("", *[F.get("l", i + k) for k in range(window)]), "\t\r\x0b\x0c", "    ")) != ""
    at_each = F.transform(F.sequence(F.lit(0), F.size("l") - window), lambda i: F.struct(part(i, 1).alias("h1"), part(i, 2).alias("h2"), i.alias("at"), filled(i).alias("f")))
    windows = common.spool(
        keyed.filter(F.size("l") >= window).select("doc_id", "_row", F.explode(F.filter(at_each, lambda w: w["f"])).alias("w"))
        .select("w.h1", "w.h2", F.struct("doc_id", "_row", F.col("w.at").alias("at")).alias("place"))
    )
    first = common.spool(windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    repeated = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marked = (
        common.lookup(windows, first, ["h1", "h2"], repeated).filter(~F.col("place").eqNullSafe(F.col("first")))
        .groupBy(F.col("place.doc_id").alias(who), F.col("place._row").alias(what)).agg(F.collect_set("place.at").alias(at))
    )
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    out = keyed.join(marked, F.col("doc_id").eqNullSafe(F.col(who)) & (F.col(row) == F.col(what)), "left").drop(row, who, what)
    out = out.withColumn(cut, _strip(window)(F.when(F.col(at).isNotNull(), F.col("text")), F.col(at)))
    return (
        out.withColumns({
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long"),
            "n_removed": F.coalesce(F.col(cut)["n"], F.lit(0)).cast("long"),
            "text": F.when(F.col(at).isNull(), F.col("text")).otherwise(F.col(cut)["text"]),
        }).drop(at, cut)
    )


SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs}),
i AS (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS i FROM l),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i+1] || chr(10) || l[i+2] AS w FROM i WHERE trim(translate(l[i] || l[i+1] || l[i+2], chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w),
m AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM f WHERE k > 1),
x AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM l)
SELECT x.doc_id, count(*) AS n_lines, count(m.i) AS n_removed,
       coalesce(string_agg(x.line, chr(10) ORDER BY x.i) FILTER (m.i IS NULL), '') AS text
FROM x LEFT JOIN m ON x.doc_id = m.doc_id AND x.i = m.i GROUP BY x.doc_id
"""
