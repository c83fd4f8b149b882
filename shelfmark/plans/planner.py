"""Named queries of planning and choosing searches, over items and texts made from the relational tables, each with SQL that gives the same rows.

The operators work on arrays of one item's entries; the SQL states the same rules over rows and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.functions import drafts as D
from shelfmark.functions import names, queries, scoring
from shelfmark.operators import host_plan as hosts
from shelfmark.operators import query_choice, second_pass, shared

from .catalogue import query

#: Texts of an item's queries, in both dialects.
_TEXTS = (
    "concat(p_name, ' Piano Concerto ', 1900 + p_size)", "concat(p_name, ' / ', p_type, ' concerto op. ', p_size)", "concat(p_name, ' ', 1900 + p_size)", "concat(p_type, ' Piano Concertos')",
    "concat(p_name, ' 钢协 ', 1900 + p_size)", "concat(p_name, ' ', p_type, ' Maestro Lee concerto')", "concat(p_name, ' 春天')", "concat('complete ', p_name, ' ', p_type, ' violin sonatas ', 1900 + p_size)",
    "concat('Beethoven Spring ', p_name)", "concat(p_name, ' Appassionata ', 1900 + p_size)", "concat('钢琴奏鸣曲 ', p_name, ' op.57')", "concat('柏林 爱乐 ', p_name, ' ', 1900 + p_size)",
    "concat(p_name, ' concerto 19', p_size % 10, '0s')", "concat(p_type, ' orchestra march ', 1900 + p_size)", "concat(upper(p_name), ' PIANO CONCERTO ', 1900 + p_size)",
    "concat('  ', p_name, ' ', p_brand, ' symphony ', p_size, ' ')", "''", "concat('complete ', p_name, '-', p_type, ' big quartets trailer')", "concat(p_name, ' ', 1900 + p_size, '年')",
    "concat('贝多芬 ', p_type, ' 协奏曲 ', 1900 + p_size)",
)


def searches(t):
    """item, position, query: some fifteen queries of each part, in another order for each."""
    each = shared.spread(t("part"), "p_partkey").select(F.col("p_partkey").alias("item"), F.posexplode(F.array(*map(F.expr, _TEXTS))).alias("k", "query"))
    return each.filter("(item + k * k) % 4 <> 0").select("item", F.expr("(k * 7 + item * 3) % 23").alias("position"), "query")


_CJK = r"\x{4e00}-\x{9fff}"
_EDGE = rf"[^0-9A-Za-z_{_CJK}]"


def _said(text: str, *marks: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(txt, '{pattern}'))"


_MONTHS = "january february march april may june july august september october november december".split()
_FORMS = ("concerto", "symphony", "quartet", "trio")
#: Facts, classes (as flags) and orders (as columns) of every query, and each item's pool.
_SEARCHES = rf"""
searches AS (SELECT item, (k * 7 + item * 3) % 23 AS position, query FROM (SELECT p_partkey AS item, unnest([{", ".join(_TEXTS)}]) AS query, generate_subscripts([{", ".join("1" for _ in _TEXTS)}], 1) - 1 AS k FROM part) WHERE (item + k * k) % 4 <> 0)"""
_FLAGS = rf"""facts AS (SELECT *, {_n("[A-Za-z0-9]+|[" + _CJK + "]+")} AS tokens, {_n("[" + _CJK + "]+")} AS chunks, {_n("[^ ]+")} AS words, {_n("[0-9]")} AS digits, {_n("[A-Za-z]{3,}")} AS latin3,
  list_filter(regexp_extract_all(txt, '[A-Za-z][A-Za-z''.-]*'), lambda x: length(x) > 1) AS names, length(txt) AS size, regexp_matches(txt, '[{_CJK}]') AS cjk, contains(txt, '/') AS slash, contains(txt, ' - ') AS dash,
  regexp_matches(low, '(^|{_EDGE})(18|19|20)[0-9]{{2}}($|{_EDGE})') AS year, regexp_matches(low, '(^|{_EDGE})(18|19|20)[0-9]0s($|{_EDGE})') AS decade, {_said("low", *_MONTHS)} AS mon,
  {_said("low", "concerto", "klavierkonzert", "钢协", "协奏曲")} AS work, {_said("txt", "钢协", "协奏曲")} AS zhwork, {_said("low", "orchestra", "philharmonic", "symphony", "ensemble", "乐团", "爱乐", "交响")} AS band
  FROM (SELECT *, trim(query) AS txt, lower(trim(query)) AS low FROM searches) WHERE txt <> ''),
flags AS (SELECT *, slash OR len(names) >= 3 AS joined, work AND NOT slash AND NOT dash AND NOT band AND (decade OR (year AND (tokens <= 4 OR zhwork))) AS work_rescue,
  year AND NOT decade AND NOT mon AND NOT work AND NOT slash AND tokens <= 4 AS year_anchor, contains(low, 'concertos') AND NOT slash AND NOT dash AND NOT band AND tokens <= 4 AS bundle_rescue,
  (slash OR len(names) >= 3) AND year AND NOT mon AND work AS year_collaboration,
  (slash OR len(names) >= 3) AND work AND NOT year AND NOT decade AND NOT mon AND tokens <= 12 AND len(list_filter(names, lambda x: lower(x) NOT IN ('piano', 'concerto', 'concertos', 'op', 'robert', 'schumann', 'orchestra', 'philharmonic', 'symphony', 'ensemble', 'budapest', 'bppo'))) >= 4 AS exact_collaboration,
  cjk AND NOT slash AND digits = 0 AND len(names) BETWEEN 2 AND 3 AND NOT {_said("low", "orchestra", "philharmonic", "symphony", "ensemble")} AND {_said("low", "奏鸣曲", "三重奏", "四重奏", "春天", "热情", "sonata", "trio", "quartet", "spring", "appassionata")} AS compact_duo,
  NOT cjk AND NOT slash AND {_said("low", "sonatas", "sonata collection", "quartets", "quartet collection", "trios", "trio collection")} AND NOT regexp_matches(regexp_replace(low, '(^|{_EDGE})(18|19|20)[0-9]{{2}}($|{_EDGE})', '\1\3', 'g'), '[0-9]') AND len(names) >= 4 AS duo_bundle,
  NOT cjk AND NOT slash AND {_said("low", "appassionata", "spring")} AND contains(low, 'beethoven') AND NOT {_said("low", *_FORMS)} AND len(names) BETWEEN 3 AND 4 AS nickname_surname,
  NOT cjk AND NOT slash AND {_said("low", "appassionata", "spring")} AND year AND NOT {_said("low", *_FORMS, "collection", "complete")} AND len(names) BETWEEN 3 AND 5 AS nickname_year,
  cjk AND NOT slash AND {_said("txt", "钢琴奏鸣曲", "小提琴奏鸣曲", "op57", "op.57", "op24", "op.24")} AND NOT {_said("low", *_FORMS)} AND tokens >= 2 AS solo_cjk,
  NOT slash AND year AND NOT {_said("low", "concerto", "klavierkonzert", "sonata", "quartet", "trio", "钢协", "协奏曲", "奏鸣曲", "四重奏", "三重奏", "海顿", "布鲁克纳", "贝多芬", "舒伯特", "舒曼")} AND NOT mon AND tokens BETWEEN 4 AND 10 AND chunks >= 2 AS orchestral_context FROM facts),
ranks AS (SELECT *, (CASE WHEN zhwork AND latin3 > 0 THEN 0 WHEN work THEN 1 ELSE 2 END, (latin3 < 2)::INT, (digits = 0)::INT, band::INT, words, size) AS focus,
  (CASE WHEN year AND joined THEN 0 WHEN year THEN 1 WHEN decade THEN 2 ELSE 3 END, (size > 56 OR tokens > 10)::INT, (size > 40 OR tokens > 7)::INT, (mon OR (year AND size > 32))::INT, slash::INT) AS hurry,
  ((digits = 0)::INT, (len(names) < 3)::INT, (NOT slash)::INT, band::INT, size) AS together, (band::INT, (NOT slash)::INT, digits, words, size) AS context,
  regexp_matches(txt, '(^|{_EDGE})[A-Za-z]+-[A-Za-z]+($|{_EDGE})') AS hyphened, contains(low, 'complete') AS complete FROM flags)"""
_POOL = rf"""{_SEARCHES}, {_FLAGS},
pool AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY position) AS n, count(*) OVER (PARTITION BY item) AS held
  FROM (SELECT * FROM ranks QUALIFY row_number() OVER (PARTITION BY item, low ORDER BY position) = 1))"""


def _picked(most: int, name: str = "picks") -> str:
    """item, n of the picked."""
    return f"""mid_{name} AS (SELECT * FROM pool WHERE held > {most} AND n > 2 AND n < held),
foc_{name} AS (SELECT item, n FROM mid_{name} QUALIFY row_number() OVER (PARTITION BY item ORDER BY focus, n) = 1),
tog_{name} AS (SELECT item, n FROM mid_{name} m WHERE joined AND NOT EXISTS (FROM foc_{name} x WHERE x.item = m.item AND x.n = m.n) QUALIFY row_number() OVER (PARTITION BY item ORDER BY together, n) = 1),
two_{name} AS (SELECT * FROM foc_{name} UNION ALL SELECT * FROM tog_{name}),
rest_{name} AS (SELECT item, n FROM (SELECT item, n, row_number() OVER (PARTITION BY item ORDER BY context DESC, n) AS r FROM mid_{name} m WHERE NOT EXISTS (FROM two_{name} x WHERE x.item = m.item AND x.n = m.n))
  JOIN (SELECT item, count(*) AS k FROM two_{name} GROUP BY item) USING (item) WHERE r <= {most - 3} - k),
{name} AS (SELECT item, n FROM pool WHERE held <= {most} OR n <= 2 OR n = held UNION ALL SELECT * FROM two_{name} UNION ALL SELECT * FROM rest_{name})"""


@query(rf"""WITH {_POOL} SELECT item, position, {", ".join(queries.CLASSES)}, joined AS collaboration, tokens, focus[1]::INTEGER AS focus_first, hurry[1]::INTEGER AS runtime_first FROM ranks""".replace("focus[1]", "struct_extract_at(focus, 1)").replace("hurry[1]", "struct_extract_at(hurry, 1)"))
def query_classes(t):
    """Classes of search queries and the heads of their orders, as columns (op R9c)."""
    facts = queries.classified(queries.described(searches(t))).filter("q_length > 0")
    return facts.select("item", "position", *queries.CLASSES, F.col("q_collaboration").alias("collaboration"), F.col("q_tokens").cast("long").alias("tokens"), F.col("r_focus.col1").alias("focus_first"), F.col("r_runtime.col1").alias("runtime_first"))


@query(f"""WITH {_POOL}, {_picked(6)} SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY n) AS INTEGER) AS ordinal, txt AS query FROM picks JOIN pool USING (item, n)""")
def picked_queries(t):
    """Six queries of each item by successive picks, in their own order (op R9a)."""
    return query_choice.spelled(query_choice.picked(query_choice.pools(searches(t)), 6), "picks")


_KEEP = "NOT work_rescue AND NOT year_anchor AND NOT bundle_rescue AND NOT exact_collaboration AND NOT compact_duo AND NOT duo_bundle"
_BY_FOCUS = "focus, size, txt"
#: class, order, conditions of the slot to give up, whether a query of the class that is there already doesn't count
_STEPS = [
    ("work_rescue", "CASE WHEN zhwork AND year THEN 0 WHEN decade THEN 1 WHEN year THEN 2 ELSE 3 END, tokens, size, slash", ["true"], False),
    ("year_anchor", "NOT cjk, words, size, txt", ["NOT work_rescue AND NOT bundle_rescue AND NOT best_joined"], True),
    ("bundle_rescue", "NOT contains(low, 'piano concertos'), tokens, size", ["NOT work_rescue AND NOT year_anchor", "year_anchor AND NOT work_rescue", "year_anchor", "NOT work_rescue"], False),
    ("year_collaboration", "slash, len(list_filter(names, lambda x: x = upper(x) AND length(x) <= 3)) > 0, len(list_filter(names, lambda x: length(x) > 2 AND x <> upper(x))) < 3, size", ["NOT work_rescue AND NOT year_anchor AND NOT bundle_rescue"], True),
    ("exact_collaboration", "NOT contains(low, 'op.'), band OR contains(low, 'bppo'), slash, tokens, size", ["NOT joined AND NOT work_rescue AND NOT year_anchor AND NOT bundle_rescue", "NOT joined AND NOT work_rescue AND NOT year_anchor"], False),
    ("compact_duo", _BY_FOCUS, ["NOT work_rescue AND NOT bundle_rescue AND NOT exact_collaboration"], False),
    ("duo_bundle", "CASE WHEN complete AND year AND NOT hyphened THEN 0 WHEN complete AND contains(low, 'trailer') THEN 1 WHEN complete AND year THEN 2 WHEN complete THEN 3 WHEN year THEN 4 ELSE 5 END, hyphened, words, size, focus, txt", ["NOT work_rescue AND NOT bundle_rescue AND NOT exact_collaboration AND NOT compact_duo"], False),
    ("nickname_surname", _BY_FOCUS, [_KEEP], False),
    ("nickname_year", _BY_FOCUS, [_KEEP], False),
    ("solo_cjk", "NOT (contains(txt, '钢琴奏鸣曲') OR contains(txt, '小提琴奏鸣曲')), NOT regexp_matches(low, 'op\\.?\\s*(24|57)'), size", [_KEEP + " AND NOT nickname_surname"], False),
    ("orchestral_context", "regexp_matches(txt, '[A-Za-z]'), tokens, -chunks, size", [_KEEP], False),
]


def _prepared(most: int) -> str:
    out = [_picked(max(most + 2, 6), f"seed{most}")]
    p, s = f"p{most}", f"s{most}_"
    out.append(f"{p} AS (SELECT pool.* REPLACE (row_number() OVER (PARTITION BY item ORDER BY x.n IS NULL, n) AS n) FROM pool LEFT JOIN seed{most} x USING (item, n))".replace("PARTITION BY item ORDER BY x.n IS NULL, n", "PARTITION BY pool.item ORDER BY x.n IS NULL, pool.n"))
    out.append(f"{s}0 AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY hurry, focus, size, n) AS slot, n FROM {p} QUALIFY slot <= {most})")
    steps = _STEPS if most >= 4 else _STEPS[:2]
    for k, (name, order, tiers, always) in enumerate(steps, 1):
        out.append(f"b{most}_{k} AS (SELECT item, n AS best, decade AS best_decade FROM {p} WHERE {name} QUALIFY row_number() OVER (PARTITION BY item ORDER BY {order}, n) = 1)")
        if k == 1:
            out.append(f"closed{most} AS (SELECT item FROM {s}0 JOIN {p} USING (item, n) JOIN b{most}_1 USING (item) GROUP BY item HAVING {most} < 4 AND NOT bool_or(work_rescue) AND bool_or(year_anchor) AND bool_or(best_decade))")
        there = "bool_or(n = best)" if always else f"bool_or({name})"
        out.append(f"v{most}_{k} AS (SELECT item, best, coalesce({', '.join(f'max(slot) FILTER (WHERE {c})' for c in tiers)}, max(slot)) AS victim FROM (SELECT *, joined AND row_number() OVER (PARTITION BY item ORDER BY NOT joined, together, slot) = 1 AS best_joined FROM {s}{k - 1} JOIN {p} USING (item, n)) JOIN b{most}_{k} USING (item) WHERE item NOT IN (FROM closed{most}) GROUP BY item, best HAVING NOT {there})")
        out.append(f"{s}{k} AS (SELECT item, slot, CASE WHEN slot = victim THEN best ELSE n END AS n FROM {s}{k - 1} LEFT JOIN v{most}_{k} USING (item))")
    out.append(f"out{most} AS (SELECT item, {most} AS most, CAST(slot AS INTEGER) AS ordinal, txt AS query FROM {s}{len(steps)} JOIN {p} USING (item, n))")
    return ",\n".join(out)


@query(f"WITH {_POOL}, {_prepared(3)}, {_prepared(4)}, {_prepared(6)} FROM out3 UNION ALL FROM out4 UNION ALL FROM out6")
def prepared_queries(t):
    """Three, four and six queries of each item: by runtime order, then one of each class in the last slot that may go (op R9b)."""
    return query_choice.prepared_each(query_choice.pools(searches(t)), (3, 4, 6))


#: Rows that searches find: of each item's lines, those numbered one and two in the first pass, all in the second.
_TITLE = """concat(CASE WHEN l_orderkey % 7 = 0 AND (l_partkey % 3 = 0 OR l_linenumber > 2) THEN p_name WHEN l_orderkey % 7 = 1 THEN p_type WHEN l_orderkey % 7 = 2 AND l_linenumber > 2 THEN concat('complete ', p_name, ' ', p_type, ' violin sonatas') ELSE 'Radio' END,
CASE l_orderkey % 4 WHEN 0 THEN ' Appassionata' WHEN 1 THEN concat(' op.57 No.', l_linenumber) WHEN 2 THEN ' complete sonatas trailer' ELSE ' 全集 四重奏' END)"""


def found_rows(t):
    """item, url, text, line."""
    return t("lineitem").join(t("part"), F.expr("l_partkey = p_partkey")).select(F.col("l_partkey").alias("item"), F.expr("concat('https://rows.example/', l_orderkey, '/', l_linenumber)").alias("url"), F.expr(_TITLE).alias("text"), F.col("l_linenumber").alias("line"))


_STOPPED = "'beethoven', 'spring', 'appassionata', 'sonata', 'sonatas', 'violin', 'piano', 'ludwig', 'van', 'no', 'op', 'major', 'minor', 'complete', 'collection'"
_ZH_STOP = _said("x", "热情", "春天", "奏鸣曲", "钢琴", "小提琴", "贝多芬", "路德维希", "第二十三", "第五", "op")
_PLAIN = r"regexp_replace(regexp_replace(lower({0}), '\bno\.?\s*([0-9]+)', ' no \1', 'g'), '\s+', ' ', 'g')"
_OPUS = r"regexp_matches(low, '(^|[^0-9a-z_])op\.?\s*(24|57)($|[^0-9a-z_])')"
_TRIGGERS = rf"""
latin AS (SELECT item, unnest(regexp_extract_all(low, '[a-z]{{3,}}')) AS x FROM flags),
zh AS (SELECT item, unnest(list_concat(list_transform(regexp_extract_all(txt, '[{_CJK}·]{{2,}}'), lambda c: replace(c, '·', '')), CASE WHEN cjk THEN list_filter(regexp_split_to_array(txt, '[·•・／/|,，、\s]+'), lambda c: c <> '')[-1:] ELSE [] END)) AS x FROM flags),
counted AS (SELECT item, x, count(*) AS n FROM latin WHERE x NOT IN ({_STOPPED}) GROUP BY ALL),
duo_t AS (SELECT item, list(x ORDER BY n DESC, length(x) DESC, x) AS duo_tokens FROM (SELECT * FROM counted WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, length(x) DESC, x) <= 4) GROUP BY item),
solo_t AS (SELECT item, list(x ORDER BY n DESC, length(x) DESC, x) AS solo_tokens FROM (SELECT * FROM (SELECT item, x, sum(n) AS n FROM (SELECT * FROM counted UNION ALL SELECT item, x, count(*) FROM zh WHERE length(x) >= 3 AND NOT {_ZH_STOP} GROUP BY ALL) GROUP BY ALL)
  WHERE n >= 2 OR regexp_matches(x, '[{_CJK}]') QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, length(x) DESC, x) <= 3) GROUP BY item),
opus AS (SELECT *, NOT slash AND ({_said("low", "appassionata", "spring", "热情", "春天", "op24", "op57")} OR {_OPUS}) AS probe FROM flags),
signal AS (SELECT item, bool_or({_said("low", "spring", "appassionata", "sonata", "春天", "热情", "奏鸣曲")}) AND bool_or(joined) AS two, bool_or(probe) AS one FROM opus GROUP BY item),
known AS (SELECT item, two, one, coalesce(duo_tokens, []::VARCHAR[]) AS duo_tokens, coalesce(solo_tokens, []::VARCHAR[]) AS solo_tokens FROM signal LEFT JOIN duo_t USING (item) LEFT JOIN solo_t USING (item)),
every_row AS (SELECT l_partkey AS item, concat('https://rows.example/', l_orderkey, '/', l_linenumber) AS url, {_TITLE} AS text, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
hays AS (SELECT *, {_PLAIN.format("text")} AS hay FROM every_row),
met AS (SELECT item, bool_or(len(list_filter(duo_tokens, lambda x: contains(hay, x))) >= 2) AS two_met, bool_or(len(list_filter(solo_tokens, lambda x: contains(hay, x))) >= 1 AND {_said("hay", *second_pass.NAMED_WORKS)}) AS one_met FROM hays JOIN known USING (item) WHERE line <= 2 GROUP BY item),
triggers AS (SELECT item, duo_tokens, solo_tokens, two AND len(duo_tokens) >= 2 AND NOT coalesce(two_met, false) AS duo, one AND len(solo_tokens) >= 1 AND NOT coalesce(one_met, false) AS solo FROM known LEFT JOIN met USING (item))"""


@query(f"WITH {_POOL}, {_TRIGGERS} SELECT item, array_to_string(duo_tokens, ',') AS duo_tokens, array_to_string(solo_tokens, ',') AS solo_tokens, duo, solo FROM triggers")
def second_pass_triggers(t):
    """Items whose first pass lacks what their queries look for (ops R9d, R9e)."""
    found = second_pass.triggers(searches(t), found_rows(t).filter("line <= 2"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("duo_tokens", "solo_tokens")})


_PROBES = rf"""
again AS (SELECT opus.*, ranks.focus, duo, solo FROM opus JOIN ranks USING (item, position) JOIN triggers USING (item) WHERE duo OR solo),
once AS (SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY item, low ORDER BY position) = 1),
bare AS (SELECT *, trim(regexp_replace(txt, '(^|{_EDGE})(18|19|20)[0-9]{{2}}($|{_EDGE})', '\1\3', 'g')) AS b FROM once),
staged AS (SELECT item, 0 AS stage, position AS o, concat(trim(CASE WHEN contains(lower(b), 'complete ') THEN substr(b, strpos(lower(b), 'complete ')) ELSE b END), ' trailer') AS query FROM bare
    WHERE duo AND NOT cjk AND NOT slash AND NOT contains(low, 'trailer') AND contains(low, 'complete') AND {_said("low", *second_pass.PROBED)} AND joined
  UNION ALL SELECT item, 1, row_number() OVER (PARTITION BY item ORDER BY cjk, NOT {_OPUS}, focus, size, position) AS o, txt FROM once WHERE solo AND probe QUALIFY o <= 2
  UNION ALL SELECT item, 2, position, txt FROM once),
asked AS (SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY stage, o, query) AS INTEGER) AS ordinal, query FROM (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY item, lower(query) ORDER BY stage, o, query) = 1) QUALIFY ordinal <= 6)"""


@query(f"WITH {_POOL}, {_TRIGGERS}, {_PROBES} FROM asked")
def second_pass_probes(t):
    """What those items are asked again (op R9e)."""
    asked = searches(t)
    return second_pass.probes(asked, second_pass.triggers(asked, found_rows(t).filter("line <= 2")))


@query(f"""WITH {_POOL}, {_TRIGGERS}, {_PROBES},
worded AS (SELECT item, list_filter(regexp_split_to_array({_PLAIN.format("query")}, '[^a-z0-9{_CJK}]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$')) AS w FROM asked),
second AS (SELECT DISTINCT item, url FROM hays JOIN worded USING (item) WHERE len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(hay, x))) = 0),
both_rows AS (SELECT hays.*, CASE WHEN line <= 2 THEN 1 ELSE 2 END AS pass FROM hays LEFT JOIN second s USING (item, url) WHERE line <= 2 OR s.url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item, url ORDER BY pass, text) = 1),
bundles AS (SELECT item, url FROM both_rows JOIN triggers USING (item) WHERE (duo OR solo) AND len(duo_tokens) >= 2 AND {_said("hay", "complete", "全集")} AND {_said("hay", *second_pass.BUNDLES)} AND len(list_filter(duo_tokens, lambda x: contains(hay, x))) >= 2
  QUALIFY row_number() OVER (PARTITION BY item ORDER BY NOT contains(hay, 'complete'), length(trim(text)), url) = 1)
SELECT item, url, text, pass, bundles.url IS NOT NULL AS promoted FROM both_rows LEFT JOIN bundles USING (item, url)""")
def second_pass_rows(t):
    """Both passes' rows together, the second read for triggered items alone, with the row that is promoted (op R9e)."""
    asked, rows = searches(t), found_rows(t)
    first = rows.filter("line <= 2").drop("line")
    triggered = shared.written(second_pass.triggers(asked, first))
    return second_pass.both_passes(first, rows.drop("line"), triggered, second_pass.probes(asked, triggered))


_GENERATORS = (
    "profile_zh", "chamber_cjk", "named_surname", "named_year", "solo_opus", "chamber_latin", "cjk_context", "decade", "bundle", "bundle_context", "work_rescue", "year_anchor", "primary_only", "bilingual", "bilingual_alias",
    "alias", "profile_latin", "zh", "latin", "profile_mixed", "mixed", "profile", "surname_pair",
)
#: Marks of a query by its text; where a generator has a query is told by numbers.
_ANCHORS = ("named_duo", "compact_duo,solo_cjk", "latin_duo", "trailer", "bundle_year,solo_opus", "")


def generated(t):
    """item, generator, position, query, anchors: each part's texts, three times over, dealt to generators."""
    each = shared.spread(t("part"), "p_partkey").select(F.col("p_partkey").alias("item"), F.posexplode(F.array(*map(F.expr, _TEXTS))).alias("k", "query")).select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("r"))
    names, marks = F.array(*map(F.lit, _GENERATORS)), F.array(*map(F.lit, _ANCHORS))
    dealt = each.withColumn("generator", F.get(names, F.expr(f"CAST((k * 3 + r * 5 + item * 7) % {len(_GENERATORS)} AS INT)"))).withColumn("anchors", F.split(F.get(marks, F.expr(f"CAST((k + item) % {len(_ANCHORS)} AS INT)")), ","))
    place = F.row_number().over(Window.partitionBy("item", "generator").orderBy("k", "r")) - 1
    return dealt.withColumn("position", place).select("item", "generator", "position", "query", "anchors")


def drafts(t):
    return t("part").selectExpr(
        "p_partkey AS item", "concat('Op. ', p_size) AS catalogue", "p_name AS work", "p_type AS composer", "array(array(p_name, ''), array('Maestro Lee', 'Meister Li')) AS slots", "p_partkey % 3 = 0 AS joint_first",
        "array(lower(p_name), 'concerto', '钢协') AS mentions", "p_partkey % 4 = 1 AS spare_bundles", "p_partkey % 2 = 0 AS dated",
    )


def _plan_sql(plan: hosts.Plan) -> str:
    """The plan over lists of texts: slices joined, places as lists of numbers."""
    table = lambda slices: ", ".join(f"('{g}', {a}, {b}, {i})" for i, (g, a, b) in enumerate(slices))
    out = [f"""texts AS (SELECT p_partkey AS item, unnest([{", ".join(_TEXTS)}]) AS query, generate_subscripts([{", ".join("1" for _ in _TEXTS)}], 1) - 1 AS k, 'Op. ' || p_size AS catalogue, lower(p_name) AS work, lower(p_type) AS composer FROM part),
made AS (SELECT *, [{", ".join(f"'{g}'" for g in _GENERATORS)}][(k * 3 + r * 5 + item * 7) % {len(_GENERATORS)} + 1] AS generator, string_split([{", ".join(f"'{m}'" for m in _ANCHORS)}][(k + item) % {len(_ANCHORS)} + 1], ',') AS anchors FROM texts, (SELECT unnest([0, 1, 2]) AS r)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY item, generator ORDER BY k, r) - 1 AS position, trim(query) AS raw FROM made),
rows_ AS (SELECT *, lower(raw) AS lo, {_PLAIN.format("raw")} AS pl FROM numbered WHERE raw <> ''),
hint AS (SELECT *, CASE WHEN contains(pl, lower(catalogue)) OR NOT (contains(pl, work) OR contains(pl, 'concerto') OR contains(pl, '钢协'))
  OR (item % 4 = 1 AND contains(lo, 'concertos') AND NOT contains(lo, '/') AND NOT contains(lo, ' - ') AND NOT {_said("lo", "orchestra", "philharmonic", "symphony", "ensemble", "乐团", "爱乐", "交响")} AND len(regexp_extract_all(raw, '[A-Za-z0-9]+|[{_CJK}]+')) <= 4)
  THEN raw ELSE raw || ' ' || catalogue END AS hinted,
  [CASE WHEN item % 3 = 0 AND contains(pl, work) AND (contains(pl, 'maestro lee') OR contains(pl, 'meister li')) THEN 0 ELSE 1 END, CASE WHEN regexp_matches(raw, '[{_CJK}]') = {str(plan.cjk).lower()} THEN 0 ELSE 1 END,
   (NOT contains(lo, lower(catalogue)))::INT, (NOT contains(lo, work))::INT, (NOT contains(lo, composer))::INT, length(raw)::INT] AS fit FROM rows_),
searches AS (SELECT DISTINCT item, 0 AS position, unnest([raw, hinted]) AS query FROM hint), {_FLAGS},
tail AS (SELECT * FROM (SELECT hint.*, list_concat([1], fit, [turn, position]) AS place FROM hint JOIN (VALUES {table(plan.sorted)}) s(g, a, b, turn) ON generator = g AND position >= a AND position < b QUALIFY row_number() OVER (PARTITION BY item, lo ORDER BY turn, position) = 1)),
line AS (SELECT item, hinted, place FROM tail UNION ALL SELECT item, hinted, [0, 0, 0, 0, 0, 0, 0, turn, position] FROM hint JOIN (VALUES {table(plan.first)}) s(g, a, b, turn) ON generator = g AND position >= a AND position < b),
l0 AS (SELECT item, list(hinted ORDER BY place) AS l FROM (SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY item, lower(hinted) ORDER BY place) = 1) GROUP BY item)"""]
    last = "l0"
    for k, i in enumerate(plan.injections):
        out.append(f"c{k} AS (SELECT item, arg_min(raw, position) AS c FROM hint WHERE generator = '{i.generator}' AND list_contains(anchors, '{i.mark}') GROUP BY item)")
        out.append(f"i{k} AS (SELECT item, CASE WHEN c IS NULL OR list_contains(l[:{i.window}], c) THEN l ELSE list_concat(list_filter(l, lambda x: x <> c)[:{i.slot}]{'[:0]' if not i.slot else ''}, [c], list_filter(l, lambda x: x <> c)[{i.slot + 1}:]) END AS l FROM {last} LEFT JOIN c{k} USING (item))")
        last = f"i{k}"
    for name, slices, keep, on in (("year", plan.year, "work_rescue OR joined OR duo", "true"), ("exact", plan.exact, "work_rescue OR year_anchor OR exact_collaboration OR joined OR duo", "item % 2 = 1")):
        if not slices:
            continue
        flag = "year_anchor" if name == "year" else "exact_collaboration"
        order = "level, NOT cjk, size, txt" if name == "year" else "place"
        own = "UNION ALL SELECT item, raw, [0], 0 FROM hint WHERE generator = 'year_anchor'" if name == "year" else ""
        level = 1 if name == "year" else 0
        out.append(f"""w_{name} AS (SELECT item, txt AS c FROM (SELECT item, raw, [0, 0, 0, 0, 0, 0, 0, turn, position] AS place, {level} AS level FROM hint JOIN (VALUES {table(slices)}) s(g, a, b, turn) ON generator = g AND position >= a AND position < b UNION ALL SELECT item, raw, place, 1 FROM tail {own}) x
  JOIN flags ON flags.item = x.item AND flags.txt = x.raw WHERE {flag} QUALIFY row_number() OVER (PARTITION BY x.item ORDER BY {order}) = 1)""".replace("SELECT item, txt AS c", "SELECT x.item, txt AS c"))
        out.append(f"k_{name} AS (SELECT item, list(txt) AS keep FROM (SELECT flags.*, coalesce(d, false) AS duo FROM flags LEFT JOIN (SELECT item, txt, bool_or(m) AS d FROM (SELECT item, unnest([raw, hinted]) AS txt, list_contains(anchors, 'named_duo') AS m FROM hint) GROUP BY ALL) USING (item, txt)) WHERE {keep} GROUP BY item)")
        out.append(f"""a_{name} AS (SELECT item, l, c, CASE WHEN c IS NULL OR NOT ({on}) OR list_contains(l[:{plan.most}], c) THEN 0 WHEN len(l) < {plan.most} THEN len(l) + 1
  ELSE coalesce(list_max(list_filter(generate_series(1, {plan.most}), lambda n: NOT list_contains(coalesce(keep, []), l[n]))), {plan.most}) END AS at FROM {last} LEFT JOIN w_{name} USING (item) LEFT JOIN k_{name} USING (item))""".replace(" AS at ", " AS slot "))
        out.append(f"e_{name} AS (SELECT item, list(x ORDER BY n) AS l FROM (SELECT item, slot, n, x FROM (SELECT item, slot, unnest(m) AS x, generate_subscripts(m, 1) AS n FROM (SELECT item, slot, CASE WHEN slot = 0 THEN l ELSE list_concat(l[:slot - 1], [c], l[slot + 1:]) END AS m FROM a_{name})) QUALIFY slot = 0 OR row_number() OVER (PARTITION BY item, lower(x) ORDER BY n) = 1) GROUP BY item)")
        last = f"e_{name}"
    return f"WITH {', '.join(out)} SELECT item, CAST(unnest(generate_series(1, len(l[:{plan.most}]))) AS INTEGER) AS ordinal, unnest(l[:{plan.most}]) AS query FROM {last}"


@query(_plan_sql(hosts.CHINESE))
def host_plan(t):
    """Ten queries of each item for a host of the first kind: slices of its generators, anchors in their slots, the rest by fit (ops R8a, R8d, O8, J25)."""
    return hosts.planned(generated(t), drafts(t), hosts.CHINESE)


@query(_plan_sql(hosts.OTHER))
def host_plan_other(t):
    """Ten queries of each item for other hosts (op R8a)."""
    return hosts.planned(generated(t), drafts(t), hosts.OTHER)


#: Texts of drafts, in both dialects: works, some of them concertos; people with and without particles; days with and without years.
_DRAFT = {
    "title": "concat(p_name, ' live in ', p_brand)", "work": "CASE WHEN p_size % 4 = 0 THEN '' ELSE concat(p_type, CASE p_size % 3 WHEN 0 THEN ' Piano Concerto' WHEN 1 THEN ' violin sonata' ELSE ' choir song' END) END", "catalogue": "CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('Op. ', p_size) END",
    "composer": "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('Johann ', upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2)) END", "day": "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'May' ELSE concat('May ', 1940 + p_size) END",
    "lead_a": "concat(CASE p_partkey % 3 WHEN 0 THEN 'Anna von der ' WHEN 1 THEN 'Karl ' ELSE '' END, upper(split_part(p_name, ' ', 1)))", "lead_b": "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '卡尔·伯姆' ELSE concat('Max de ', split_part(p_name, ' ', 2)) END", "ensemble": "CASE WHEN p_partkey % 4 = 3 THEN '' ELSE concat('Radio ', p_brand) END",
}


def _drafted(t):
    rows = shared.spread(t("part"), "p_partkey").select(F.col("p_partkey").alias("item"), *(F.expr(e).alias(n) for n, e in _DRAFT.items()))
    return rows.withColumn("named", D.work_query(F.col("work"), F.lit(""), F.col("catalogue"), F.col("title")))


_DRAFTED = f"""d AS (SELECT p_partkey AS item, {", ".join(f"{e} AS {n}" for n, e in _DRAFT.items())} FROM part),
w AS (SELECT *, CASE WHEN work <> '' AND catalogue <> '' AND NOT contains(lower(work), lower(catalogue)) THEN work || ' ' || catalogue WHEN work <> '' THEN work ELSE title END AS named FROM d)"""


@query(f"""WITH {_DRAFTED}, l AS (SELECT item, unnest(CASE WHEN lead_b = '' OR lead_b = lead_a THEN [lead_a] ELSE [lead_a, lead_b] END) AS lead, unnest(CASE WHEN lead_b = '' OR lead_b = lead_a THEN [1] ELSE [1, 2] END) AS i FROM w),
s AS (SELECT unnest([{", ".join(f"'{x}'" for x in D.SHAPES)}]) AS shape, unnest([{", ".join(str(i) for i in range(len(D.SHAPES)))}]) AS k),
q AS (SELECT item, k, i, array_to_string(list_filter([CASE WHEN contains(shape, 'T') THEN title END, CASE WHEN contains(shape, 'C') THEN composer END, CASE WHEN contains(shape, 'W') THEN named END, CASE WHEN contains(shape, 'L') THEN trim(lead) END, CASE WHEN contains(shape, 'E') THEN ensemble END, CASE WHEN contains(shape, 'D') THEN day END], lambda x: x <> ''), ' ') AS query FROM w JOIN l USING (item), s),
f AS (SELECT item, query, min([k, i]) AS turn FROM q WHERE query <> '' GROUP BY item, query) SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY turn) AS INTEGER) AS place, query FROM f""")
def draft_queries(t):
    """Ten shapes of queries for each of a draft's people and ensembles, in order, each once (ops R7, J25)."""
    made = _drafted(t).select("item", D.shaped(F.col("named"), F.col("composer"), F.array("lead_a", "lead_b"), F.array("ensemble"), F.col("title"), F.col("day")).alias("q"))
    # outer, then filtered: a plain explode has a filter of its input, which the optimizer works out once more before the rows are dealt
    return made.select("item", F.posexplode_outer("q").alias("place", "query")).filter(F.col("query").isNotNull()).withColumn("place", F.col("place") + 1)


_SUR = lambda c: f"CASE WHEN regexp_matches({c}, '^[^ ]+ .*[^ ]{{4,}}$') THEN regexp_extract({c}, '(?i)^[^ ]+ (?:[^ ]+ )*?((?:(?:{'|'.join(D.PARTICLES)}) )*[^ ]{{4,}})$', 1) ELSE {c} END"
_BUCKET = lambda c: f"CASE WHEN len(string_split({c}, ' ')) BETWEEN 2 AND 3 THEN 0 WHEN len(string_split({c}, ' ')) >= 4 THEN 1 ELSE 2 END"


@query(f"""WITH {_DRAFTED}, y AS (SELECT *, regexp_extract(day, '(19[0-9]{{2}}|20[0-9]{{2}})', 1) AS year, {_SUR("lead_a")} AS a, CASE WHEN lead_b = '' OR regexp_matches(lead_b, '[{_CJK}]') THEN '' ELSE {_SUR("lead_b")} END AS b, {_SUR("composer")} AS c, contains(lower(work), 'concerto') AS con FROM w),
q AS (SELECT item, 'year' AS kind, 1 AS place, a || ' ' || year AS query FROM y WHERE year <> '' UNION ALL SELECT item, 'year', 2, CASE WHEN b = '' THEN lead_b ELSE b END || ' ' || year FROM y WHERE year <> '' AND lead_b <> '' AND lower(CASE WHEN b = '' THEN lead_b ELSE b END) <> lower(a)
UNION ALL SELECT item, 'pair', 1, a || ' ' || b || ' ' || c || ' concerto ' || year FROM y WHERE con AND b <> '' AND lower(a) <> lower(b) AND c <> '' AND year <> '' UNION ALL SELECT item, 'pair', 2, a || ' ' || b || ' ' || c || ' concerto' FROM y WHERE con AND b <> '' AND lower(a) <> lower(b) AND c <> ''
UNION ALL SELECT item, 'pair', 3, a || ' ' || b || ' concerto ' || year FROM y WHERE con AND b <> '' AND lower(a) <> lower(b) AND year <> ''
UNION ALL SELECT item, 'decade', k, concat_ws(' ', a, CASE WHEN k <= 2 THEN c END, CASE WHEN k % 2 = 1 THEN work ELSE replace(work, 'Piano Concerto', 'Piano Concertos') END, left(year, 3) || '0s') FROM y, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE con AND year <> '' AND (k > 2 OR c <> ''))
SELECT item, kind, CAST(row_number() OVER (PARTITION BY item, kind ORDER BY place) AS INTEGER) AS place, query FROM q""")
def rescue_queries(t):
    """Queries of few words where others find nothing: a surname with the year, two surnames, a work's decade (ops R8e, R8g)."""
    d = _drafted(t).withColumns({"year": D.year_of(F.col("day")), "first": D.keywords(F.array("lead_a")), "second": D.keywords(F.filter(F.array("lead_b"), lambda x: ~names.holds_cjk(x))), "who": D.surname(F.col("composer"))})
    made = {"year": D.year_anchors(F.array("lead_a", "lead_b"), F.col("year")), "pair": D.surname_pairs(F.col("work"), F.col("first"), F.col("second"), F.col("who"), F.col("year")), "decade": D.decades(F.col("work"), F.col("first"), F.col("who"), F.col("year"))}
    each = d.select("item", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), q.alias("q")) for k, q in made.items()))).alias("x"))
    return each.select("item", "x.kind", F.posexplode("x.q").alias("place", "query")).withColumn("place", F.col("place") + 1)


@query(f"""WITH {_DRAFTED}, x AS (SELECT item, ' ' || lower(concat_ws(' ', title, work, lead_a, lead_b, ensemble)) || ' ' AS text FROM w)
SELECT item, array_to_string(list_filter([{", ".join(f"CASE WHEN {_said('text', *marks)} THEN '{tag}' END" for tag, marks in D.TAGS.items())}], lambda x: x IS NOT NULL), ',') AS tags FROM x""")
def profile_tags(t):
    """What drafts are about, by words in what they say (op R6)."""
    return _drafted(t).select("item", F.array_join(D.tags(*(F.col(c) for c in ("title", "work", "lead_a", "lead_b", "ensemble"))), ",").alias("tags"))


_PAGE = """concat(CASE l_orderkey % 6 WHEN 0 THEN lead_a WHEN 1 THEN concat(lead_a, ' & ', lead_b) WHEN 2 THEN split_part(lead_b, ' ', 3) WHEN 3 THEN concat(lead_b, ' / ', p_brand) ELSE p_brand END, ' ',
CASE l_orderkey % 5 WHEN 0 THEN work WHEN 1 THEN 'Piano Concerto' WHEN 2 THEN concat(work, ' ', catalogue) WHEN 3 THEN ': I. Allegro x' ELSE concat(work, ' complete sonatas') END, ' ',
CASE l_linenumber % 4 WHEN 0 THEN composer WHEN 1 THEN day WHEN 2 THEN concat('in ', 1941 + p_size) ELSE 'biography remaster Op. 3' END, ' ', CASE l_linenumber % 3 WHEN 0 THEN ensemble ELSE 'hall' END)"""
_LINK = "CASE l_orderkey % 4 WHEN 0 THEN concat('https://music.apple.com/x?i=', l_orderkey) WHEN 1 THEN 'https://v.example/?p=2' ELSE 'https://v.example/watch' END"
_CLOCK = "l_orderkey * 7 % 40 * 60"
_TERMS = ("work", "catalogue", "composer", "leads", "absent_leads", "duo", "groups", "half", "all", "years", "day", "marks", "kind", "page", "edition", "length", "other", "no_work", "no_lead", "no_group")
_WORDS = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9{_CJK}]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$'))"
_HOLDS = lambda c: f"(len({_WORDS(c)}) > 0 AND len(list_filter({_WORDS(c)}, lambda x: NOT contains(hay, x))) = 0)"
_NAMED = lambda c: rf"({_HOLDS(c)} OR (length(coalesce({_WORDS(c)}[-1], '')) >= 4 AND contains(hay, {_WORDS(c)}[-1])) OR (len({_WORDS(c)}) >= 2 AND regexp_matches(hay, '(^|{_EDGE})' || array_to_string(list_transform({_WORDS(c)}, lambda x: left(x, 1)), '[.\s]+') || '\.?($|{_EDGE})')))"


@query(rf"""WITH {_DRAFTED}, p AS (SELECT w.*, p_size, l_orderkey, l_linenumber, {_PAGE} AS text, {_LINK} AS url, {_CLOCK} AS seconds FROM lineitem JOIN part ON l_partkey = p_partkey JOIN w ON w.item = p_partkey),
h AS (SELECT *, regexp_replace(trim(lower(text)) || ' ' || url, '\s+', ' ', 'g') AS hay, CASE WHEN lead_b = '' THEN 1 ELSE 2 END AS slots, contains(lower(work), 'concerto') AS con FROM p),
f AS (SELECT *, work <> '' AND ({_HOLDS("work")} OR (con AND contains(hay, 'piano concerto'))) AS wm, {_NAMED("lead_a")}::INT + CASE WHEN lead_b <> '' THEN {_NAMED("lead_b")}::INT ELSE 0 END AS leads, CASE WHEN ensemble <> '' AND ({_HOLDS("ensemble")} OR contains(replace(replace(hay, '.', ''), ' ', ''), array_to_string(list_transform(list_filter({_WORDS("ensemble")}, lambda x: length(x) >= 2), lambda x: left(x, 1)), ''))) THEN 1 ELSE 0 END AS grp,
  regexp_extract(day, '((?:17|18|19|20)[0-9]{{2}})', 1) AS wanted, regexp_extract_all(hay, '(?:19|20)[0-9]{{2}}') AS seen, regexp_matches(lower(text), '&| / | and | with |、') AS joint, regexp_matches(hay, ': i\. ') AS one FROM h),
t AS (SELECT *, CASE WHEN wm THEN 0.25 ELSE 0 END AS "work_", CASE WHEN catalogue <> '' AND {_HOLDS("catalogue")} THEN 0.12 ELSE 0 END AS "catalogue_", CASE WHEN composer <> '' AND {_NAMED("composer")} THEN 0.08 WHEN composer <> '' AND wm THEN -0.24 ELSE 0 END AS "composer_",
  CASE WHEN leads > 0 THEN 0.18 + 0.08 * (leads - 1) ELSE 0 END AS leads_, CASE WHEN slots >= 2 AND leads < slots THEN CASE WHEN contains(hay, ' / ') OR regexp_matches(hay, '&| and | with ') THEN -0.24 * (slots - leads) WHEN joint OR regexp_matches(lower(text), ' - |, ') THEN -0.18 * (slots - leads) ELSE 0 END ELSE 0 END AS absent_leads_,
  CASE WHEN slots >= 2 AND ensemble = '' THEN CASE WHEN leads = slots THEN 0.18 WHEN leads = 1 THEN -0.1 ELSE 0 END ELSE 0 END AS duo_, CASE WHEN grp > 0 THEN 0.15 ELSE 0 END AS groups_, CASE WHEN slots >= 2 AND leads = 1 AND grp > 0 AND wm THEN -0.45 ELSE 0 END AS half_, CASE WHEN wm AND grp > 0 AND leads >= slots THEN 0.06 ELSE 0 END AS all_,
  CASE WHEN wanted <> '' AND list_contains(seen, wanted) THEN 0.08 WHEN wanted <> '' AND len(seen) > 0 THEN -0.32 ELSE 0 END AS years_, CASE WHEN contains(day, 'May') AND contains(hay, 'may') THEN 0.1 ELSE 0 END AS day_,
  CASE WHEN catalogue = '' THEN 0 WHEN contains(hay, lower(catalogue)) THEN 0.06 WHEN regexp_matches(hay, '(^|[^a-z0-9])op\. ?[0-9]') AND NOT regexp_matches(hay, '(^|[^a-z0-9])op\. ?' || p_size || '($|[^0-9a-z])') THEN -0.2 ELSE 0 END AS marks_,
  CASE WHEN one THEN CASE WHEN contains(url, 'apple') AND wm AND leads >= 1 THEN -0.02 WHEN wm AND leads >= 1 THEN -0.08 ELSE -0.34 END WHEN regexp_matches(hay, '(^|{_EDGE})sonatas($|{_EDGE})') THEN CASE WHEN contains(url, 'apple') AND wm AND leads >= 1 THEN 0 WHEN wm AND leads >= 1 THEN -0.12 ELSE -0.34 END WHEN contains(hay, 'complete') THEN 0.04 ELSE 0 END AS kind_,
  CASE WHEN contains(url, '?p=2') THEN -0.04 ELSE 0 END AS page_, CASE WHEN contains(hay, 'remaster') THEN -0.12 ELSE 0 END AS edition_,
  CASE WHEN con THEN 900 WHEN contains(work, 'sonata') THEN 720 ELSE 0 END AS least, CASE WHEN contains(hay, 'biography') THEN -0.28 ELSE 0 END AS other_, CASE WHEN work <> '' AND NOT wm THEN -0.22 ELSE 0 END AS no_work_, CASE WHEN leads = 0 THEN -0.1 ELSE 0 END AS no_lead_, CASE WHEN ensemble <> '' AND grp = 0 THEN -0.08 ELSE 0 END AS no_group_ FROM f),
u AS (SELECT *, CASE WHEN seconds <= 0 OR least <= 0 THEN 0 WHEN seconds >= floor(least * 0.85) THEN CASE WHEN regexp_matches(hay, 'full|complete') THEN 0.05 ELSE 0.02 END WHEN seconds < greatest(240, floor(least * 0.35)) THEN -0.38 WHEN seconds < floor(least * 0.6) THEN -0.18 ELSE 0 END AS length_ FROM t)
SELECT item, l_orderkey, l_linenumber, {", ".join(f"CAST({x}_ AS DOUBLE) AS {x if x not in ('all',) else chr(34) + x + chr(34)}" for x in _TERMS)}, CAST(round(greatest(0, least(0.97, 0.2 + {" + ".join(f"{x}_" for x in _TERMS)})), 4) AS DOUBLE) AS score FROM u""")
def recording_scores(t):
    """How surely a page is the recording that is asked for, term by term (op K1)."""
    none, blank = F.array().cast("array<string>"), F.lit("")
    slots = F.filter(F.array(F.array("lead_a"), F.array("lead_b")), lambda s: F.get(s, 0) != "")
    work = {"work": F.col("work"), "work_latin": F.col("work"), "catalogue": F.col("catalogue"), "composer": F.col("composer"), "composer_latin": F.col("composer"), "title": F.lit("Recital"), "day": F.col("day"), "raw": blank}
    draft = work | {"slots": slots, "ensembles": F.filter(F.array("ensemble"), lambda x: x != ""), "ensembles_latin": none}
    # what is told by the draft alone is worked out for each draft, the rest for each page; both are dealt by draft
    drafted = _drafted(t).withColumn("known", scoring.known(draft))
    named = shared.spread(t("part"), "p_partkey").join(drafted, F.expr("item = p_partkey"))
    rows = shared.spread(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey").join(named, F.expr("l_partkey = p_partkey"))
    rows = rows.select("item", "l_orderkey", "l_linenumber", "known", F.expr(_PAGE).alias("text"), F.expr(_LINK).alias("url"), F.expr(_CLOCK).alias("seconds"))
    facts = scoring.with_facts(rows, F.col("text"), F.col("url"), blank, F.col("known"))
    parts = scoring.terms(F.col("seconds"), F.size("known.slots") >= 2)
    out = facts.withColumns({f"t_{k}": v for k, v in parts.items()})
    score = scoring.total({k: F.col(f"t_{k}") for k in parts})
    return out.select("item", "l_orderkey", "l_linenumber", *(F.round(F.col(f"t_{k}").cast("double"), 4).alias(k) for k in _TERMS), F.round(score, 4).alias("score"))
