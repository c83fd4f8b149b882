import json
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import audit, hierarchy, keyed, resolve
from shelfmark.sources import library
from shelfmark.streaming import hosts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_alias_cycles_end_at_the_entry(spark):
    links = spark.createDataFrame([("c", "a"), ("a", "b"), ("b", "a"), ("x", "y"), ("y", "z")], "alias string, canonical string")
    assert {r[0]: r[1] for r in resolve.alias_closure(links).collect()} == {"c": "a", "a": "a", "b": "b", "x": "z", "y": "z"}


def test_alias_chains_of_any_length(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 90) for i in range(90)] + [(2000 + i, 2001 + i) for i in range(80)] + [(2080, 1007), (5, 5000), (6000, 6000), (6001, 6000), (None, 1), (7000, None), (7001, 7000)]
    links = [x for x in links if x != (5, 6)]  # 0..5 lead to 5000
    to = {a: c for a, c in links if a is not None and c is not None and a != c}
    want = {}
    for a in to:
        seen, node = set(), a
        while node in to and node not in seen:
            seen.add(node)
            node = to[node]
        want[a] = node
    assert want[6] == 300 and want[2000] == 1007 and want[1000] == 1000
    assert {r[0]: r[1] for r in resolve.alias_closure(spark.createDataFrame(links, "alias long, canonical long")).collect()} == want
    with pytest.raises(ValueError):
        resolve.alias_closure(spark.createDataFrame([(1, 2), (1, 3)], "alias long, canonical long"))


def test_ordered_distinct_keeps_first(spark):
    a = F.array(*map(F.lit, ["b", " a", "B", "", "a"]))
    assert one(spark, keyed.ordered_distinct(a)) == ["b", "a", "B"]
    assert one(spark, keyed.ordered_distinct(a, ignore_case=True)) == ["b", "a"]


def test_text_functions(spark):
    assert one(spark, T.trimmed(F.lit("　a﻿"))) == "a"
    assert one(spark, T.trimmed(F.lit(None).cast("string"))) == ""
    assert one(spark, T.lookup_key(F.lit("Dvořák, A."))) == "dvoraka"
    assert one(spark, T.slug(F.lit("Ça va — bien!"))) == "ca-va-bien"
    assert one(spark, T.seconds_of(F.lit("1:02:03"))) == 3723
    assert one(spark, T.seconds_of(F.lit("x:1"))) is None
    assert one(spark, T.acronym(F.lit("Radio Symphony-Orchestra"))) == "RSO"
    assert one(spark, T.decade(F.lit(0))) is None
    assert one(spark, T.unescape(F.lit("a &amp; b"))) == "a & b"
    assert one(spark, T.canonical_url(F.lit("https://www.Example.com/a/?x=1#y"))) == "example.com/a"


def test_violations_raise(spark):
    orders = spark.createDataFrame([(1, 9)], "id long, c long")
    bad = audit.missing_parents(orders, ["id"], "c", spark.createDataFrame([(1,)], "k long"), "k", "fk")
    with pytest.raises(ValueError, match="fk: 1"):
        audit.assert_valid(bad)


def test_patches_revert(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    patched, snaps = hierarchy.apply_patches(rows, "k", "v", spark.createDataFrame([(2, "z")], "k long, after string"))
    assert dict(patched.collect()) == {1: "a", 2: "z"}
    assert dict(hierarchy.revert(patched, "k", "v", snaps).collect()) == {1: "a", 2: None}


def test_library_sources(spark, tmp_path):
    (tmp_path / "people.json").write_text(json.dumps([{"id": "p1", "name": "A", "roles": ["composer"]}, {"id": "p2", "name": "B", "roles": ["soloist"]}]))
    lib = library.read_library(spark, str(tmp_path))
    assert lib["works"].count() == 0
    assert [r.id for r in library.composers_view(lib).collect()] == ["p1"]
    (tmp_path / "works.json").write_text("[{")
    with pytest.raises(Exception):
        library.read_collection(spark, str(tmp_path), "works").collect()


def test_sectioned_text(spark, tmp_path):
    (tmp_path / "d.txt").write_text("#one\na = b = a\n\n#two\nc = -\n")
    rows = library.alias_entries(library.sectioned(spark, str(tmp_path / "d.txt"))).collect()
    assert [(r[0], r[1]) for r in rows] == [("one", ["a", "b"]), ("two", ["c"])]


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{sf}/events.parquet")
    got = hosts.run_once(hosts.host_counters(hosts.event_stream(spark, sf, batch.schema)), "host_counts", str(tmp_path / "c"))
    assert got.agg(F.sum("requests"), F.sum("failures")).first() == batch.agg(F.count("*"), F.count_if(F.col("event_type") == "error")).first()


def test_prose_edges(spark):
    from shelfmark.functions import dates

    df = spark.createDataFrame([(None,), ("",), ("Sept. 3rd, 1999 2001-2-3 / 2001.02.03",), ("二百零五",), ("十",)], "c string")
    got = df.select(dates.performance_date(df.c), dates.month_days(df.c), dates.chinese_number(df.c), dates.life_span(df.c)).collect()
    assert [tuple(r) for r in got] == [("", [], 0, None), ("", [], 0, None), ("September 3, 1999", ["02-03"], 0, None), ("", [], 205, None), ("", [], 10, None)]


def test_batch_line_edges(spark):
    from shelfmark.operators import batch

    df = spark.createDataFrame([(1, None, "concerto"), (2, " \n a | b\r\n\nx|y|z|1950|u,u, v", "concerto")], "id int, text string, kind string")
    got = batch.lines(df, "text", "kind").orderBy("line").collect()
    assert [(r.id, r.line, r.slots, r.is_whole, r.title, r.links) for r in got] == [
        (2, 0, ["a", "b"], False, "a - b", []),
        (2, 1, ["x", "y", "z", "1950", "u,u, v"], True, "x - y - z - 1950", ["u", "v"]),
    ]


def test_final_states(spark):
    from shelfmark.operators import jobs

    work = spark.createDataFrame([(1, 10, None, True), (2, 10, 5, True), (3, 10, None, True), (4, 10, None, False), (5, 10, None, True), (6, 10, 12, True), (7, 10, None, None)], "job int, deadline int, stopped_at int, partial_ok boolean")
    results = spark.createDataFrame(
        [(1, "succeeded", 3), (1, "succeeded", 10), (2, "succeeded", 4), (2, "succeeded", 6), (3, "succeeded", 3), (3, None, None), (4, "partial", 3), (6, "succeeded", 11), (7, "failed", 1), (8, "failed", 1), (None, "failed", 1)],
        "job int, status string, at int",
    )
    got = {r["job"]: (r["state"], r["accepted"], r["completed"]) for r in jobs.final_states(work, results, "job").collect()}
    assert got == {1: ("succeeded", 2, 10), 2: ("canceled", 1, 5), 3: ("timed_out", 1, 10), 4: ("failed", 1, 3), 5: ("failed", 0, None), 6: ("timed_out", 0, 10), 7: ("failed", 1, 1)}
    assert jobs.final_states(work.limit(0), results, "job").count() == 0


def test_whole_batches(spark):
    from shelfmark.operators import jobs

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "a"), (3, None), (4, ""), (5, "x")], "batch int, item string")
    assert sorted(r[0] for r in jobs.whole_batches(rows, "batch", "item").collect()) == [1, 1, 5]


def test_hang_together_and_fold(spark):
    from shelfmark.operators import jobs, resolve

    rows = spark.createDataFrame(
        [(1, "p", "k", "aa", "low", "ignored", "discarded", ["x", " "]), (2, "q", "k", "bb", "high", "ignored", "viewed", ["y", "x"]), (3, "q", None, None, None, "pending", None, None), (4, "r", None, "c", "odd", "ignored", "edited", ["z"]), (5, None, None, "d", "low", "applied", "unseen", [])],
        "row int, id string, meaning string, summary string, risk string, status string, review string, sources array<string>",
    )
    got = {r["component"]: r for r in jobs.fold_proposals(resolve.hang_together(rows, "row", ["id", "meaning"]), "component", "row").collect()}
    assert set(got) == {1, 4, 5}
    one = got[1]
    assert (one["id"], one["summary"], one["risk"], one["status"], one["review"], one["merged"]) == ("p", "aa", "high", "pending", "viewed", 3)
    assert (got[4]["risk"], got[4]["status"], got[4]["review"]) == ("low", "ignored", "edited")
    assert one["sources"] == ["x", "y"]


def test_library_round_trip(spark, tmp_path):
    (tmp_path / "people.json").write_text(json.dumps([{"id": "p1", "name": "A", "roles": ["composer"], "sortKey": "9"}, {"id": "p2", "name": "B", "roles": ["soloist"]}]))
    (tmp_path / "composers.json").write_text(json.dumps([{"id": "p1", "name": "old", "sortKey": "1"}, {"id": "c", "name": "C", "sortKey": ""}]))
    lib = library.read_library(spark, str(tmp_path))
    view = {r.id: (r.name, r.sortKey) for r in library.composers_view(lib).collect()}
    assert view == {"p1": ("A", "1"), "c": ("C", "")}
    library.write_library(lib, str(tmp_path / "out"))
    again = library.read_library(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again["people"].collect())) == sorted(map(tuple, lib["people"].collect()))
    assert [r.id for r in again["composers"].collect()] == ["c"] and again["works"].count() == 0
    assert {r.collection: r.n for r in library.entity_counts(again).collect()} == {"composers": 1, "people": 2, "workGroups": 0, "works": 0, "recordings": 0}


def test_named_input(spark):
    rows = [(" Short ", "Full", None, ["a", "a "], ["AB"], "X", ["Y", "X"]), (None, None, " N ", None, None, None, None)]
    df = spark.createDataFrame(rows, "displayName string, fullName string, name string, aliases array<string>, abbreviations array<string>, country string, countries array<string>")
    got = [tuple(r) for r in library.named_input(df).select("name", "aliases", "country", "countries", "nameLatin").collect()]
    assert got == [("Full", ["a", "AB", "Short"], "Y", ["Y", "X"], ""), ("N", [], "", [], "")]


def test_profiles_and_aliases(spark, tmp_path):
    (tmp_path / "s.txt").write_text("#first\n[zh] http://a\nhttp://b\n#second\nhttp://a\n http://c \n")
    got = library.source_profiles(library.sectioned(spark, str(tmp_path / "s.txt"))).orderBy("pos").collect()
    assert [(r.section, r.url, r.language) for r in got] == [("first", "http://a", "zh"), ("first", "http://b", ""), ("second", "http://c", "")]
    entries = spark.createDataFrame([(["a", "b"],), (["c"],), (["a", "d"],)], "values array<string>")
    assert sorted(map(tuple, library.alias_pairs(entries).collect())) == [("a", "b"), ("a", "d"), ("b", "a"), ("d", "a")]
    groups = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "ord int, values array<string>")
    assert sorted(map(tuple, library.remember(groups, ["b", "x"]).collect())) == [(1, ["a", "b", "x"]), (2, ["b", "c"])]
    assert sorted(map(tuple, library.remember(groups, ["y"]).collect()))[-1] == (3, ["y"])
    assert [tuple(r) for r in library.remember(groups.limit(0), ["y"]).collect()] == [(1, ["y"])]


def test_runs_and_text_issues(spark, tmp_path):
    for name, at in (("r1", "2024-01-01"), ("r2", "2024-03-01"), ("r1", "2024-02-01")):
        library.write_run(spark.createDataFrame([(at, 1)], "createdAt string, x int"), str(tmp_path / "runs"), name)
    assert [tuple(r) for r in library.list_runs(spark, str(tmp_path / "runs")).collect()] == [("r2", "2024-03-01"), ("r1", "2024-02-01")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "t" / "b.txt").write_text("x\ufffd")
    (tmp_path / "t" / "c.txt").write_text("fine")
    assert sorted((r.file[-5:], r.issue) for r in library.text_issues(spark, str(tmp_path / "t")).collect()) == [("a.txt", "byte-order-mark"), ("b.txt", "replacement-character")]


def test_side_files_and_snapshots(spark, tmp_path):
    (tmp_path / "articles.json").write_text(json.dumps([{"id": "a", "showOnHome": True}]))
    (tmp_path / "person-links.json").write_text(json.dumps({"canonicalPersonLinks": {"x": "y", "z": ""}}))
    assert [(r.id, r.showOnHome) for r in library.read_side(spark, str(tmp_path), "articles").collect()] == [("a", True)]
    assert library.read_side(spark, str(tmp_path), "review-queue").count() == 0
    assert [tuple(r) for r in library.read_person_links(spark, str(tmp_path)).collect()] == [("x", "y")]
    assert library.read_person_links(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "manual-backfills.json").write_text(json.dumps([{"recordingId": "r", "credits": [{"role": "singer", "displayName": "S"}], "metadata": {"venueText": "V"}}]))
    got = library.read_side(spark, str(tmp_path), "manual-backfills").first()
    assert got.credits[0].displayName == "S" and got.metadata == {"venueText": "V"} and got.removeCredits is None
    library.write_artifacts({"one": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "one")).count() == 3
    rows = spark.createDataFrame([("i", "s", 2, "b"), ("i", "s", 1, "a"), ("i", "t", 1, "c")], "item_id string, stage string, pos int, payload string")
    library.record_stage(rows, str(tmp_path / "snap"))
    items = spark.createDataFrame([("i",), ("j",)], "item_id string")
    assert {r.item_id: r.payloads for r in library.replayed(spark, str(tmp_path / "snap"), items, "s").collect()} == {"i": ["a", "b"], "j": []}


def test_warnings_keep_all_their_texts(spark):
    from shelfmark.operators import evidence

    rows = spark.createDataFrame([(f"第{i}条URL", "ok" if i % 2 else "open") for i in range(30) for _ in range(2)], "text string, status string")
    assert [tuple(r) for r in evidence.warning_corpus(rows).collect()] == [("第#条URL", 60, 30, "第0条URL", {"ok": 30, "open": 30})]
    assert {r["text"] for r in evidence.warning_texts(rows).collect()} == {f"第{i}条URL" for i in range(30)}


def test_near_names_tell_copies_by_their_class(spark):
    rows = [(i, "anna maria sopranino") for i in range(50)] + [(100 + i, "anna maria soprano") for i in range(50)] + [(200, "anna maria baritone")]
    got = {(r.a, r.b): r.distance for r in resolve.near_names(spark.createDataFrame(rows, "id long, name string"), "id", F.col("name")).collect()}
    assert got == {(0, i): 0 for i in range(1, 50)} | {(100, 100 + i): 0 for i in range(1, 50)} | {(0, 100): 2}


def test_heavy_steps_are_spread_and_drafts_told_once(spark):
    from shelfmark.functions import scoring
    from shelfmark.plans import planner

    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").coalesce(1)
    assert planner.searches(t).rdd.getNumPartitions() == 4 and planner._drafted(t).rdd.getNumPartitions() == 4
    none, lit = F.array().cast("array<string>"), F.lit
    d = {"work": lit("Violin Sonata"), "work_latin": lit("Violin Sonata"), "catalogue": lit("Op. 24"), "composer": lit("X"), "composer_latin": lit("X"), "title": lit(""), "day": lit("May 1950"), "raw": lit(""), "slots": F.array(F.array(lit("Anna Berg"))), "ensembles": none, "ensembles_latin": none}
    known = spark.range(1).select(scoring.known(d).alias("k"), lit("Berg: Sonata for violin, op.24: I. Allegro 1950").alias("text"))
    facts = scoring.with_facts(known, F.col("text"), lit("u"), lit(""), F.col("k"))
    got = facts.withColumns(scoring.terms(lit(0), lit(False))).first()
    assert (got.h_work, got.h_leads, got.h_years, got.h_single) == (True, 1, 1, True) and (got.work, got.years, got.marks, got.kind) == (0.25, 0.08, 0.0, -0.08)


def test_host_plans_read_their_rows_once(spark):
    from shelfmark.operators import host_plan

    rows = spark.createDataFrame([(1, "latin", 0, "Anna Berg concerto 1950", ["named_duo"])], "item long, generator string, position int, query string, anchors array<string>")
    items = spark.createDataFrame([(1, "Op. 1", "", "", [["Anna"]], False, [""], False, True)], "item long, catalogue string, work string, composer string, slots array<array<string>>, joint_first boolean, mentions array<string>, spare_bundles boolean, dated boolean")
    for plan in (host_plan.CHINESE, host_plan.OTHER):
        out = host_plan.planned(rows, items, plan)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
        assert [(r.ordinal, r.query) for r in out.collect()] == [(1, "Anna Berg concerto 1950 Op. 1")]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draft_queries_work_after_rows_are_dealt(spark):
    from shelfmark.plans import catalogue, planner  # noqa: F401  planner adds the query

    plan = _optimized(catalogue.QUERIES["draft_queries"](spark, "/root/testdata/sf0.001"))
    above, below = plan.split("RepartitionByExpression")
    assert "array_distinct" in above and "array_distinct" not in below and "Filter" not in below


def test_paragraphs_are_read_once_each(spark):
    from shelfmark.functions import legacy

    page = spark.createDataFrame([([("Date :  2001, Wien ", None), ("no label", None), ("Conductor: A", " B ")],)], "p array<struct<text:string,link:string>>")
    out = page.select(legacy.said(F.col("p")).alias("said"))
    assert _optimized(out).count("regexp_extract(") == 2
    assert [tuple(x) for x in out.first()[0]] == [("when", "Date", "2001, Wien", "2001, Wien"), ("credit", "Conductor", "A", "B")]


def test_links_are_assembled_in_few_sorts(spark):
    """A task's memory is what its sorts hold: lines by part, items, candidates by platform and by place, however many stages there are."""
    from shelfmark.plans import assembly, catalogue  # noqa: F401  assembly adds the query

    plan = catalogue.QUERIES["assembled_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 4 and "BroadcastHashJoin" not in plan


def test_places_are_told_without_an_order(spark):
    from shelfmark.operators import assembly

    rows = [(1, "a", 0, 0.5, True), (1, "b", 1, 0.5, True), (1, "a", 2, 0.9, False), (1, "b", 3, None, True), (1, "a", 4, 0.7, None), (2, "a", 0, None, True)]
    df = spark.createDataFrame(rows, "item int, platform string, pos int, x double, want boolean")
    put = lambda most, over: {(r.item, r.pos): r._place for r in assembly._places(df, F.col("want"), F.col("x"), over, most).collect() if r._place}
    assert put(2, assembly.ITEM) == {(1, 0): 1, (1, 1): 2, (2, 0): 1}
    assert put(9, assembly.ITEM) == {(1, 0): 1, (1, 1): 2, (1, 3): 3, (2, 0): 1}
    assert put(1, assembly.PLATFORM) == {(1, 0): 1, (1, 1): 1, (2, 0): 1}


def test_search_index_takes_credits_apart_once(spark):
    """Credits are read for their texts (Arrow, of those that name no person) and for the rest, and put together in one aggregate."""
    from shelfmark.operators import indexes

    credit = "struct<role:string,personId:string,displayName:string,label:string>"
    who = spark.createDataFrame([("p1", "a", "Anna Berg", "", "", [], [], ["conductor"]), ("p2", "b", "Bea Tal", "", "", [], [], ["soloist"])], "id string, slug string, name string, nameLatin string, country string, countries array<string>, aliases array<string>, roles array<string>")
    groups = spark.createDataFrame([], "id string, composerId string, title string, path array<string>")
    works = spark.createDataFrame([("w1", "p1", [], "Sonata", "", [], "")], "id string, composerId string, groupIds array<string>, title string, titleLatin string, aliases array<string>, catalogue string")
    made = [
        ("r1", [("conductor", "p3", "Other", "x"), ("soloist", "p1", "Anna", ""), ("soloist", "p2", "Bea", ""), ("soloist", "p2", "Again", ""), ("soloist", "", "Ｘ.Y", ""), ("soloist", None, "x y", "")]),
        ("r2", []), ("r3", None), ("r4", [("reader", "p9", "Read Er", "")]),
    ]
    recordings = spark.createDataFrame([(i, "w1", "Old", "concerto", "1950", "", "", c) for i, c in made], f"id string, workId string, title string, workTypeHint string, performanceDateText string, venueText string, notes string, credits array<{credit}>")
    links = spark.createDataFrame([("p3", "p1")], "alias string, canonical string")
    out = indexes.search_index({"composers": who, "people": who, "workGroups": groups, "works": works, "recordings": recordings}, links)
    got = {r.id: (r.primary_text, r.match_tokens) for r in out.filter("kind = 'recording'").collect()}
    said = ["Other", "x", "p3", "Anna", "p1", "Bea", "p2", "Again", "Ｘ.Y", "x y"]
    assert got["r1"] == ("Anna Berg - Bea Tal - Ｘ.Y - 1950", ["Anna Berg - Bea Tal - Ｘ.Y - 1950", "Sonata", "Anna Berg", "1950", *said])
    assert got["r2"][0] == got["r3"][0] == got["r4"][0] == "1950" and got["r4"][1] == ["1950", "Sonata", "Anna Berg", "Read Er", "p9"]
    plan = _optimized(out.filter("kind = 'recording'").select("kind", "id", "primary_text", "secondary_text", "href"))
    assert len(re.findall(r"Aggregate \[id.*collect_list", plan)) == 1 and plan.count("ArrowEvalPython") == 1


def test_search_index_holds_tokens_and_articles(spark):
    """Albums and labels are searched by, articles are entries, null arrays don't take the other tokens with them; the query shows all of it."""
    from shelfmark.operators import indexes
    from shelfmark.plans import catalogue, library  # noqa: F401, F811  library adds its queries to catalogue

    credit = "struct<role:string,personId:string,displayName:string,label:string>"
    who = spark.createDataFrame([("p1", "a", "Anna Berg", "", "", [], ["AB"], ["conductor"])], "id string, slug string, name string, nameLatin string, country string, countries array<string>, aliases array<string>, roles array<string>")
    groups = spark.createDataFrame([("g1", "p1", "Trios", None)], "id string, composerId string, title string, path array<string>")
    works = spark.createDataFrame([("w1", "p1", ["g1"], "Sonata", "Sonate", None, "")], "id string, composerId string, groupIds array<string>, title string, titleLatin string, aliases array<string>, catalogue string")
    made = [("r1", " Album ", "Label", [("soloist", "p1", "Anna", "")]), ("r2", None, "", None)]
    recordings = spark.createDataFrame([(i, "w1", "Old", "solo", "1950", "", "", a, b, c) for i, a, b, c in made], f"id string, workId string, title string, workTypeHint string, performanceDateText string, venueText string, notes string, albumTitle string, label string, credits array<{credit}>")
    articles = spark.createDataFrame([("a1", "on-trios", "On trios", None, " Text\nof it\n")], "id string, slug string, title string, summary string, markdown string")
    lib = {"composers": who, "people": who, "workGroups": groups, "works": works, "recordings": recordings, "articles": articles}
    got = {(r.kind, r.id): r for r in indexes.search_index(lib, spark.createDataFrame([], "alias string, canonical string")).collect()}
    assert got["recording", "r1"].match_tokens == ["Anna Berg - 1950", "Sonata", "Sonate", "Anna Berg", "1950", "Album", "Label", "Anna", "p1"]
    assert got["recording", "r2"].match_tokens == ["1950", "Sonata", "Sonate", "Anna Berg"]
    assert got["workGroup", "g1"].match_tokens == ["Trios", "Anna Berg"] and got["work", "w1"].match_tokens == ["Sonata", "Sonate", "Trios", "Anna Berg"]
    a = got["article", "a1"]
    assert (a.primary_text, a.href, a.match_tokens, a.alias_tokens) == ("On trios", "/columns/on-trios/", ["On trios", "on-trios", "Text\nof it"], [])
    assert got["conductor", "p1"].alias_tokens == ["AB", "Anna Berg"]

    shown = catalogue.QUERIES["search_index"](spark, "/root/testdata/sf0.001")
    kinds = {r.kind: r for r in shown.groupBy("kind").agg(F.count("*").alias("n"), F.min("n_tokens").alias("least"), F.max(F.length("alias_tokens")).alias("alias")).collect()}
    assert kinds["article"].n == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.least > 0 for r in kinds.values()) and kinds["composer"].alias > 0 and kinds["work"].alias > 0


def test_arrow_sees_no_credits_that_name_people(spark):
    from shelfmark.operators import display

    credit = "struct<role:string,personId:string,displayName:string,label:string>"
    people = spark.createDataFrame([("p1", "Anna", "", [])], "id string, name string, nameLatin string, aliases array<string>")
    r = spark.createDataFrame([("r1", [("conductor", "p1", "A", "")])], f"id string, credits array<{credit}>")
    plan = _optimized(display.credit_displays(r, people))
    below = plan.split("ArrowEvalPython", 1)[1].split("Generate", 1)[0]
    assert "Filter" in below and "personId" in below
