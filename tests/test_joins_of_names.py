"""Joins of names against brute force, and how many rows they bring together; components and choices of queries on hard cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import evidence, people, query_choice, resolve, second_pass, shared


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(12, 20))) for _ in range(40)]
    names = list(base)
    for b in base:
        for _ in range(3):
            s = list(b)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(s))
                s[k : k + 1] = r.choice([[], [s[k], r.choice("abcxyz")], [r.choice("abcxyz")]])
            names.append("".join(s))
    names = [n for n in names if len(n) > 5]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(x.a, x.b): x.distance for x in resolve.near_pairs(df, df, 2).collect()}
    want = {(i, j): d for i, a in enumerate(names) for j, b in enumerate(names) if (d := distance(a, b)) <= 2}
    assert got == want


def test_contained_against_all_pairs(spark):
    r = random.Random(5)
    long = {"".join(r.choice("ab") for _ in range(r.randint(1, 14))) for _ in range(150)}
    short = {"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(60)}
    got = people.contained(spark.createDataFrame([(s,) for s in short], "s string"), "s", spark.createDataFrame([(x,) for x in long], "l string"), "l", 5)
    assert {tuple(x) for x in got.collect()} == {(s, x) for s in short for x in long if s in x and s != x}


def test_a_common_head_brings_nobody_together(spark):
    """20,000 credits and 20,000 people of one title: the join on the rarest strings stays near one row each, where all pairs are 400 million."""
    n = 20_000
    short = spark.range(n).select(F.format_string("maestrokim%05d", "id").alias("s"))
    long = spark.range(n).select(F.format_string("maestrolee%05dx", "id").alias("l"))
    assert people.contained(short, "s", long, "l", 5).count() == 0
    more = long.unionByName(short.select(F.concat("s", F.lit("junior")).alias("l")))
    assert people.contained(short, "s", more, "l", 5).count() == n


def test_components_of_long_chains(spark):
    """Three chains of 1,000 rows, in mixed order: a row shares x with the next or with the one before, and y with the other."""
    r = random.Random(6)
    order = list(range(3000))
    r.shuffle(order)
    rows = [(order[i], f"{i // 1000}-{i % 1000 // 2}", f"{i // 1000}-{(i % 1000 + 1) // 2}") for i in range(3000)] + [(5000, None, None), (5001, None, "9")]
    got = {x.row: x.component for x in resolve.hang_together(spark.createDataFrame(rows, "row int, x string, y string"), "row", ["x", "y"]).collect()}
    for part in range(3):
        members = [order[i] for i in range(1000 * part, 1000 * (part + 1))]
        assert {got[m] for m in members} == {min(members)}
    assert (got[5000], got[5001]) == (5000, 5001)


def test_alignment_counts_one_sided_keys(spark):
    ours = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "k int, f string")
    theirs = spark.createDataFrame([(1, "a"), (4, "b"), (None, "m")], "k int, f string")
    assert [tuple(r) for r in evidence.alignment(ours, theirs, "k", ["f"]).collect()] == [("f", 1, 1, 3)]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_picks_of_few_and_none(spark, most):
    rows = spark.createDataFrame([(1, k, q) for k, q in enumerate(["a b", " A B ", "", None, "x concerto 1950", "anna bell carl", "z", "钢协 anna bell"])], "item int, position int, query string")
    got = [r["query"] for r in query_choice.spelled(query_choice.picked(query_choice.pools(rows), most), "picks").orderBy("ordinal").collect()]
    every = ["a b", "x concerto 1950", "anna bell carl", "z", "钢协 anna bell"]
    assert got == {0: [], 1: every[:1], 2: every[:2], 3: [*every[:2], every[4]], 5: every}[most]
    assert [r.ordinal for r in query_choice.spelled(query_choice.prepared(query_choice.pools(rows), 3), "chosen").orderBy("ordinal").collect()] == [1, 2, 3]


def test_near_tails_are_all_pairs_by_brute_force(spark):
    """Pairs with one head and two edits at most, short names by what is left of them, long ones by grams; fits keeps the rest out (F9)."""
    names = [f"maestro {n}" for n in range(985, 1030)] + ["maestro ", "maestro x", "maestro 9", "other 1000"]
    names += ["a very lo" + "ng" * k + end for k in (17, 18, 19, 30) for end in ("", "x", "yx", "yyx", "xyxy")]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    left, right = rows.select(F.col("id").alias("x"), F.col("name").alias("p")), rows.select(F.col("id").alias("y"), F.col("name").alias("q"))
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and a[:8] == b[:8] and distance(a, b) <= 2}
    met = resolve.near_tails(left, "p", right, "q", 8, 2, F.col("x") != F.col("y"))
    assert {(r.x, r.y) for r in met.collect()} == want


def test_queries_are_prepared_of_pools_made_once(spark):
    """Each size as it is prepared alone (F12)."""
    rows = spark.createDataFrame([(i, p, f"song {p * i % 7} concerto {1940 + p}" if p % 3 else f"Spring {i} Beethoven {p}") for i in (1, 2) for p in range(9)], "item long, position long, query string")
    pools = query_choice.pools(rows)
    want = {(r.item, m, r.ordinal, r.query) for m in (3, 6) for r in query_choice.spelled(query_choice.prepared(pools, m), "chosen").collect()}
    each = query_choice.prepared_each(pools, (3, 6))
    assert {(r.item, r.most, r.ordinal, r.query) for r in each.collect()} == want
    assert each._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_facts_of_triggers_are_read_once(spark):
    """One plan over the queries, however many kinds of words are counted (F10, F13, F20)."""
    asked = spark.createDataFrame([(1, 1, "anna karl spring sonata"), (1, 2, "Anna / Karl spring"), (2, 1, " "), (3, 1, "陈安娜 春天")], "item long, position long, query string")
    first = spark.createDataFrame([(3, "陈安娜 spring")], "item long, text string")
    out = second_pass.triggers(asked, first)
    assert {(r.item, *r.duo_tokens, r.duo, *r.solo_tokens, r.solo) for r in out.collect()} == {(1, "anna", "karl", True, "anna", "karl", True), (3, False, "陈安娜", False)}
    assert len(re.findall("query#[0-9]+", out._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD", 1)[1])) == 1


def test_larger_tables_are_spread_over_more_tasks(spark):
    """Tasks don't grow with the table (F19)."""
    rows = spark.range(1000)
    assert shared.spread(rows, "id", rows=50).rdd.getNumPartitions() == 20
    assert shared.spread(rows, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
