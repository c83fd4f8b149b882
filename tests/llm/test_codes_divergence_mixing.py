"""Vector codes, source divergence and source mixing on odd tables: against the SQL of the contract, and against plain Python."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import codes, divergence, mixing

rng = np.random.default_rng(5)
WORDS = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]


def prose(n, spread=200):
    return " ".join(WORDS[int(i)] for i in (rng.random(n) ** 2 * spread))


SAME = prose(30)
DOCS = [
    (None, None, None, None), (None, "", "en", None), (None, SAME, "en", ""), (None, SAME, "en", ""), (None, SAME, "en", ""), (1, SAME, "en", "a"), (1, SAME, "en", "a"),
    (1, "  \x0b\x0c   x", "", "a"), (2, "ÄÖ äö Straße ÉÉ", "de", "ß"), (3, "\t\n 12 34", "de", "\U0001f600"), (4, "one", None, "￿"), (5, None, "zz", "only"), (2**62, prose(5000), "en", "B"),
    *((i, prose(int(rng.integers(0, 60)), 40 + 50 * (i % 4)), ("en", "de")[i % 2], f"s{i % 5}") for i in range(100, 220)), *((i, prose(3), "en", f"t{i}") for i in range(300, 330)),
]


def same_rows(df, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.fixture(scope="module")
def docs(spark):
    clashing = {c: F.lit(c) for c in ("key", "size", "digest", "TERM", "n", "p", "rank", "part", "value", "copy")}
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns(clashing).repartition(3)


@pytest.fixture(scope="module")
def table():
    frame = pd.DataFrame(DOCS, columns=["doc_id", "text", "lang", "source"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def test_mixing_equals_sql(docs, table):
    same_rows(mixing.mixed(docs), mixing.SQL, documents=table)
    same_rows(mixing.mixed(docs, block=7), mixing.SQL, documents=table)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mixed(docs.filter("text is null")).collect()} == {0}


def test_mixing_in_runs(docs, table, monkeypatch):
    """Runs, strides and spans of a few rows: the same mix."""
    monkeypatch.setattr(mixing, "RUN", 1)
    monkeypatch.setattr(mixing, "SPAN", 3)
    same_rows(mixing.mixed(docs, block=40), mixing.SQL, documents=table)


def test_targets_against_rounds(spark):
    """Shares in rounds, as the contract words them."""
    sizes = {f"s{i:02}": int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for i in range(40)} | {"z": 0, None: 12_345}
    rows = [(k and "0" + k or "1", None, n, "x", 1) for k, n in sizes.items()]
    got = {r.key: r for r in mixing.targets(spark.createDataFrame(rows, "key string, doc_id long, size long, digest string, copies long")).collect()}
    names = sorted(got)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while rest > 1e-6:
        unit = rest / sum(weight[k] for k in free)
        for k in free:
            target[k] += unit * weight[k]
        rest = 0.0
        for k in list(free):
            if target[k] > 3 * got[k].source_size:
                rest += target[k] - 3 * got[k].source_size
                target[k] = 3.0 * got[k].source_size
                free.discard(k)
    for k in names:
        assert math.isclose(got[k].target, target[k], rel_tol=1e-9, abs_tol=1e-6)
    laid = sorted((r.first, r.slots) for r in got.values())
    assert [a for a, _ in laid] == np.concatenate([[0], np.cumsum([n for _, n in laid])[:-1]]).tolist()


def test_pieces_make_whole_blocks(docs):
    laid, sources = mixing.placed(docs, 16)
    blocks, words, of = defaultdict(int), defaultdict(int), {r.key: r for r in sources.collect()}
    seen = defaultdict(list)
    for r in mixing.pieces(laid, sources, 16).collect():
        assert 0 <= r.start and r.words > 0 and r.start + r.words <= r.size
        blocks[r.key, r.time] += r.words
        words[r.key] += r.words
        seen[r.key, r.digest, r.copy, r["pass"]].append((r.start, r.start + r.words))
    assert {k: n for k, n in words.items()} == {k: r.words for k, r in of.items() if r.words}
    short = Counter(k for (k, _), n in blocks.items() if n < 16)
    assert max(blocks.values()) == 16 and max(short.values(), default=0) <= 1
    for spans in seen.values():  # no word twice in a pass
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    times = sorted(t for _, t in blocks)
    assert len(set(times)) == len(times)


def test_schedule_is_even(spark):
    """In every prefix of the schedule a source's slots stay within a few of its share."""
    slots = [700, 30, 1, 0, 260, 9]
    rows = [(f"0{i}", n, sum(slots[:i])) for i, n in enumerate(slots)]
    order = [r.key for r in mixing.schedule(spark.createDataFrame(rows, "key string, slots long, first long")).orderBy("time").collect()]
    assert Counter(order) == Counter({f"0{i}": n for i, n in enumerate(slots) if n})
    for i, n in enumerate(slots):
        got = np.cumsum([k == f"0{i}" for k in order])
        assert np.abs(got - np.arange(1, len(order) + 1) * n / sum(slots)).max() < 5
    ranks = mixing.schedule(spark.createDataFrame(rows, "key string, slots long, first long")).orderBy("key", "time").collect()
    for i, n in enumerate(slots):
        assert [r["rank"] for r in ranks if r.key == f"0{i}"] == list(range(n))


def test_lattice_takes_every_point_once():
    for n in (0, 1, 2, 3, 4, 100, 1597):
        q, inverse = mixing.lattice(n)
        assert q >= n and sorted(u * inverse % q for u in range(q)) == list(range(q))
    with pytest.raises(ValueError):
        mixing.lattice(1 << 42)


def test_divergence_equals_sql(docs, table):
    same_rows(divergence.audit(docs), divergence.SQL, documents=table)
    assert divergence.audit(docs.limit(0)).count() == 0
    lonely = docs.filter("text is null")
    assert all(r.value == 0 and r.part == "pair" for r in divergence.audit(lonely).collect())


@pytest.mark.parametrize("k", [1, 2, 5, 17])
def test_bounded_search_finds_the_best(spark, docs, k):
    """Fewer than a bucket holds, ties at the last rank: the same as ranking every term."""
    every = [r for r in divergence.audit(docs, k=10**6).collect() if r.part == "term"]
    assert len(every) > 300
    got = [r for r in divergence.audit(docs, k=k).collect() if r.part == "term"]
    assert sorted(got) == sorted(r for r in every if r["rank"] <= k)


def test_terms_in_slices(monkeypatch):
    text = " ".join("Äpfel birne-Quitte 12 x" for _ in range(50))
    whole = divergence.term_counts(text)
    assert whole == Counter({"Äpfel".encode(): 50, b"birne": 50, b"quitte": 50, b"x": 50})
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert divergence.term_counts(text) == whole
    monkeypatch.setattr(divergence, "HELD", 2)  # hands on after nearly every text
    import pyarrow as pa

    batch = pa.record_batch({"lang": ["a", "b", "a"], "source": ["s", "s", "s"], "text": ["x y z", "x", "x x"]})
    found = [r for b in divergence._count(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in found) == 6 and sum(r["documents"] for r in found) == 5


def vectors_of(n, copies):
    made = (rng.normal(0, 0.3, (n, 32)) * (1 + np.arange(32) % 3)).astype(np.float32).tolist()
    rows = [(i if i % 50 else None, v, f"l{i % 4}" if i % 9 else None) for i, v in enumerate(made)] + [(7, made[0], "")] * copies
    bad = [[None] * 32, [float("nan")] * 32, [float("inf")] + [0.0] * 31, None]
    return rows + [(10_000 + i, v, "l1") for i, v in enumerate(bad)]


@pytest.mark.parametrize("n, copies", [(1, 0), (40, 0), (200, 300)])
def test_codes_equal_sql(spark, n, copies):
    rows = vectors_of(n, copies)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumns({c: F.lit(c) for c in ("row", "part", "N", "code", "error", "position")})
    table = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    table["vec_id"] = table["vec_id"].astype("Int64")
    same_rows(codes.digests(frame), codes.SQL.replace("FROM embeddings", "FROM (SELECT * REPLACE (CAST(embedding AS FLOAT[]) AS embedding) FROM embeddings)"), embeddings=table)
    assert codes.digests(frame.limit(0)).count() == 0
    assert codes.digests(frame.filter("vec_id >= 10000")).count() == 0


def test_codes_against_plain_lloyd(spark):
    """Plain rounds over every vector, in Python's integers."""
    made = [[float(x) for x in rng.integers(-3, 4, 16)] for _ in range(300)]
    found, books = codes.compressed(spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<double>").withColumn("label", F.lit(1)), entries=5, rounds=3)
    got = {r.vec_id: (r.code, r.error) for r in found.collect()}
    ints = [[math.floor(256 * x) for x in v] for v in made]
    plain = [[[v[p]] for v in ints[:5]] for p in range(16)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip([v[p]], e)), i) for i, e in enumerate(plain[p]))
    for _ in range(3):
        held = [[[] for _ in range(5)] for _ in range(16)]
        for v in ints:
            for p in range(16):
                held[p][near(p, v)[1]].append(v[p])
        plain = [[[sum(h) // len(h)] if h else plain[p][i] for i, h in enumerate(held[p])] for p in range(16)]
    assert books.tolist() == plain
    for i, v in enumerate(ints):
        best = [near(p, v) for p in range(16)]
        assert got[i] == ("".join(f"{c:02x}" for _, c in best), sum(d for d, _ in best))


def test_codes_errors(spark):
    uneven = spark.createDataFrame([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        codes.digests(uneven)
    big = np.array([[2**31]]), np.array([[-(2**31)]])
    with pytest.raises(ValueError):
        codes.nearest(*big)
    assert codes.nearest(np.array([[2**29]]), np.array([[0], [2**29 - 1]]))[1].tolist() == [1]
