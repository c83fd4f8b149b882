"""Every operator and stage on odd tables; the pipeline, stage by stage and as a whole, against plain Python."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import common, decontaminate, line_dedup, near_duplicates, neighbours, packing, pii, quality, queries, suffix_dedup, toxicity, warc

rng = np.random.default_rng(11)
VOCAB = [f"wort{i}" if i % 3 else f"wort{i}ä" for i in range(400)]
#: Names that operators use themselves, in other cases too.
CLASHING = ["_row", "_at", "_cut", "_WHO", "_what", "_score", "_text", "_n_hit", "_whole", "_Key_id", "_t1", "_r1", "n", "h", "key", "place", "first", "w", "item", "s", "a", "b", "m", "rep", "top", "score", "spans", "ids", "length", "rank", "y"]


def prose(n):
    return " ".join(VOCAB[i] for i in rng.integers(0, len(VOCAB), n))


LONG = "\n".join(prose(12) for _ in range(4000))
SAME = prose(60)
ROWS = [(None, None), (None, ""), (None, SAME), (1, SAME), (1, SAME), (1, SAME), (1, prose(5)), (2, None), (2, ""), (3, LONG), (4, LONG), (5, "\n\n\n"), (6, "a b"), (6, "a b"), (-7, SAME + " end"), (8, "ß" * 300), (9, "é\x00  1.2.3.4 a@b.cd"), (2**62, prose(80))]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def side(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (3, None), (5, 0), (-7, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, SAME), (None, "a b"), (2, None), (3, ""), (1, SAME)], "item_id long, text string")
    return labels, items


def by_row(docs, side):
    labels, items = side
    return {
        "line_dedup": lambda: line_dedup.dedup_lines(docs),
        "quality": lambda: quality.scored(docs),
        "decontamination": lambda: decontaminate.contamination(docs, items),
        "toxicity": lambda: toxicity.scored(docs, labels),
        "suffix_dedup": lambda: suffix_dedup.dedup_bytes(docs),
        "near_duplicates": lambda: near_duplicates.classes(docs),
        "pii": lambda: pii.find(docs),
        "packing": lambda: packing.packed_digests(docs, queries.tokenizer_path()).filter("piece = 0"),
    }


@pytest.mark.parametrize("name", ["line_dedup", "quality", "decontamination", "toxicity", "suffix_dedup", "near_duplicates", "pii", "packing"])
def test_a_row_for_each_row(docs, side, name):
    """Nulls, empty and very long texts, repeated rows and ids, columns of names that operators use, empty tables."""
    got = by_row(docs, side)[name]()
    order = lambda xs: sorted(map(str, xs))
    assert order(r.doc_id for r in got.select("doc_id").collect()) == order(i for i, _ in ROWS)
    if name == "line_dedup":
        assert got.drop("n_lines", "n_removed").columns == docs.columns
        kept = got.select(*CLASHING).distinct().collect()
        assert len(kept) == 1 and list(kept[0]) == [f"own {c}" for c in CLASHING]
    same = got.filter("doc_id = 1").drop("sequence_id", "offset").distinct().count()
    assert same <= 2  # rows that are equal are judged alike
    assert by_row(docs.limit(0), side)[name]().count() == 0


def plain_words(text):
    return [w.decode() for w in common.word_list(text)]


def plain_set(text):
    w = plain_words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(sets):
    """Number of the group of each set: sets at 0.8 hang together; empty ones are alone."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def test_stages_keep_columns_and_the_right_rows(spark, docs, side):
    labels, items = side
    order = lambda xs: sorted(map(str, xs))
    for kept in (toxicity.clean(docs, labels), near_duplicates.keep_one(docs), decontaminate.clean(docs, items)):
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.select(*CLASHING).collect()} <= {tuple(f"own {c}" for c in CLASHING)}
    kept = [tuple(r) for r in near_duplicates.keep_one(docs).select("doc_id", "text").collect()]
    groups = plain_groups([plain_set(t) for _, t in ROWS])
    filled = {g for g, (_, t) in zip(groups, ROWS) if plain_set(t)}
    assert len(kept) == len(filled) + sum(not plain_set(t) for _, t in ROWS)
    clean = decontaminate.clean(docs, items).select("doc_id", "text").collect()
    assert order(tuple(r) for r in clean) == order(plain_decontamination(ROWS, [SAME, "a b", None, ""]))
    for f in (lambda d: toxicity.clean(d, labels), near_duplicates.keep_one, lambda d: decontaminate.clean(d, items)):
        assert f(docs.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)
    assert toxicity.clean(docs, labels.limit(0)).count() == len(ROWS)


def test_warc_odd_pages(spark, tmp_path):
    rows = [(None, None, None), (None, None, "x"), (1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (2, "", ""), (3, "\n", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("n", F.lit(2))
    got = warc.round_trip(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted([("None", 0, "revisit", 2), ("None", 1, "revisit", 1), ("1", 1, "response", None), ("1", 1, "response", None), ("1", 1, "response", None), ("2", 0, "response", None), ("3", len(LONG.encode()), "response", None)])
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = f"file://{tmp_path}/archives"
    index = warc.write(pages, folder, least=5).select("file", "offset", "length", "page_id", "record_type")
    assert {r.record_type for r in index.filter("page_id IS NOT NULL").collect()} == {"response"}  # all payloads but one are below `least`
    back = warc.read(index.filter("page_id = 3"), folder).collect()
    assert [r.payload.decode() for r in back] == [LONG]
    names, small = [], warc.SHARE
    try:
        warc.SHARE = 100
        assert warc.read(index, folder).rdd.getNumPartitions() > 1
    finally:
        warc.SHARE = small
    for file in {r.file for r in index.collect()}:
        with open(file, "rb") as f:
            data = f.read()
        names += [warc.parse(data[r.offset : r.offset + r.length])[0]["WARC-Record-ID"] for r in index.filter(F.col("file") == file).collect()]
    assert len(names) == len(set(names)) == len(rows)


def test_neighbours_odd_vectors(spark):
    x = np.random.default_rng(3).standard_normal((300, 8)) * 1e7
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (None, x[0].tolist()), (400, [1.0] * 7), (401, []), (402, [float("inf")] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "hash", "depth", "t", "p", "v")})
    got = {}
    for r in neighbours.search(v, v.filter("vec_id % 20 = 0"), share=20.0).collect():  # every candidate is met
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        assert [found[k] for k in range(1, 21)] == np.lexsort((np.arange(300), -s))[:20].tolist()


def test_posteriors_by_plain_expectation_maximisation():
    """The same steps written with loops over documents."""
    r = np.random.default_rng(6)
    good = r.random(300) < 0.7
    votes = [tuple(int(x) for x in np.where(r.random(7) < 0.25, 0, np.where(r.random(7) < 0.85, 1, -1) * (1 if g else -1))) for g in good]
    count = {}
    for v in votes:
        count[quality._code(v)] = count.get(quality._code(v), 0) + 1
    got = quality.expectation_maximisation(count)
    q = [min(0.95, max(0.05, 0.7 + 0.3 * (sum(x == 1 for x in v) - 2 * sum(x == -1 for x in v)) / 7)) for v in votes]
    for _ in range(quality.ROUNDS):
        rate = [[[0.5, 0.5] for _ in range(3)] for _ in range(7)]
        for v, p in zip(votes, q, strict=True):
            for i, x in enumerate(v):
                rate[i][x + 1][0] += 1 - p
                rate[i][x + 1][1] += p
        for i in range(7):
            for c in (0, 1):
                total = sum(rate[i][x][c] for x in range(3))
                for x in range(3):
                    rate[i][x][c] /= total
        prior = min(0.99, max(0.01, sum(q) / len(q)))
        new = []
        for v in votes:
            a, b = 1 - prior, prior
            for i, x in enumerate(v):
                a *= rate[i][x + 1][0]
                b *= rate[i][x + 1][1]
            new.append(b / (a + b))
        q = new
    assert max(abs(got[quality._code(v)] - p) for v, p in zip(votes, q, strict=True)) < 1e-6
    assert np.mean([(got[quality._code(v)] > 0.5) == g for v, g in zip(votes, good, strict=True)]) > 0.95


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents, labels and benchmark with toxic rows, repeated lines, copies and benchmark passages planted."""
    sf = str(tmp_path_factory.mktemp("sf"))
    lines = [prose(9) for _ in range(4)]
    passage, bad = prose(60), ["vile", "awful", "nasty"]
    texts = [prose(int(rng.integers(20, 80))) for _ in range(500)]
    for i in range(0, 500, 5):
        texts[i] += f" {bad[i % 3]}"
    for i in (11, 41, 71, 101):
        texts[i] = "\n".join([texts[i], *lines, prose(8)])
    for i in (21, 51, 81):
        texts[i] = texts[6]
    texts[91] = texts[6] + " more"
    for i in (31, 61):
        texts[i] = prose(20) + " " + passage + " " + prose(15)
    texts[121] = prose(900) + " " + " ".join(passage.split()[:13])  # held, but too little of it
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(600, None, "en", "s", 0), (601, "", "en", None, 0), (602, prose(2500), "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, passage), (8, prose(30)), (9, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def plain_line_dedup(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((i, None))
            continue
        ls, gone = t.split("\n"), set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if "".join(w).strip():
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return out


def plain_near_duplicates(rows):
    rows = sorted(rows, key=lambda r: r[0])
    sets = [plain_set(t) for _, t in rows]
    seen, out = set(), []
    for row, s, g in zip(rows, sets, plain_groups(sets), strict=True):
        if not s or g not in seen:
            out.append(row)
            seen.add(g)
    return out


def plain_decontamination(rows, items):
    windows = set()
    for t in items:
        w = plain_words(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    out = []
    for i, t in rows:
        w, hit = plain_words(t), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t))
    return out


def test_pipeline_by_plain_python(spark, corpus):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    judged = {r.doc_id: r.predicted for r in toxicity.scored(docs, spark.read.parquet(f"{corpus}/labels.parquet")).collect()}
    assert np.mean([judged[i] == int(i % 5 == 0) for i in range(500)]) > 0.97
    want = [(i, t) for i, t in rows if not judged[i]]
    plain = {"toxicity": lambda x: want, "line_dedup": plain_line_dedup, "near_duplicates": plain_near_duplicates, "decontamination": lambda x: plain_decontamination(x, items)}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*plain, "packing"]
    now, sizes = rows, [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.spool(stage(spark, docs, corpus))
        now = plain[name](now)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r.doc_id, r.text) for r in docs.filter("text IS NOT NULL").collect()) == sorted((i, t) for i, t in now if t is not None), name
        assert docs.filter("text IS NULL").count() == sum(t is None for _, t in now)
        sizes.append(len(now))
    assert sizes[0] > sizes[1] > sizes[3] > sizes[4] > 300  # toxic rows, copies and contaminated rows went
    assert {600, 601, 602, 121} <= {i for i, _ in now} and not {31, 61} & {i for i, _ in now}
    encoder = Tokenizer.from_file(queries.tokenizer_path())
    pieces = {}
    for i, t in now:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces[i, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = corpus_pipeline.run(spark, corpus).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    assert common.shared_dir(spark)

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_hot_keys_join_by_broadcast(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    right = common.spool(left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    got = common.lookup(left, right, ["k"], 5000)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select("id", "top").collect())) == sorted(map(tuple, left.join(right, "k").select("id", "top").collect()))


def test_filters_lose_nothing(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    for bits in (64, 1 << 12, 1 << 20):
        words = common.bit_filter(keys, "h", bits)
        assert common.passes(words, np.array([r.h for r in keys.collect()])).all()
    assert common.passes(words, np.arange(10_000)).mean() < 0.01


def test_links_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, 1001 + i) for i in range(3000)] + [(5000 - i, 9000) for i in range(50)]
    got = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(3001)) and got[9000] == got[4951] == 4951


def test_a_recall_that_cannot_be_reached(spark):
    with pytest.raises(ValueError):
        near_duplicates.bands(0.02, 0.9999)
    rate = near_duplicates.least_equal(120)
    assert 60 < rate < 96


def test_large_groups_of_near_copies(spark):
    """A group over several blocks and buckets in parts: links are counted exactly."""
    words = prose(200).split()
    rows = []
    for i in range(700):
        w = list(words)
        w[i % 200] = f"neu{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    old = near_duplicates.BLOCK
    try:
        near_duplicates.BLOCK = 256
        got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.classes(docs).collect()}
    finally:
        near_duplicates.BLOCK = old
    sets = [plain_set(t) for _, t in rows]
    for i in range(0, 700, 70):
        n = sum(j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(700))
        assert got[i] == (0, n)
