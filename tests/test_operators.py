import datetime as dt
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.errors import UsageError
from tessera.functions import vectors as V
from tessera.operators import analytics, changes, fusion, lexical, metrics, semantic
from tessera.operators.filters import SearchFilters, allowed

DOCS = [
    ("a", "Soil", "compost water drainage and water for the soil"), ("b", "Bread", "wild yeast in bread and wild flour"), ("c", "Garden", "compost in the garden"),
    ("d", "River", "water flows and drainage works"), ("e", "", "nothing here"), ("f", "Wild things", "things that are wild yeast"), ("g", "Empty", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, title string, body string").cache()


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(doc_id unindexed, title, body, tokenize='porter unicode61')")
    db.executemany("insert into f values (?, ?, ?)", DOCS)
    return db


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("query,match,fts_query", [
    ("compost water", "all", '"compost" "water"'), ("wild yeast", "all", '"wild" "yeast"'), ("water water", "all", '"water" "water"'),
    ("wild-yeast", "all", '"wild-yeast"'), ("compost water drainage", "any", '"compost" OR "water" OR "drainage"'), ("things wild-yeast", "any", '"things" OR "wild-yeast"'),
])
def test_bm25_equals_fts5(spark, docs, fts, query, match, fts_query):
    index = lexical.build_index(docs, title_col="title", tokenizer="porter")
    got = rows(lexical.lexical_search(spark, index, [("q", query)], 10, match), "doc_id", "score")
    want = fts.execute("select doc_id, -bm25(f) s from f where f match ? order by s desc, doc_id", (fts_query,)).fetchall()
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-12 for g, w in zip(got, want))


def test_simple_and_porter_indexes_agree_on_plain_words(spark, docs):
    for f in ("postings", "lengths"):
        a, b = (getattr(lexical.build_index(docs.where("doc_id = 'c'"), title_col="title", tokenizer=t), f) for t in ("simple", "porter"))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) or f == "postings"


def test_auto_match(spark, docs):
    index = lexical.build_index(docs, title_col="title")
    got = lexical.lexical_search(spark, index, [("q", "compost water drainage")], 10, "auto").orderBy("rank").collect()
    assert got[0].doc_id == "a" and got[0].strict_count == 1 and got[0].relaxed
    scores = [r.score for r in got]
    assert scores == sorted(scores, reverse=True) and scores[-1] > 0 and len(got) == 3
    one = lexical.lexical_search(spark, index, [("q", "what is wild yeast")], 1, "auto").collect()
    assert one[0].strict_count == 1 and not one[0].relaxed
    assert lexical.lexical_search(spark, index, [("q", "-- !!")], 5, "all").count() == 0


def test_filter_keeps_global_statistics(spark, docs):
    index = lexical.build_index(docs, title_col="title")
    every = {r.doc_id: r.score for r in lexical.lexical_search(spark, index, [("q", "water")], 10, "any").collect()}
    some = lexical.lexical_search(spark, index, [("q", "water")], 10, "any", allowed=docs.where("doc_id = 'd'")).collect()
    assert [(r.doc_id, r.score) for r in some] == [("d", every["d"])]


def test_lexical_arguments(spark, docs):
    index = lexical.build_index(docs)
    for kw in ({"k": 0}, {"k": True}, {"match": "some"}):
        with pytest.raises(UsageError):
            lexical.lexical_search(spark, index, [("q", "x")], **({"k": 5, "match": "all"} | kw))


def test_term_matches(spark, docs):
    index = lexical.build_index(docs, title_col="title")
    hits = spark.createDataFrame([("q", "a"), ("q", "c")], "qid string, doc_id string")
    got = {r.doc_id: r.matched_terms for r in lexical.term_matches(spark, index, [("q", "compost"), ("q", "water")], hits).collect()}
    assert got == {"a": ["compost", "water"], "c": ["compost"]}


# -- vectors -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vecs(spark):
    rows = [("a", 0, [1.0, 0.0, 0.0]), ("a", 1, [0.6, 0.8, 0.0]), ("b", 0, [0.0, 1.0, 0.0]), ("c", 0, [0.0, 0.0, 0.0]), ("d", 0, [-1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "doc_id string, seq int, embedding array<float>").cache()


def test_semantic_float(spark, vecs):
    q = spark.createDataFrame([("q", [0.6, 0.8, 0.0])], "qid string, embedding array<float>")
    got = rows(semantic.semantic_search(vecs, q, 4), "doc_id", "seq", "score")
    assert [g[:2] for g in got] == [("a", 1), ("b", 0), ("c", 0), ("d", 0)]
    assert got[0][2] == pytest.approx(1.0, abs=1e-7) and got[2][2] == 0.0
    assert rows(semantic.semantic_search(vecs.repartition(4), q, 4), "doc_id", "seq") == [g[:2] for g in got]


def test_semantic_blocks_equal_one_pass(spark, monkeypatch):
    """Many queries meet the rows in blocks; documents of several passages, ties, equal ids left out."""
    import random

    rng = random.Random(8)
    rows = [(f"d{i % 40}", i // 40, [float(rng.choice([-1, 0, 1, 2])) for _ in range(4)] + [0.5]) for i in range(120)]
    v = spark.createDataFrame(rows, "doc_id string, seq int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(f"d{i}", rows[i][2]) for i in range(0, 40, 2)], "qid string, embedding array<float>")
    for kw in ({}, {"exclude_self": True}, {"precision": "binary"}, {"precision": "int8", "exclude_self": True}):
        want = sorted(map(str, semantic.semantic_search(v, q, 5, digits=6, **kw).collect()))
        with monkeypatch.context() as m:
            m.setattr(semantic, "MAX_QUERIES", 6)
            m.setattr(semantic, "BLOCK", 17)
            assert sorted(map(str, semantic.semantic_search(v, q, 5, digits=6, **kw).collect())) == want and len(want) == 100


def test_stored_index_equals_one_made_on_the_fly(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} common Text of number {i} Éa 東京") for i in range(200)] + [(900, None)], "doc_id long, body string")
    asked = [("1", "word3 common"), ("2", "number 東京"), ("3", "éa of-number"), ("4", "missing")]
    for tokenizer in ("simple", "porter"):
        index = lexical.build_index(docs, tokenizer=tokenizer)
        lexical.save_index(index, f"{tmp_path}/{tokenizer}")
        stored = lexical.load_index(spark, f"{tmp_path}/{tokenizer}", tokenizer)
        for match in ("all", "any", "auto"):
            a, b = (sorted(map(str, lexical.lexical_search(spark, x, asked, 20, match, digits=9).collect())) for x in (index, stored))
            assert a == b and a


def test_semantic_binary_and_int8(spark, vecs):
    q = spark.createDataFrame([("q", [0.6, 0.8, -1.0])], "qid string, embedding array<float>")
    assert rows(semantic.semantic_search(vecs, q, 2, "binary"), "doc_id", "score") == [("a", 0.0), ("b", -1.0)]
    assert rows(semantic.semantic_search(vecs, q, 1, "int8"), "doc_id") == [("a",)]
    with pytest.raises(UsageError):
        semantic.semantic_search(vecs, q, 2, "half")


def test_quantizers(spark):
    df = spark.createDataFrame([([1.0, -0.5],), ([0.25, 2.54],)], "embedding array<float>")
    assert V.calibrate_scale(df).first()[0] == pytest.approx(2.54 / 127, rel=1e-6)
    bits = spark.createDataFrame([([0.5, -0.1, 0.3, -0.7],), ([1.0] * 9,)], "v array<float>").select(V.pack_bits(F.col("v"))).collect()
    assert [b[0] for b in bits] == ["a0", "ff80"]
    q = spark.createDataFrame([([0.5, -2.0, 1.5 / 127, 2.5 / 127],)], "v array<double>").select(V.quantize_int8(F.col("v"))).first()[0]
    assert list(q) == [64, -127, 2, 2]
    assert spark.range(1).select(V.binary_similarity(F.lit(96), 384)).first()[0] == 0.5


def test_rerank_and_passages(spark, vecs):
    pool = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 0.5), ("q", "z", 0.4)], "qid string, doc_id string, score double")
    q = spark.createDataFrame([("q", [0.6, 0.8, 0.0])], "qid string, embedding array<float>")
    got = rows(semantic.rerank(pool, vecs, q, 3), "doc_id", "seq")
    assert got == [("a", 1), ("b", 0), ("z", None)]
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 0)], "qid string, doc_id string, seq int")
    passages = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "doc_id string, seq int, text string")
    assert sorted((r.doc_id, r.passage_count, r.passage) for r in semantic.attach_passages(hits, passages).collect()) == [("a", 2, "y"), ("b", 1, None)]


# -- fusion ------------------------------------------------------------------------------


def leg(spark, items):
    return spark.createDataFrame([("q", i + 1, d, float(s)) for i, (d, s) in enumerate(items)], "qid string, rank int, doc_id string, score double")


def test_rrf(spark):
    lex, sem = leg(spark, [("a", 3), ("b", 2), ("c", 1)]), leg(spark, [("b", 3), ("a", 2), ("d", 1)])
    got = rows(fusion.rrf(lex, sem), "doc_id", "score")
    assert [g[0] for g in got] == ["b", "a", "d", "c"]  # ties go to the better rank by meaning
    assert got[0][1] == got[1][1] == pytest.approx(1 / 61 + 1 / 62)
    for k in (0, -1, True, 1.5):
        with pytest.raises(UsageError):
            fusion.rrf(lex, sem, k)


def test_linear(spark):
    lex, sem = leg(spark, [("b", 10), ("a", 1)]), leg(spark, [("c", 7), ("a", 5), ("b", 5)])
    assert rows(fusion.linear(lex, sem, 0.5), "doc_id", "score") == [("b", 0.5), ("c", 0.5), ("a", 0.0)]
    assert rows(fusion.linear(lex, sem, 0.0), "doc_id", "score") == [("b", 10.0), ("a", 1.0)]
    assert rows(fusion.linear(lex, sem, 1.0), "doc_id") == [("c",), ("a",), ("b",)]
    same = fusion.linear(leg(spark, [("a", 1), ("z", 1)]), leg(spark, [("m", 1)]), 0.5)
    assert rows(same, "doc_id") == [("a",), ("m",), ("z",)]
    with pytest.raises(UsageError):
        fusion.linear(lex, sem, 1.5)


def test_labels(spark):
    values = [(0.50, "strong"), (0.4999, "moderate"), (0.34, "moderate"), (0.3399, "weak")]
    df = spark.createDataFrame([(v,) for v, _ in values], "v double")
    assert [r[0] for r in df.select(fusion.semantic_label(F.col("v"))).collect()] == [w for _, w in values]
    assert [r[0] for r in df.select(fusion.semantic_label(F.col("v") - 0.14, "binary")).collect()][:2] == ["strong", "moderate"]
    pairs = [(2, 2, False, "strong"), (1, 2, False, "moderate"), (0, 2, False, "weak"), (0, 0, False, "moderate"), (1, 2, True, "weak"), (2, 3, True, "moderate")]
    df = spark.createDataFrame(pairs, "m int, t int, p boolean, want string")
    assert all(r[0] == r[1] for r in df.select(fusion.lexical_label(F.col("m"), F.col("t"), F.col("p")), "want").collect())
    hits = spark.createDataFrame([("q", "weak"), ("q", "weak"), ("r", "weak"), ("r", "strong")], "qid string, confidence string")
    assert sorted(map(tuple, fusion.outcome(hits).collect())) == [("q", 2, 2, True), ("r", 2, 1, False)]


# -- filters ----------------------------------------------------------------------------


def test_filters(spark):
    rows = [("1", "notes", ".md", ["work"], 10.0), ("2", "notes/deep", ".txt", ["home"], 20.0), ("3", "notesextra", ".md", [], 30.0), ("4", "", ".md", ["space", "work"], 40.0), ("5", "a_b", ".md", None, 50.0), ("6", "axb", ".md", None, 60.0), ("7", None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id string, folder string, ext string, tags array<string>, mtime double")
    ids = lambda **kw: sorted(r[0] for r in allowed(d, kw).collect())
    assert ids(folders=["notes"]) == ids(folders=["./NOTES/"]) == ["1", "2"]
    assert ids(folders=[""]) == ["4"] and ids(folders=["a_b"]) == ["5"] and ids(folders=["a%"]) == []
    assert ids(exts=["TXT"]) == ["2"] and ids(tags=["Work", "home"]) == ["1", "2", "4"]
    assert ids(modified_after=20, modified_before=40.0) == ["2", "3", "4"] and ids(tags=["work"], folders=["notes"]) == ["1"]
    assert allowed(d, None) is None
    day = SearchFilters(modified_after="2026-01-10", modified_before="2026-01-10")
    assert day.modified_before - day.modified_after == pytest.approx(86399.999)
    for bad in ({"x": 1}, {"exts": ["a b"]}, {"tags": [" "]}, {"folders": 3}, {"modified_after": True}, {"modified_after": 5, "modified_before": 4}, {"tags": ["t"] * 51}):
        with pytest.raises(UsageError):
            SearchFilters.of(bad)


# -- changes and read models -----------------------------------------------------------------


def test_changes(spark):
    h = lambda rows: spark.createDataFrame(rows, "doc_id string, content_hash string")
    cur, old = h([("a", "1"), ("b", "9"), ("n", "3")]), h([("a", "1"), ("b", "2"), ("c", "3")])
    diff = {r.doc_id: r.change for r in changes.classify(cur, old).collect()}
    assert diff == {"a": "unchanged", "b": "updated", "n": "added", "c": "stale"}
    assert changes.renames(cur.where("doc_id = 'n'"), old.where("doc_id = 'c'")).collect()[0] == ("c", "n")
    marks = spark.createDataFrame([("c", "old"), ("n", "own"), ("a", "x")], "doc_id string, note string")
    mapping = spark.createDataFrame([("c", "n")], "old_id string, new_id string")
    assert sorted(map(tuple, changes.carry_rows(marks, mapping).collect())) == [("a", "x"), ("n", "own")]
    snap = lambda rows: spark.createDataFrame(rows, "path string, mtime_ns long, size long")
    d = changes.diff_snapshots(snap([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]), snap([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)])).first()
    assert (d.new, d.changed, d.deleted) == (1, 1, 1)
    kept = changes.upsert(old.withColumn("created_at", F.lit(1)), cur.withColumn("created_at", F.lit(2)), keep=("created_at",))
    assert {(r.doc_id, r.content_hash, r.created_at) for r in kept.collect()} == {("a", "1", 1), ("b", "9", 1), ("n", "3", 2), ("c", "3", 1)}


def test_read_models(spark):
    d = spark.createDataFrame([("c", "h"), ("a", "h"), ("b", "h"), ("d", "h2"), ("e", "h2"), ("f", "h3"), ("g", None), ("i", None)], "doc_id string, content_hash string")
    assert [(r.n, r.first_id) for r in analytics.duplicate_groups(d, limit=10).collect()] == [(3, "a"), (2, "d")]
    assert sorted((r.doc_id, r.first_id, r.n) for r in analytics.duplicate_classes(d).collect()) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 2), ("e", "d", 2)]
    f = spark.createDataFrame([("1", "n", ["work"]), ("2", "n", ["home", "work"]), ("3", "", None), ("4", None, [])], "doc_id string, folder string, tags array<string>")
    assert {(r.value, r.n) for r in analytics.facets(f, "folder").collect()} == {("n", 2), ("", 1)}
    assert {(r.value, r.n) for r in analytics.tag_facet(f).collect()} == {("work", 2), ("home", 1)}
    ids = f.select("doc_id")
    h = analytics.health(f, ids.where("doc_id <> '4'").withColumn("seq", F.lit(0)), ids)
    row = analytics.status(h).first()
    assert row.without_passages == 1 and not row.ok and row.state == "partly ready"


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "b", 1), ("q", "c", 2), ("q", "z", 1), ("p", "y", 1)], "qid string, doc_id string, rel int")
    got = {r.qid: r for r in metrics.per_query(run, rel).collect()}
    dcg, ideal = 1 / math.log2(3) + 2 / math.log2(4), 2 + 1 / math.log2(3) + 1 / math.log2(4)
    assert got["q"].ndcg == pytest.approx(dcg / ideal) and got["q"].ap == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert got["q"].rr == 0.5 and got["q"].precision == 0.2 and got["p"].ndcg == 0
    v = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    import random

    from tessera.operators import metrics as m

    rng, kept = random.Random(4), (m.SORTED, m.CUTS)
    for series in ([], [3.0], [5.0] * 70, [rng.gauss(0, 1) for _ in range(500)], [rng.choice([1e300, -1e300, 1e-300, 0.0, 2.0]) for _ in range(300)], [float("-inf")] * 9 + [1.0] * 40 + [2.0] * 9 + [float("inf")] * 5, [1.0, 1.0 + 2**-52] * 50):
        df = spark.createDataFrame([(x,) for x in series] + [(None,)], "v double")
        m.SORTED, m.CUTS = 8, 4
        for p in (0.0, 0.5, 0.95, 1.0):
            want = sorted(series)[round((len(series) - 1) * p)] if series else None
            assert m.percentile(df, "v", p).first()[0] == want
        m.SORTED, m.CUTS = kept
    assert metrics.percentile(v, "v", 0.5).first()[0] == 11.0 and metrics.percentile(v, "v", 0.95).first()[0] == 19.0


def test_activity(spark):
    t = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(days=1)), ("b", t)], "doc_id string, ts timestamp")
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 9.0)], "doc_id string, mtime double")
    assert [r.doc_id for r in analytics.recent_documents(d, analytics.activity(e)).collect()] == ["a", "b", "c"]
