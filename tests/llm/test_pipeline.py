import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, neardup

from test_small_operators import brute_lines, check_packing, components, prose


def test_stages(spark, sf):
    """Every stage on its own input, against plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf).cache()
    assert clean.columns == docs.columns and docs.join(clean, "doc_id", "left_anti").count() < 0.25 * docs.count()
    lined = stages["line_dedup"](spark, clean, sf).cache()
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(map(str, ((r.doc_id, r.text) for r in lined.collect()))) == sorted(map(str, brute_lines(rows)))
    assert all(r.n_chars == len(r.text) for r in lined.collect() if r.text is not None)
    one = stages["near_dedup"](spark, lined, sf).cache()
    heads = brute_jaccard([(r.doc_id, r.text) for r in lined.collect()])
    assert sorted(str((r.doc_id, r.text)) for r in one.collect()) == heads and one.columns == docs.columns
    mixed = stages["mixing"](spark, one, sf).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in one.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rated, _ = mixing.mix(one, labels)
    copies = {r.doc_id: r.copies for r in rated.collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert {d: times[d] for d in copies} == copies and sum(times.values()) == sum(copies.values())
    packed = stages["packing"](spark, mixed, sf).collect()
    _, by_doc, bins = check_packing([(r.doc_id, r.text) for r in mixed.collect()], packed, 1024)
    assert {d for d, _ in by_doc} == {str(d) for d in times} and sum(r.length for r in packed) > 0.97 * 1024 * (len(bins) - 1)


def test_pipeline_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, repeated rows, one id with several texts, a very long text, clashing and map columns."""
    rng = random.Random(21)
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    long = "\n".join(prose(rng, 12) for _ in range(20_000))
    rows = [(None, None, None, None, None), (7001, None, "en", "s", 0), (7002, "", None, None, None), (7003, " \n\t\n", "en", "s", 4), (7004, long, "en", "s", len(long)), (7004, long, "en", "s", len(long)), (7005, "one", "en", "s", 3), (7005, "two words", "en", "s", 9), (None, "no id here", "en", "s", 10)]
    odd = plain.unionByName(spark.createDataFrame(rows, plain.schema))
    extra = {c: F.lit("x") for c in ("row", "h", "doc", "low", "node", "lines", "long", "u", "__chance", "__text", "__doc", "__lines", "__keep", "key", "line", "n", "grp", "score", "n_dropped_before")}
    docs = odd.withColumns(extra).withColumn("map", F.create_map(F.lit("k"), F.col("lang")))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    counts = []
    for name in ("toxicity", "line_dedup", "near_dedup", "mixing"):
        docs = stages[name](spark, docs, sf).cache()
        assert docs.columns == columns
        counts.append(docs.where("doc_id is null").count())
        texts = {(r.doc_id, r.text) for r in docs.where("doc_id between 7001 and 7005 or doc_id is null").collect()}
        if name != "mixing":
            assert {(7005, "one"), (7005, "two words"), (None, "no id here"), (None, None)} <= texts
        if name == "near_dedup":
            assert len([1 for d, t in texts if d in (7001, 7002, 7003)]) == 1 and docs.where("doc_id = 7004").count() == 1
    assert counts[:3] == [2, 2, 2]
    packed = stages["packing"](spark, docs, sf).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(rows, packed, 1024)


def test_run_is_its_stages_on_whole_tables(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect())) and got.count() > 200


def brute_jaccard(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None]
    comp = components(near, range(len(rows)))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[comp[i]] = min((d, i), low.get(comp[i], (d, i)))
    return sorted([str(rows[i]) for _, i in low.values()] + [str(r) for r in rows if r[0] is None])


@pytest.mark.parametrize("small", [48, 2])
def test_near_dedup_equals_brute_force_jaccard(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (77, "b c"), (3, prose(rng, 40)), (3, prose(rng, 40)), (None, "b c")]
    shared = prose(rng, 60)
    for i in range(30):
        words = (prose(rng, 150) + " " + shared).split()
        for j in range(rng.choice([1, 1, 2, 12])):
            copy = words.copy()
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(len(words))] = "edit"
            rows.append((100 + 20 * i + j, " ".join(copy)))
    want = brute_jaccard(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(want)
    assert len(want) < len(rows) and got.columns == docs.columns
    clash = docs.selectExpr("doc_id", "text", "'a' as low", "'b' as row", "map('c', 1) as node")
    assert sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.near_dedup(spark, clash, "").collect()) == sorted(want)
