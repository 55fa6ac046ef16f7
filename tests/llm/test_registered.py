"""The registered queries on whole tables, against brute force or SQL."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import entry, mixing, toxicity, trainorder
from tessera.llm.common import table

from test_small_operators import brute_classes, brute_lines, brute_suffix, check_packing, slow_order, slow_score


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]


def against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf}/{t}')")
    df, want = entry.QUERIES[name](spark, sf), con.sql(entry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(str(tuple(r[c] for c in want.columns)) for r in df.collect())
    assert got == sorted(map(str, want.fetchall())) and got


def test_op1_op5_equal_sql(spark, sf):
    against_sql(spark, sf, "op1_urlfilter")
    against_sql(spark, sf, "op5_embdedup")


def test_op2_equals_brute_force(spark, sf, docs):
    got = {r.doc_id: (r.text, r.n_dropped) for r in entry.op2_linededup(spark, sf).collect()}
    texts = dict(docs)
    want = dict(brute_lines(docs))
    assert {d: t for d, (t, _) in got.items()} == want and sum(n for _, n in got.values()) > 20
    assert all(n == (texts[d] or "").count("\n") - (t or "").count("\n") + (n > 0 and t == "") for d, (t, n) in got.items())


def test_op3_recall_and_abandoned(spark):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "embeddings").collect()
    x, ids = np.stack([r.embedding for r in rows]).astype(float), np.array([r.vec_id for r in rows])
    got, hit, want = {}, 0, 0
    for r in entry.op3_ann(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.einsum("ij,j->i", x, x[i])
        near = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        found = sorted(got[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and all(r.score == pytest.approx(s[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        want += 20
        hit += len({r.vec_id for r in found} & set(ids[near].tolist()))
    counts = [(g[0].n_candidates, g[0].n_abandoned) for g in got.values()]
    assert hit / want >= 0.9 and sum(a for _, a in counts) > 0.5 * sum(c for c, _ in counts)


def test_op4_equals_brute_force(spark, sf, docs):
    got = entry.op4_simhash(spark, sf).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == brute_classes(docs)


def test_op6_meets_its_targets_and_tells_held_out_documents(spark, sf, docs):
    rows = entry.op6_mixing(spark, sf).collect()
    total = sum(r.tokens for r in rows)
    for i, domain in enumerate(sorted(mixing.TARGETS)):
        assert sum(r.rate * r.tokens * r.posterior[i] for r in rows) == pytest.approx(mixing.TARGETS[domain] * total, abs=2e-4 * total)
    assert len(rows) == len(docs) and {r.residual for r in rows} == {rows[0].residual} and rows[0].residual <= 1e-4
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    model = mixing.train_classifier(table(spark, sf, "documents"), labels.where("doc_id % 3 > 0"), ["0", "1"])
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    held = [(texts[r.doc_id], r.quality) for r in labels.where("doc_id % 3 = 0").collect() if r.doc_id in texts]
    guess = model.posterior(np.stack([mixing.text_features(t) for t, _ in held])).argmax(1)
    assert len(held) > 80 and (guess == np.array([q for _, q in held])).mean() > 0.9


def test_op7_equals_plain_order(spark, sf, docs):
    rows = sorted(entry.op7_trainorder(spark, sf).collect())
    made = trainorder.training_order(table(spark, sf, "documents").repartition(7))
    from pyspark.sql import functions as F

    groups = -(-len(docs) // 512)
    hashed = table(spark, sf, "documents").select("doc_id", "text", F.xxhash64("text").alias("key"), F.pmod(F.xxhash64(F.lit(11), "doc_id", F.xxhash64("text")), F.lit(groups)).alias("grp")).collect()
    want, total = slow_order([(r.doc_id, r.text) for r in hashed], [(r.grp, r.key) for r in hashed], groups, 1024, 7)
    raw = np.array(want, "<u2").tobytes()
    size = 4096 * 2048
    assert [r.crc32 for r in rows] == [zlib.crc32(raw[i : i + size]) for i in range(0, len(raw), size)] == [m.crc32 for m in sorted(made.collect())]
    assert sum(r.n_ids for r in rows) == total and sum(r.n_bytes for r in rows) == len(raw)


def test_op8_packs_every_id_once(spark, sf, docs):
    got = entry.op8_packing(spark, sf).collect()
    want, by_doc, bins = check_packing(docs, got, 1024)
    assert len(by_doc) == len({w[:2] for w in want}) and sum(r.length for r in got) > 0.97 * 1024 * (len(bins) - 1)


def test_op9_equals_brute_force(spark, sf, docs):
    got = entry.op9_suffix(spark, sf).collect()
    want = {}
    for row in brute_suffix(docs, 50):
        d, n, digest, spans = eval(row)  # noqa: S307 - a repr made by the test itself
        want[d] = (n, sum(e - s for s, e in spans), len(spans), digest)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    texts = dict(docs)
    assert all(r.kept_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in got if not r.n_removed)


def test_op10_equals_dense_scoring(spark, sf, docs):
    chain = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    texts = dict(docs)
    for r in entry.op10_toxicity(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)
        if chain.prior is None:
            score, spans = slow_score(chain, texts[r.doc_id])
            assert r.score == pytest.approx(score, abs=1e-9) and [(s.start, s.end) for s in r.spans] == spans
        else:
            assert r.score == chain.prior
