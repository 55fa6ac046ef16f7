"""The build of an index moves each posting once, whatever its tokenizer."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical, postings


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 5)
    docs = spark.createDataFrame([(1, "A b", "b a b É"), (2, None, None), (3, "", "x"), (None, "t", "t"), (5, "one", "two " * 9)], "doc_id long, title string, body string")
    index = lexical.build_index(docs, title_col="title")
    assert "Exchange" not in plan_of(index.postings)
    got = sorted((r.doc_id or 0, r.term, list(r.positions), r.len) for r in index.postings.collect())
    assert got == [(0, "t", [0, 2], 2), (1, "a", [0, 4], 6), (1, "b", [1, 3, 5], 6), (1, "é", [6], 6), (3, "x", [1], 1), (5, "one", [0], 10), (5, "two", list(range(2, 11)), 10)]


def test_blocks_are_made_by_one_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    rows = [(t, f"d{i:03}", list(range(i % 3 + 1)), i + 5) for t, n in (("a", 90), ("b", 3), ("c", 17)) for i in range(n)]
    made = spark.createDataFrame(rows, "term string, doc_id string, positions array<int>, len long")
    common = made.groupBy("term").agg(F.count("*").alias("n")).where("n > 4")
    stored = str(tmp_path / "made")
    common.write.parquet(stored)
    blocks = postings.to_blocks(made, F.broadcast(spark.read.parquet(stored)), 3, 7)
    assert plan_of(blocks).count("Exchange") - plan_of(blocks).count("BroadcastExchange") == 1
    assert plan_of(blocks).count("Aggregate") == 0
    got = blocks.collect()
    assert sorted((b.term, d, p, x) for b in got for d, p, x in zip(b.docs, b.positions, b.lens)) == sorted((t, d, p, x) for t, d, p, x in rows)
    assert len({(b.term, b.slot) for b in got}) == len(got) and {b.slots for b in got if b.term == "a"} == {32}
    for b in got:
        assert b.docs == sorted(b.docs) and b.tfs == [len(p) for p in b.positions]
        assert (b.n, b.max_tf, b.min_len, b.segment) == (len(b.docs), max(b.tfs), min(b.lens), 7)


@pytest.mark.parametrize("cut", [1, 2, 5, 100])
def test_a_block_may_go_on_in_the_next_batch(cut):
    rows = [("a", 2, 0, 1), ("a", 2, 0, 2), ("a", 2, 1, 3), ("b", 1, 0, 4), ("b", 1, 0, 5), ("b", 1, 0, 6)]
    whole = pa.RecordBatch.from_pylist([{"term": t, "slots": n, "doc_id": d, "len": d + 10, "positions": [d] * d, "slot": s} for t, n, s, d in rows])
    got = [r for b in postings._runs(1, (whole.slice(i, cut) for i in range(0, len(rows), cut))) for r in b.to_pylist()]
    assert [(r["term"], r["slot"], r["docs"], r["tfs"], r["max_tf"], r["min_len"]) for r in got] == [("a", 0, [1, 2], [1, 2], 2, 11), ("a", 1, [3], [3], 3, 13), ("b", 0, [4, 5, 6], [4, 5, 6], 6, 14)]
