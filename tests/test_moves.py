"""What a collection's changes and the stemmed index move and hold."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.plans import queries
from tessera.plans.store import Collection


def test_stems_are_made_of_pieces_of_a_batch():
    """A batch of large documents isn't held as Python objects at once."""
    rows = pa.RecordBatch.from_pylist([{"doc_id": i, "title": "", "body": f"running w{i} " * 9000} for i in range(40)])
    got = list(lexical._stem_postings([rows]))
    assert len(got) >= 4 and max(len(set(b.column(1).to_pylist())) for b in got) <= 12
    assert sorted((r["doc_id"], r["term"], len(r["positions"]), r["len"]) for b in got for r in b.to_pylist()) == sorted((i, t, 9000, 18000) for i in range(40) for t in ("run", f"w{i}"))
    sizes = [r for b in lexical._stem_lengths([rows]) for r in b.to_pylist()]
    assert sizes == [{"doc_id": i, "len": 18000} for i in range(40)]


def test_segmented_upsert_joins_no_texts(spark, sf):
    plan = queries.QUERIES["segmented_upsert"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("md5(")


def test_sums_of_documents_leave_buried_segments_out(spark, tmp_path):
    col = Collection.create(spark, str(tmp_path / "c"), chunking="off", tokenizer="simple")
    docs = spark.createDataFrame([("1", "t", "a b a"), ("2", "t", "c"), ("3", "", "")], "doc_id string, title string, body string")
    col.add_documents(docs)
    first = {r.doc_id: r.created_at for r in col.table("documents").collect()}
    col.add_documents(docs.where("doc_id = '1'").withColumn("body", F.lit("b b b x")))
    col.remove_documents(docs.where("doc_id = '2'").select("doc_id"))
    assert {(r.doc_id, r.n_tokens, r.n_terms) for r in col.postings().per_document().collect()} == {("1", 5, 3)}
    assert {r.doc_id: r.created_at for r in col.table("documents").collect()} == {k: first[k] for k in ("1", "3")}
