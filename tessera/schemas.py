"""Schemas of a collection's tables."""

from __future__ import annotations

from pyspark.sql import types as T


DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("ext", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("root_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
PASSAGES = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("text", T.StringType())])
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("len", T.LongType())])
DOC_STATS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("len", T.LongType())])
VECTORS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
ROOTS = T.StructType(
    [
        T.StructField("root_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("exclude", T.ArrayType(T.StringType())),
        T.StructField("added_at", T.TimestampType()),
        T.StructField("last_indexed_at", T.TimestampType()),
        T.StructField("files_only", T.BooleanType()),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("precision", T.StringType()),
        T.StructField("filters", T.StringType()),
        T.StructField("result_count", T.LongType()),
        T.StructField("searched_at", T.TimestampType()),
    ]
)
SAVED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("precision", T.StringType()),
        T.StructField("filters", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
BOOKMARKS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("note", T.StringType()), T.StructField("created_at", T.TimestampType())])
ACTIVITY = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("last_opened_at", T.TimestampType()), T.StructField("open_count", T.LongType())])
RUNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("root_path", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        *[T.StructField(n, T.LongType()) for n in ("added", "updated", "unchanged", "removed", "skipped")],
        T.StructField("error", T.StringType()),
    ]
)

TABLES = {
    "documents": DOCUMENTS,
    "passages": PASSAGES,
    "postings": POSTINGS,
    "doc_stats": DOC_STATS,
    "vectors": VECTORS,
    "roots": ROOTS,
    "history": HISTORY,
    "saved": SAVED,
    "bookmarks": BOOKMARKS,
    "activity": ACTIVITY,
    "runs": RUNS,
}
