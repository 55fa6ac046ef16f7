"""Read models: facets, duplicates, history, bookmarks, activity, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_KEPT = 200
BODY_CHARS = 200_000


def facets(documents: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of each column in one pass; rows without a value don't count."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return documents.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def tag_facet(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(value, n): documents for each tag."""
    return documents.select(key, F.explode("tags").alias("value")).groupBy("value").agg(F.countDistinct(key).alias("n"))


def modified_range(documents: DataFrame) -> DataFrame:
    return documents.agg(F.min("mtime").alias("first"), F.max("mtime").alias("last"))


def duplicate_groups(documents: DataFrame, hash_col: str = "content_hash", key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """(content_hash, n, first_id): contents that several documents have, large groups first, then by least id.

    Members are rows of :func:`duplicate_classes`, so a group of any size is no single row.
    """
    groups = documents.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("content_hash")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")
    return groups.orderBy(F.desc("n"), "first_id").limit(limit) if limit else groups


def duplicate_classes(documents: DataFrame, hash_col: str = "content_hash", key: str = "doc_id") -> DataFrame:
    """(key, first_id, n): every document that shares its content, the class's least id and its size; no pairs."""
    groups = duplicate_groups(documents, hash_col, key).select(F.col("content_hash").alias("__h"), "first_id", "n")
    return documents.select(key, F.col(hash_col).alias("__h")).join(groups, "__h").select(key, "first_id", "n")


def root_duplicates(documents: DataFrame, root_id: int, hash_col: str = "content_hash") -> DataFrame:
    """(content_hash, n, first_id) of the contents that a root shares, within it or with others."""
    own = F.sum((F.col("root_id") == root_id).cast("int"))
    groups = documents.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), own.alias("__own"))
    return groups.where("n > 1 and __own > 0").drop("__own")


def duplicates_of(documents: DataFrame, ids: DataFrame, hash_col: str = "content_hash", key: str = "doc_id") -> DataFrame:
    """(id, other): other documents with the same content as the given ones."""
    own = documents.join(ids.select(key).distinct(), key, "left_semi").select(F.col(key).alias("id"), F.col(hash_col).alias("h"))
    return own.join(documents.select(F.col(key).alias("other"), F.col(hash_col).alias("h")), "h").where("id <> other").select("id", "other")


def recent_searches(history: DataFrame, limit: int = 20, by: tuple[str, ...] = ("query", "mode")) -> DataFrame:
    """The newest row of each (query, mode), newest first."""
    w = Window.partitionBy(*by).orderBy(F.desc("id"))
    return history.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").orderBy(F.desc("id")).limit(limit)


def keep_newest(log: DataFrame, n: int = HISTORY_KEPT, key: str = "id") -> DataFrame:
    """The last n rows of a log."""
    return log.orderBy(F.desc(key)).limit(n)


def latest_by_name(saved: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """The newest row of each name, without regard to case."""
    w = Window.partitionBy(F.lower(name)).orderBy(F.desc(key))
    return saved.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def activity(opens: DataFrame, key: str = "doc_id", at: str = "ts") -> DataFrame:
    """(key, last_opened_at, open_count) of an event log."""
    return opens.groupBy(key).agg(F.max(at).alias("last_opened_at"), F.count("*").alias("open_count"))


def recent_documents(documents: DataFrame, opened: DataFrame, limit: int = 10, key: str = "doc_id") -> DataFrame:
    """Documents by last opening, then modification, then id."""
    return documents.join(opened, key, "left").orderBy(F.desc_nulls_last("last_opened_at"), F.desc_nulls_last("mtime"), key).limit(limit)


def bookmarked(documents: DataFrame, bookmarks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with a bookmark, newest bookmark first."""
    return bookmarks.join(documents, key).orderBy(F.desc("created_at"), key)


def orphans(child: DataFrame, parent: DataFrame, *key: str) -> DataFrame:
    return child.join(parent.select(*key).distinct(), list(key), "left_anti")


def health(documents: DataFrame, passages: DataFrame, lengths: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row of counts, what is missing or orphaned, and ok. Every table is reduced to one row before they meet."""
    ids = documents.select("doc_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        n(documents, "documents"), n(passages, "passages"), n(lengths, "indexed"),
        n(orphans(passages, ids, "doc_id"), "orphan_passages"), n(orphans(ids, passages, "doc_id"), "without_passages"),
        n(orphans(ids, lengths, "doc_id"), "not_indexed"), n(orphans(lengths, ids, "doc_id"), "orphan_index"),
    ]
    if vectors is not None:
        parts += [n(vectors, "vectors"), n(orphans(vectors, passages, "doc_id", "seq"), "orphan_vectors"), n(orphans(passages, vectors, "doc_id", "seq"), "missing_vectors")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    bad = [c for c in out.columns if c.startswith(("orphan", "without", "not_", "missing"))]
    return out.withColumn("ok", sum((F.col(c) for c in bad[1:]), F.col(bad[0])) == 0)


def status(health_row: DataFrame) -> DataFrame:
    """empty, partly ready, needs attention or ready."""
    state = F.when(F.col("documents") == 0, "empty").when((F.col("orphan_passages") + F.col("orphan_index")) > 0, "needs attention").when(~F.col("ok"), "partly ready").otherwise("ready")
    size = F.when(F.col("documents") < 5000, "small").when(F.col("documents") < 50_000, "medium").otherwise("large")
    return health_row.withColumns({"state": state, "size_class": size})


def capabilities(health_row: DataFrame, has_model: bool, calibrated: bool = False) -> DataFrame:
    """What a collection can be asked: ``modes`` and ``precisions``, from the counts of its health."""
    vectors = F.col("vectors") if "vectors" in health_row.columns else F.lit(0)
    able = (F.col("documents") > 0) & (vectors > 0) & F.lit(has_model)
    pick = lambda *pairs: F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when in pairs)))
    modes = pick(("lexical", F.col("documents") > 0), ("semantic", able), ("hybrid", able))
    return health_row.withColumns({"modes": modes, "precisions": pick(("float", vectors > 0), ("int8", F.lit(calibrated)), ("binary", vectors > 0))})


def beyond_model(documents: DataFrame, passages: DataFrame, max_tokens: int) -> DataFrame:
    """One row: how many documents have a passage that, with the title, is longer than a model reads (four characters a token)."""
    met = passages.join(documents.select("doc_id", "title"), "doc_id")
    long = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("text", F.lit(""))) > 4 * max_tokens
    return met.where(long).agg(F.count_distinct("doc_id").alias("long_documents"))


def with_twins(rows: DataFrame, documents: DataFrame, most: int = 20) -> DataFrame:
    """``rows`` (doc_id ...) with ``duplicates``, the first ``most`` ids of other documents of the same content, and ``n_duplicates``, how many there are.

    A class is reduced to its first ids and its size before it is joined, so no row grows with it.
    """
    hashed = documents.where("content_hash is not null").select("doc_id", "content_hash")
    own = rows.select("doc_id").distinct().join(hashed, "doc_id")
    first = Window.partitionBy("content_hash").orderBy("doc_id")
    same = hashed.join(own.select("content_hash").distinct(), "content_hash", "left_semi")
    sizes = same.groupBy("content_hash").agg(F.count("*").alias("n"))
    heads = same.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most + 1).groupBy("content_hash").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    twins = own.join(sizes, "content_hash").join(heads, "content_hash").where("n > 1")
    others = F.slice(F.array_remove("ids", F.col("doc_id")), 1, most)
    return rows.join(twins.select("doc_id", others.alias("duplicates"), (F.col("n") - 1).alias("n_duplicates")), "doc_id", "left").withColumn("n_duplicates", F.coalesce("n_duplicates", F.lit(0).cast("long")))


def passage_census(passages: DataFrame) -> DataFrame:
    """One row: passages, documents, and documents of more than one passage."""
    per = passages.groupBy("doc_id").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("passages"), F.count("*").alias("documents"), F.count(F.when(F.col("n") > 1, 1)).alias("split_documents"))


def document_view(documents: DataFrame, most: int = BODY_CHARS, ids: DataFrame | None = None) -> DataFrame:
    """Bodies cut for display, and whether they were; of ``ids`` alone if given, with what else has their content."""
    shown = documents if ids is None else with_twins(documents.join(ids.select("doc_id"), "doc_id", "left_semi"), documents)
    return shown.withColumns({"truncated": F.length("body") > most, "body": F.left("body", F.lit(most))})


def id_digest(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: a SHA-256 that says whether two collections have the same ids.

    Ids are dealt to 4,096 buckets by the first digits of their MD5; each
    bucket's sorted ids, one on a line, have a digest, and the digest of these,
    in order of the buckets, is the answer. So no row holds more than a
    4,096th of the ids.
    """
    text = F.col(key).cast("string")
    each = ids.select(F.left(F.md5(text), F.lit(3)).alias("b"), text.alias("id")).groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("id")), "\n"), 256).alias("d"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])
    return each.agg(F.sha2(F.array_join(parts, "\n"), 256).alias("digest"))


def last_indexed(roots: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: when any root was last indexed, and when the first document came in."""
    return roots.agg(F.max("last_indexed_at").alias("last_indexed_at")).crossJoin(F.broadcast(documents.agg(F.min("created_at").alias("first_created_at"))))  # one row each


def long_documents(documents: DataFrame, words: int = 200, body_col: str = "body") -> DataFrame:
    """One row: how many documents have more than ``words`` words."""
    n = F.size(F.regexp_extract_all(F.coalesce(body_col, F.lit("")), F.lit(r"[^\s]+"), F.lit(0)))
    return documents.where(n > words).agg(F.count("*").alias("long_notes"))


def is_bookmarked(bookmarks: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with a flag ``bookmarked``."""
    marks = bookmarks.select("doc_id", F.lit(True).alias("__mark")).dropDuplicates(["doc_id"])
    return hits.join(marks, "doc_id", "left").withColumn("bookmarked", F.coalesce("__mark", F.lit(False))).drop("__mark")
