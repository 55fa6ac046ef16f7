"""Exact vector search at three precisions, batch-first.

A bounded set of query vectors (``MAX_QUERIES``) travels to the rows, every
Arrow batch is a few matrix products, and a batch hands on its k best documents
per query, so what is shuffled doesn't grow with the corpus but with batches x
queries x k. A larger set meets the rows in blocks. A document scores its best passage;
ties go to the earlier passage and then to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UsageError
from ..functions import vectors as V
from .lexical import check_k, top_k

PRECISIONS = ("float", "int8", "binary")
MAX_QUERIES, BLOCK, TILE = 4096, 16384, 256


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _prepare(x: np.ndarray, precision: str, scale: float) -> np.ndarray:
    """Rows whose inner product is the score (of sign vectors: dim - 2 * distance)."""
    if precision == "binary":
        return np.where(x > 0, 1.0, -1.0)
    if precision == "int8":
        x = np.clip(np.rint(x / scale), -127, 127)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 10, precision: str = "float", scale: float = V.INT8_SCALE, allowed: DataFrame | None = None, exclude_self: bool = False, digits: int | None = None) -> DataFrame:
    """(qid, rank, doc_id, score, seq): the k best documents for every query.

    vectors: (doc_id, seq, embedding); queries: (qid, embedding). float and int8
    score by cosine, binary by minus the Hamming distance. Up to ``MAX_QUERIES``
    queries travel to the rows; a larger set meets them in blocks of bounded
    size, and never passes through the driver.
    """
    check_k(k)
    if precision not in PRECISIONS:
        raise UsageError(f"unknown precision {precision!r} ({'|'.join(PRECISIONS)})")
    if allowed is not None:
        vectors = vectors.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    kind = vectors.schema["doc_id"].dataType.simpleString()
    rows = vectors.select("doc_id", F.col("seq").cast("int").alias("seq"), "embedding")
    asked = queries.select(F.col("qid").cast("string").alias("qid"), F.col("embedding").cast("array<double>").alias("e"))
    first = asked.limit(MAX_QUERIES + 1).toArrow()
    if not first.num_rows:
        return vectors.sparkSession.createDataFrame([], f"qid string, rank int, doc_id {kind}, score double, seq int")
    shape = f"qid string, doc_id {kind}, score double, seq int"
    if first.num_rows <= MAX_QUERIES:
        names = np.array(first.column("qid").to_pylist(), object)
        q = _prepare(_matrix(first.column("e").combine_chunks()), precision, scale)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield from _best(names, q, b.column(0), b.column(1), _prepare(_matrix(b.column(2)), precision, scale), k, precision, exclude_self, digits)

        out = rows.mapInArrow(run, shape)
    else:
        out = _in_blocks(rows, asked, kind, shape, k, precision, scale, exclude_self, digits)
    # a document's passages in several batches meet here: a partial maximum, then the k best
    best = out.groupBy("qid", "doc_id").agg(F.max(F.struct("score", (-F.col("seq")).alias("s"))).alias("b")).select("qid", "doc_id", "b.score", (-F.col("b.s")).alias("seq"))
    return top_k(best, k).select("qid", "rank", "doc_id", "score", "seq")


def _in_blocks(rows: DataFrame, asked: DataFrame, kind: str, shape: str, k: int, precision: str, scale: float, exclude_self: bool, digits: int | None) -> DataFrame:
    """Every block of queries meets every block of rows in a task of its own."""
    n, m = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // MAX_QUERIES))
    x = rows.withColumn("x", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    y = asked.withColumn("y", F.pmod(F.xxhash64("qid"), F.lit(m)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        names = np.array(right.column("qid").to_pylist(), object)
        columns = [left.column(c).combine_chunks() for c in ("doc_id", "seq", "embedding")]
        q, v = (_prepare(_matrix(c), precision, scale) for c in (right.column("e").combine_chunks(), columns[2]))
        return pa.Table.from_batches(list(_best(names, q, columns[0], columns[1], v, k, precision, exclude_self, digits)))

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(asked.sparkSession.createDataFrame([], shape).schema)
    return x.groupBy("x", "y").cogroup(y.groupBy("x", "y")).applyInArrow(meet, shape)


def _best(names: np.ndarray, q: np.ndarray, ids: pa.Array, seq: pa.Array, x: np.ndarray, k: int, precision: str, exclude_self: bool, digits: int | None):
    """Batches of (qid, doc_id, score, seq): of each query the k best documents here, and what ties with the last of them."""
    number, place = np.unique(np.array(ids.to_pylist(), object), return_inverse=True)
    order = np.lexsort((seq.to_numpy(zero_copy_only=False), place))  # by document, then by passage
    starts = np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]])
    own = {str(d): i for i, d in enumerate(number.tolist())} if exclude_self else {}
    for t in range(0, len(q), TILE):
        scores = q[t : t + TILE] @ x[order].T
        if precision == "binary":
            scores = -np.rint((x.shape[1] - scores) / 2)
        if digits is not None:
            scores = np.round(scores, digits)
        best = np.maximum.reduceat(scores, starts, axis=1)
        for i, name in enumerate(names[t : t + TILE]) if own else ():
            if name in own:
                best[i, own[name]] = -np.inf
        kth = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if best.shape[1] > k else np.full(len(best), -np.inf)
        who, doc = np.nonzero((best >= kth[:, None]) & (best > -np.inf))
        # the earliest passage with the document's score
        first = starts[doc]
        several = np.flatnonzero(np.diff(np.r_[starts, len(order)])[doc] > 1)
        ends = np.r_[starts[1:], len(order)][doc]
        for j in several.tolist():
            first[j] += int(np.argmax(scores[who[j], first[j] : ends[j]] == best[who[j], doc[j]]))
        take = pa.array(order[first])
        yield pa.RecordBatch.from_arrays([pa.array(names[t + who].tolist(), pa.string()), ids.take(take), pa.array(best[who, doc].astype(np.float64)), seq.take(take)], names=["qid", "doc_id", "score", "seq"])


def attach_passages(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Add passage_count, and the text of the best passage where there are several."""
    own = passages.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = own.groupBy("doc_id").agg(F.count("*").alias("passage_count"))
    texts = own.select("doc_id", "seq", F.col("text").alias("passage"))
    out = hits.join(counts, "doc_id", "left").join(texts, ["doc_id", "seq"], "left")
    return out.withColumn("passage", F.when(F.col("passage_count") > 1, F.col("passage")))


def float_similarity(hits: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, float_similarity): best cosine over a hit's passages."""
    met = hits.select("qid", "doc_id").join(vectors, "doc_id").join(queries.select("qid", F.col("embedding").alias("q")), "qid")
    return met.groupBy("qid", "doc_id").agg(F.max(V.cosine(F.col("embedding"), F.col("q"))).alias("float_similarity"))


def rerank(pool: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The whole fused pool by the inner product of the best passage; documents without vectors get -2."""
    met = pool.select("qid", "doc_id").join(vectors, "doc_id").join(queries.select("qid", F.col("embedding").alias("q")), "qid")
    best = met.groupBy("qid", "doc_id").agg(F.max(F.struct(V.dot(F.col("embedding"), F.col("q")).alias("d"), (-F.col("seq")).alias("s"))).alias("b"))
    scored = pool.drop("score", "rank", "seq").join(best, ["qid", "doc_id"], "left").withColumns({"score": F.coalesce(F.col("b.d"), F.lit(-2.0)), "seq": (-F.col("b.s")).cast("int")}).drop("b")
    return top_k(scored, k)


def best_of(scored: DataFrame) -> DataFrame:
    """One row per query and document: the highest score, the earliest passage on ties."""
    w = Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "seq")
    return scored.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
