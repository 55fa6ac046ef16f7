"""One entry point for keyword, meaning and hybrid search over batches of queries."""

from __future__ import annotations

import time
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EmptyQueryError, UsageError
from ..functions.snippets import build_snippet
from ..functions.text import keyword_terms
from ..operators import analytics, fusion, lexical, semantic
from ..operators.filters import allowed as allowed_docs
from ..sources.tables import keep

MODES = ("lexical", "semantic", "hybrid")
SEGMENTS = "array<struct<text: string, highlight: boolean>>"


@dataclass
class Corpus:
    """The DataFrames a search reads; ``vectors`` and ``embedder`` only for meaning search."""

    documents: DataFrame
    index: lexical.TextIndex
    passages: DataFrame | None = None
    vectors: DataFrame | None = None
    embedder: object | None = None


def _checked(queries) -> list[tuple[str, str]]:
    rows = [("0", queries)] if isinstance(queries, str) else [(str(q), t) for q, t in queries]
    if any(not (t or "").strip() for _, t in rows):
        raise EmptyQueryError("query is empty")
    if len({q for q, _ in rows}) < len(rows):
        raise UsageError("query ids must be distinct")
    return [(q, t.strip()) for q, t in rows]


def query_vectors(spark: SparkSession, embedder, queries: list[tuple[str, str]]) -> DataFrame:
    rows = [(q, [float(x) for x in embedder.encode_query(t)]) for q, t in queries]
    return spark.createDataFrame(rows, "qid string, embedding array<float>")


def search(spark: SparkSession, corpus: Corpus, queries, **options) -> DataFrame:
    """(qid, rank, doc_id, score, lex_rank, sem_rank, seq, confidence ...): hits of every query, in one plan.

    ``queries`` is a text or a list of (qid, text); the options are those of
    :func:`search_with_outcome`. ``explain`` adds a struct with the words found
    and missing, the ranks and scores and the reasons.
    """
    return _search(spark, corpus, queries, **options)[0]


def search_with_outcome(spark: SparkSession, corpus: Corpus, queries, **options) -> tuple[DataFrame, DataFrame]:
    """The hits of :func:`search`, and a row for each query, hits or none.

    (qid, n_hits, strict_count, relaxed, weak_count, abstained): ``strict_count``
    hits have every keyword (null where matching any is asked for, or without a
    keyword leg), ``relaxed`` says whether partial matches follow them, and a
    search abstains if it has hits and all of them are weak. ``timings`` may be
    a list that gets the stages with their rows and milliseconds.
    """
    hits, lex = _search(spark, corpus, queries, **options)
    asked = spark.createDataFrame([(q,) for q, _ in _checked(queries)], "qid string")
    out = asked.join(fusion.outcome(hits), "qid", "left")
    if lex is not None:
        out = out.join(lex.groupBy("qid").agg(F.max("strict_count").alias("strict_count"), F.bool_or("relaxed").alias("relaxed")), "qid", "left")
        if options.get("match", "all") != "any":
            out = out.withColumn("strict_count", F.coalesce("strict_count", F.lit(0).cast("long")))
    else:
        out = out.withColumns({"strict_count": F.lit(None).cast("long"), "relaxed": F.lit(False)})
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return hits, out.select("qid", zero("n_hits"), "strict_count", no("relaxed"), zero("weak_count"), no("abstained"))


def _search(spark: SparkSession, corpus: Corpus, queries, mode: str = "hybrid", k: int = 10, precision: str = "float", fusion_kind: str = "rrf", rrf_k: int = 60, alpha: float = 0.5, rerank: bool = False, depth: int = 50, match: str = "all", filters=None, explain: bool = False, on_stage=None, timings: list | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The hits and the keyword leg, if there is one.

    ``timings``: a list that gets the stages as they are done, (stage, rows,
    ms); each stage is then a job of its own whose result is kept, where
    otherwise all of them are one plan.
    """
    tell = on_stage or (lambda stage: None)
    tell("parse")
    began = [time.perf_counter()]

    def done(stage: str, df: DataFrame | None = None) -> DataFrame | None:
        if timings is None:
            return df
        rows, kept = 0, df
        if df is not None:
            kept = keep(df)
            rows = kept.count()
        now = time.perf_counter()
        timings.append({"stage": stage, "rows": rows, "ms": round(1000 * (now - began[0]), 3)})
        began[0] = now
        return kept

    if mode not in MODES:
        raise UsageError(f"unknown mode {mode!r} ({'|'.join(MODES)})")
    lexical.check_k(k)
    if match not in lexical.MATCHES or precision not in semantic.PRECISIONS or fusion_kind not in ("rrf", "linear"):
        raise UsageError("unknown match, precision or fusion")
    if mode == "hybrid" and rerank and (type(depth) is not int or not k <= depth <= lexical.MAX_RESULTS):
        raise UsageError(f"depth must be an integer within {k}..{lexical.MAX_RESULTS} when reranking")
    if mode != "lexical" and (corpus.vectors is None or corpus.embedder is None):
        raise UsageError("meaning search needs vectors and an embedder")
    asked = _checked(queries)
    fetch = max(k, depth) if mode == "hybrid" and rerank else k
    fit = allowed_docs(corpus.documents, filters)
    lex = sem = qv = None
    done("parse")
    if mode != "semantic":
        tell("lexical")
        lex = done("lexical", lexical.lexical_search(spark, corpus.index, asked, fetch, match, fit))
    if mode != "lexical":
        tell("embed")
        qv = query_vectors(spark, corpus.embedder, asked)
        done("embed")
        tell("semantic")
        sem = done("semantic", semantic.semantic_search(corpus.vectors, qv, fetch, precision, allowed=fit))
    none = lambda t: F.lit(None).cast(t)
    if mode == "lexical":
        hits = lex.select("qid", "rank", "doc_id", "score", F.col("rank").alias("lex_rank"), F.col("score").alias("lex_score"), none("int").alias("sem_rank"), none("double").alias("sem_score"))
    elif mode == "semantic":
        hits = sem.select("qid", "rank", "doc_id", "score", none("int").alias("lex_rank"), none("double").alias("lex_score"), F.col("rank").alias("sem_rank"), F.col("score").alias("sem_score"))
    else:
        tell("fuse")
        hits = fusion.rrf(lex, sem, rrf_k) if fusion_kind == "rrf" else fusion.linear(lex, sem, alpha)
        hits = done("fuse", hits.withColumn("fused_score", F.col("score")))
        if rerank:
            tell("rerank")
            hits = done("rerank", semantic.rerank(hits, corpus.vectors, qv, k).drop("seq"))
        else:
            hits = hits.where(F.col("rank") <= k)
    if "fused_score" not in hits.columns:
        hits = hits.withColumn("fused_score", none("double"))
    if sem is not None:
        hits = hits.join(sem.select("qid", "doc_id", "seq"), ["qid", "doc_id"], "left")
    else:
        hits = hits.withColumn("seq", none("int"))
    return _labelled(spark, corpus, asked, hits, lex, qv, mode, precision, match, rerank, explain), lex


def _labelled(spark, corpus, asked, hits, lex, qv, mode, precision, match, rerank, explain) -> DataFrame:
    words = {q: keyword_terms(t) for q, t in asked}
    terms = spark.createDataFrame([(q, w) for q, w in words.items()], "qid string, terms array<string>")
    flat = [(q, t) for q, w in words.items() for t in w]
    found = lexical.term_matches(spark, corpus.index, flat, hits) if flat else None
    hits = hits.join(terms, "qid", "left")
    hits = hits.join(found, ["qid", "doc_id"], "left") if found is not None else hits.withColumn("matched_terms", F.array().cast("array<string>"))
    matched = F.filter("terms", lambda t: F.array_contains(F.coalesce("matched_terms", F.array().cast("array<string>")), t))
    hits = hits.withColumn("matched_terms", matched).withColumn("missing_terms", F.array_except("terms", "matched_terms"))
    n, total = F.size("matched_terms"), F.size("terms")
    if lex is not None:
        tiers = lex.select("qid", "doc_id", (F.col("strict_count").isNull() | (F.col("rank") > F.col("strict_count"))).alias("partial"))
        hits = hits.join(tiers, ["qid", "doc_id"], "left").withColumn("partial", F.coalesce("partial", F.lit(False)))
    else:
        hits = hits.withColumn("partial", F.lit(False))
    similarity, kind = F.col("sem_score"), precision
    if precision == "binary" and qv is not None:
        dim = corpus.embedder.dimension
        exact = semantic.float_similarity(hits.where("sem_rank is not null"), corpus.vectors, qv)
        hits = hits.join(exact, ["qid", "doc_id"], "left")
        sem_label = F.when(F.col("float_similarity").isNotNull(), fusion.semantic_label(F.col("float_similarity"))).otherwise(fusion.semantic_label(1.0 + 2.0 * F.col("sem_score") / F.lit(dim), "binary"))
        similarity = F.coalesce("float_similarity", 1.0 + 2.0 * F.col("sem_score") / F.lit(dim))
    else:
        hits = hits.withColumn("float_similarity", F.lit(None).cast("double"))
        sem_label = fusion.semantic_label(similarity, kind)
    lex_label = F.when(F.col("lex_rank").isNotNull(), fusion.lexical_label(n, total, F.col("partial")))
    hits = hits.withColumns({"lex_label": lex_label, "sem_label": F.when(F.col("sem_rank").isNotNull(), sem_label), "similarity": similarity})
    hits = hits.withColumn("confidence", fusion.confidence(mode, F.col("lex_label"), F.col("sem_label"), F.col("partial"), n, total))
    keep = ["qid", "rank", "doc_id", "score", "lex_rank", "sem_rank", "seq", "confidence"]
    if not explain:
        return hits.select(*keep)
    both = F.col("lex_rank").isNotNull() & F.col("sem_rank").isNotNull()
    coverage = F.when(total == 0, None).when(n == total, "all").when(n > 0, "some").otherwise("none")
    keyword = F.when(total > 0, fusion.keyword_reason(F.col("matched_terms"), total))
    if mode == "semantic":
        keyword = F.when(total > 0, F.when(n > 0, fusion.keyword_reason(F.col("matched_terms"), total)).otherwise("No exact keyword matches"))
    reasons = F.array_compact(
        F.array(
            keyword,
            F.when(F.col("similarity").isNotNull() & F.col("sem_rank").isNotNull(), fusion.meaning_reason(F.col("similarity"), F.col("sem_label"))),
            F.when(F.lit(mode == "hybrid"), F.when(both, "Found by both keyword and meaning search").when(F.col("lex_rank").isNotNull(), "Found by keyword search only").otherwise("Found by meaning search only")),
            F.when(F.col("seq") > 0, F.lit("Closest passage is further down the note")),
            F.when(F.lit(mode != "lexical" and precision != "float"), F.lit("Compared using int8 vectors" if precision == "int8" else "Compared using binary (1-bit) vectors")),
            F.when(F.lit(mode == "hybrid" and rerank), F.lit("Re-ranked by full-precision meaning similarity")),
        )
    )
    six = lambda c: F.round(c, 6)
    detail = F.struct(
        F.lit(mode).alias("mode"), F.lit(None if mode == "lexical" else precision).cast("string").alias("precision"), "matched_terms", "missing_terms", "lex_rank", six("lex_score").alias("lexical_score"),
        "sem_rank", six("sem_score").alias("semantic_score"), six("fused_score").alias("fused_score"), "confidence", reasons.alias("reasons"), F.col("seq").alias("best_passage_seq"),
        coverage.alias("keyword_coverage"), F.lit(match if mode != "semantic" else None).cast("string").alias("lexical_match"), six("float_similarity").alias("float_similarity"),
    )
    return hits.select(*keep, detail.alias("explain"))


def results(hits: DataFrame, corpus: Corpus, queries, bookmarks: DataFrame | None = None) -> DataFrame:
    """Hits with metadata, duplicates, highlighted snippets and, given bookmarks, whether there is one; texts are fetched for the hits alone."""
    asked = corpus.documents.sparkSession.createDataFrame(_checked(queries), "qid string, query string")
    out = hits.join(asked, "qid").join(corpus.documents, "doc_id")
    if corpus.passages is not None:
        out = semantic.attach_passages(out, corpus.passages)
    else:
        out = out.withColumns({"passage_count": F.lit(None).cast("long"), "passage": F.lit(None).cast("string")})

    @F.pandas_udf(SEGMENTS)
    def light(body: pd.Series, query: pd.Series, passage: pd.Series, title: pd.Series) -> pd.Series:
        return pd.Series([build_snippet(b, q, p, None, t) for b, q, p, t in zip(body, query, passage, title)])

    out = out.withColumn("snippet", light("body", "query", "passage", "title"))
    if "content_hash" in corpus.documents.columns:
        out = analytics.with_twins(out, corpus.documents)
    if bookmarks is not None:
        out = analytics.is_bookmarked(bookmarks, out)
    return out.drop("body")


def alpha_sweep(lex: DataFrame, sem: DataFrame, steps: int = 10, k: int = 10) -> DataFrame:
    """(alpha, qid, rank, doc_id, score) for alpha = 0 to 1: the legs are read once and crossed with the grid of ``steps`` + 1 rows."""
    spark = lex.sparkSession
    grid = F.broadcast(spark.range(steps + 1).select((F.col("id") / steps).alias("alpha")))
    both = fusion._legs(lex, sem)
    q = Window.partitionBy("qid")

    def scaled(c):
        low, high = F.min(c).over(q), F.max(c).over(q)
        return F.coalesce(F.when(F.col(c).isNull(), None).when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low)), F.lit(0.0))

    parts = both.withColumns({"l": scaled("lex_score"), "s": scaled("sem_score")}).crossJoin(grid)
    a = F.col("alpha")
    score = F.when(a == 0, F.col("lex_score")).when(a == 1, F.col("sem_score")).otherwise(a * F.col("s") + (1 - a) * F.col("l"))
    scored = parts.withColumn("score", score).where(F.when(a == 0, F.col("lex_rank").isNotNull()).when(a == 1, F.col("sem_rank").isNotNull()).otherwise(True))
    order = Window.partitionBy("alpha", "qid").orderBy(F.desc("score"), F.coalesce(F.when(a == 0, F.col("lex_rank")), F.when(a == 1, F.col("sem_rank")), F.lit(0)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("alpha", "qid", "rank", "doc_id", "score")
