"""Rank fusion, confidence labels and explanations as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UsageError

# Cosine thresholds of the labels, and those for sign-bit similarity.
STRONG, WEAK = 0.50, 0.34
BINARY_STRONG, BINARY_WEAK = 0.36, 0.19


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """(qid, doc_id, score, lex_rank, sem_rank, rank): sum of 1 / (k + rank); ties by meaning, then id."""
    if type(k) is not int or k < 1:
        raise UsageError("rrf k must be a positive integer")
    both = _legs(lexical, semantic)
    part = lambda r: F.coalesce(1.0 / (F.lit(k) + F.col(r)), F.lit(0.0))
    scored = both.withColumn("score", part("lex_rank") + part("sem_rank"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("sem_rank").asc_nulls_last(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order))


def linear(lexical: DataFrame, semantic: DataFrame, alpha: float | Column = 0.5) -> DataFrame:
    """alpha x meaning + (1 - alpha) x keywords, each min-max scaled in its pool (all equal: 1; absent: 0).

    alpha 0 and 1 hand on one leg with its own scores and order.
    """
    if not isinstance(alpha, Column):
        if not 0.0 <= alpha <= 1.0:
            raise UsageError("alpha must be in [0, 1]")
        if alpha in (0.0, 1.0):
            side = "lex" if alpha == 0.0 else "sem"
            return _legs(lexical, semantic).where(F.col(f"{side}_rank").isNotNull()).withColumns({"score": F.col(f"{side}_score"), "rank": F.col(f"{side}_rank")})
        alpha = F.lit(alpha)
    both, q = _legs(lexical, semantic), Window.partitionBy("qid")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(q), F.max(c).over(q)
        return F.coalesce(F.when(F.col(c).isNull(), None).when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low)), F.lit(0.0))

    scored = both.withColumns({"l": scaled("lex_score"), "s": scaled("sem_score")}).withColumn("score", alpha * F.col("s") + (1.0 - alpha) * F.col("l")).drop("l", "s")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order))


def _legs(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Union of both legs, one row for each query and document."""
    a = lexical.select("qid", "doc_id", F.col("rank").alias("lex_rank"), F.col("score").alias("lex_score"))
    b = semantic.select("qid", "doc_id", F.col("rank").alias("sem_rank"), F.col("score").alias("sem_score"))
    none = lambda t, *names: {n: F.lit(None).cast(t) for n in names}
    union = a.withColumns({**none("int", "sem_rank"), **none("double", "sem_score")}).unionByName(b.withColumns({**none("int", "lex_rank"), **none("double", "lex_score")}))
    return union.groupBy("qid", "doc_id").agg(*[F.max(c).alias(c) for c in ("lex_rank", "lex_score", "sem_rank", "sem_score")])


def semantic_label(similarity: Column, precision: str = "float") -> Column:
    strong, weak = (BINARY_STRONG, BINARY_WEAK) if precision == "binary" else (STRONG, WEAK)
    return F.when(similarity.isNull(), None).when(similarity >= strong, "strong").when(similarity >= weak, "moderate").otherwise("weak")


def lexical_label(matched: Column, total: Column, partial: Column) -> Column:
    """All keywords: strong; a partial match: moderate if it has more than half; else moderate if it has any."""
    return (
        F.when(total <= 0, "moderate")
        .when(matched >= total, "strong")
        .when(partial, F.when(2 * matched > total, "moderate").otherwise("weak"))
        .when(matched > 0, "moderate")
        .otherwise("weak")
    )


def better(a: Column, b: Column) -> Column:
    """The stronger of two labels; a null one doesn't count."""
    level = lambda c: F.when(c == "strong", 3).when(c == "moderate", 2).when(c == "weak", 1).otherwise(0)
    return F.when(level(a) >= level(b), F.coalesce(a, F.lit("weak"))).otherwise(b)


def confidence(mode: str, lex: Column, sem: Column, partial: Column, matched: Column, total: Column) -> Column:
    """Label of a hit from the labels of its legs (null: not found by that leg)."""
    if mode == "lexical":
        return F.coalesce(lex, F.lit("weak"))
    if mode == "semantic":
        return F.coalesce(sem, F.lit("weak"))
    sure = lex.isNotNull() & sem.isNotNull() & (~partial | (matched >= total))
    return F.when(sure, "strong").otherwise(better(lex, sem))


def outcome(hits: DataFrame) -> DataFrame:
    """(qid, n_hits, weak_count, abstained): abstained if there are hits and all are weak."""
    weak = F.count(F.when(F.col("confidence") == "weak", 1))
    return hits.groupBy("qid").agg(F.count("*").alias("n_hits"), weak.alias("weak_count"), (weak == F.count("*")).alias("abstained"))


# The wording of the reasons below.


def keyword_reason(matched: Column, total: Column) -> Column:
    """matched: array of the words found."""
    n = F.size(matched)
    return (
        F.when((total == 1) & (n == 1), F.format_string("Matched the keyword “%s”", F.try_element_at(matched, F.lit(1))))
        .when(n == total, F.format_string("Matched all %d keywords", total))
        .when(n == 0, F.lit("No exact keyword matches"))
        .otherwise(F.format_string("Matched %d of %d keyword%s", n, total, F.when(total == 1, "").otherwise("s")))
    )


def meaning_reason(similarity: Column, label: Column) -> Column:
    text = lambda s: F.format_string(s + " (%.2f)", similarity)
    return F.when(label == "strong", text("Very close in meaning")).when(label == "moderate", text("Related in meaning")).otherwise(text("Only loosely related in meaning"))
