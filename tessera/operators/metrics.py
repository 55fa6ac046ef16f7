"""Retrieval quality over flat runs (qid, doc_id, rank) and judgements (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_run(run: DataFrame) -> DataFrame:
    """Ranks of a scored run: score down, id up."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, ap, rr, precision) at k for every judged query; queries without hits score 0.

    nDCG has linear gains over log2(rank + 1) and the ideal order below it; AP
    divides by all relevant documents, precision by k.
    """
    good = qrels.where("rel > 0")
    ideal = good.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"))))
    ideal = ideal.groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1))).alias("idcg"), F.count("*").alias("n_rel"))
    hits = run.where(F.col("rank") <= k).join(good, ["qid", "doc_id"])
    hits = hits.withColumn("found", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    got = hits.groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("found") / F.col("rank")).alias("ap"), F.min("rank").alias("first"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    judged = qrels.select("qid").distinct().join(ideal, "qid", "left").join(got, "qid", "left")
    return judged.select("qid", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("ap") / F.col("n_rel")).alias("ap"), zero(1.0 / F.col("first")).alias("rr"), zero(F.col("n") / F.lit(k)).alias("precision"))


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean ndcg, map, mrr and precision at k over the judged queries."""
    return per_query(run, qrels, k).agg(F.avg("ndcg").alias("ndcg"), F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.avg("precision").alias("precision"))


def smoke(run: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """One row: hit@k and MRR over answerable queries, accuracy over those without an answer.

    gold: (qid, doc_id), doc_id null for a query without an answer; run: (qid,
    doc_id, rank, abstained).
    """
    answer = gold.where("doc_id is not null")
    first = answer.join(run, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    asked = answer.select("qid").distinct().join(first, "qid", "left")
    hit = asked.agg(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("hit"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    silent = gold.where("doc_id is null").select("qid").join(run.groupBy("qid").agg(F.bool_and("abstained").alias("abstained")), "qid", "left")
    return hit.crossJoin(F.broadcast(silent.agg(F.avg(F.when(F.coalesce("abstained", F.lit(True)), 1.0).otherwise(0.0)).alias("no_answer"))))  # one row each


#: values that are sorted at once; more are narrowed down first
SORTED, CUTS = 4096, 1024


def percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the nearest-rank percentile, index round(p (n - 1)) half to even; null values don't count, NaN comes last.

    Counts in ``CUTS`` equal intervals tell which of them holds the rank; it is
    cut again until few values are left or all are equal, so no task ever holds
    the series. Each turn is one aggregation with a row for each interval.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    finite = v.where("not isnan(v) and abs(v) < double('infinity')")
    total, below, n, low, high = v.agg(F.count("*"), F.count_if(F.col("v") == float("-inf")), F.count_if(~F.isnan("v") & (F.abs("v") < float("inf"))), F.min(F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))), F.max(F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v")))).first()
    answer = lambda x: values.sparkSession.createDataFrame([(x,)], "value double")
    if not total:
        return answer(None)
    rank = round((total - 1) * float(p))
    if not below <= rank < below + n:
        return v.where("isnan(v) or abs(v) = double('infinity')").orderBy("v").offset(rank - n if rank >= below else rank).limit(1).select(F.col("v").alias("value"))
    rank -= below
    while n > SORTED and low < high:
        width = (high - low) / CUTS
        cut = F.least(F.lit(CUTS - 1), F.floor((F.col("v") - low) / F.lit(width))) if width > 0 else F.lit(0)
        found = finite.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy(cut.alias("cut")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("cut").collect()
        for part in found:
            if rank < part["n"]:
                break
            rank -= part["n"]
        if part["n"] == n and (part["low"], part["high"]) == (low, high):
            break  # neighbours in double precision
        n, low, high = part["n"], part["low"], part["high"]
    if low == high:
        return answer(low)
    return finite.where((F.col("v") >= low) & (F.col("v") <= high)).orderBy("v").offset(rank).limit(1).select(F.col("v").alias("value"))
