"""A corpus-cleaning pipeline over ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes every stage's result to
the shared checkpoint folder and hands a scan of it to the next stage, so a
lost executor costs no more than a stage's own work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table
from tessera.llm.linededup import drop_lines
from tessera.llm.mixing import apply_mixture, mix
from tessera.llm.neardup import simhash_dedup
from tessera.llm.packing import pack
from tessera.llm.toxicity import drop_toxic, train

#: DuckDB can express neither trained models nor the packing tree; tests compare with a plain Python version
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't score as toxic.

    Null and empty texts have the score of no evidence and stay if that is below
    one half; rows of one id are judged by their own texts; null ids stay; without
    labels of both kinds nothing is learnt and all stay; an empty table stays empty.
    """
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines but for the first; n_chars follows the text.

    Null texts stay null; a text of which all lines go stays as an empty one; rows
    without an id keep their lines and count for none; rows of equal text come out
    alike; ties for the first go to the least id, then text; all columns pass.
    """
    out = drop_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group linked by a five-word similarity of 0.8 or more.

    Null and blank texts are copies of each other and of nothing else; a text of
    fewer than five words is one shingle; rows without an id stay; of rows equal in
    id and text one stays; rows of one id and different texts are judged by text.
    """
    return simhash_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate asks for.

    Null and empty texts have no tokens but the closing one and the posterior of
    no evidence; rows equal in id share one chance, and so do all rows without an
    id: each such row is still drawn at its own rate; an empty table stays empty.
    """
    _, fitted = mix(docs, table(spark, sf_dir, "labels"))
    return apply_mixture(docs, fitted)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences.

    A null or empty text is the closing id alone; repeated rows are packed as rows
    of their own; null ids are packed too; an empty table gives no pieces.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
