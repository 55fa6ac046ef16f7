"""Retrieval test collections: corpus and queries (parquet or JSON lines), judgements (TSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet goes before JSON lines."""
    for pattern, read in ((f"{name}*.parquet", spark.read.parquet), (f"{name}*.jsonl", lambda p: spark.read.schema("_id string, title string, text string").json(p))):
        for where in (folder, f"{folder}/{name}"):
            if _exists(spark, f"{where}/{pattern}"):
                return read(f"{where}/{pattern}")
    raise DataError(f"no {name} in {folder}")


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, title, body)"""
    df = _table(spark, folder, "corpus")
    title = F.coalesce("title", F.lit("")) if "title" in df.columns else F.lit("")
    return df.select(F.col("_id").cast("string").alias("doc_id"), title.alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def load_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "queries").select(F.col("_id").cast("string").alias("qid"), F.col("text").alias("text"))


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of a TSV with a header: two columns whose names end in -id, and score."""
    df = spark.read.csv(path, sep="\t", header=True)
    ids = [c for c in df.columns if c.endswith("-id")]
    if len(ids) != 2 or "score" not in df.columns:
        raise DataError("judgements need two *-id columns and score")
    query = next((c for c in ids if c.startswith("query")), ids[0])
    other = next(c for c in ids if c != query)
    return df.select(F.col(f"`{query}`").alias("qid"), F.col(f"`{other}`").alias("doc_id"), F.col("score").cast("double").cast("int").alias("rel"))
