"""Queries of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import decontam, filteraudit, spelling, urlfilter
from .ann import search
from .common import table
from .embdedup import embedding_dedup, oracle
from .linededup import drop_lines
from .mixing import mix
from .packing import pack
from .simhash import simhash_components
from .suffix import suffix_dedup
from .toxicity import fold_of, score_documents, train
from .trainorder import training_order


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(_docs(spark, sf_dir)).select("doc_id", "text", "n_dropped")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_docs(spark, sf_dir))


def op5_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, _ = mix(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "tokens", "posterior", "rate", "copies", "residual")


def op7_trainorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = training_order(_docs(spark, sf_dir))
    return shards.select("shard", F.regexp_extract("path", r"[^/]*$", 0).alias("file"), "first_slot", "n_sequences", "n_ids", "stride_bytes", "n_bytes", "crc32")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(_docs(spark, sf_dir), 50)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    chain = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, chain).select(
        "doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans"
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_docs(spark, sf_dir))


def op12_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_urlfilter": op1_urlfilter,
    "op2_linededup": op2_linededup,
    "op3_ann": op3_ann,
    "op4_simhash": op4_simhash,
    "op5_embdedup": op5_embdedup,
    "op6_mixing": op6_mixing,
    "op7_trainorder": op7_trainorder,
    "op8_packing": op8_packing,
    "op9_suffix": op9_suffix,
    "op10_toxicity": op10_toxicity,
    "op11_spelling": op11_spelling,
    "op12_decontam": op12_decontam,
    "op13_filteraudit": op13_filteraudit,
}
ORACLE: dict[str, str] = {
    "op1_urlfilter": urlfilter.oracle(), "op5_embdedup": oracle(),
    "op11_spelling": spelling.oracle(), "op12_decontam": decontam.oracle(), "op13_filteraudit": filteraudit.oracle(),
}
