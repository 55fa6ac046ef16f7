"""Evaluation suites: every configuration answers all queries in one job."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.passages import with_passages
from ..functions.vectors import compose_embed_text, embed
from ..operators import analytics, lexical, metrics, semantic
from ..sources import beir
from .search import Corpus, alpha_sweep, query_vectors, search
from .store import Files

CONFIGS = (
    ("lexical", {"mode": "lexical"}),
    *[(f"semantic({p})", {"mode": "semantic", "precision": p}) for p in ("float", "int8", "binary")],
    *[(f"hybrid({p})", {"mode": "hybrid", "precision": p}) for p in ("float", "int8", "binary")],
    ("hybrid(float)+rerank", {"mode": "hybrid", "precision": "float", "rerank": True}),
)


def build_corpus(docs: DataFrame, embedder, tokenizer: str = "porter") -> Corpus:
    """Whole documents (no passages) with index and vectors, kept in memory for the suite."""
    docs = docs.cache()
    passages = with_passages(docs, None)
    text = docs.select("doc_id", F.lit(0).alias("seq"), compose_embed_text(F.col("title"), F.col("body")).alias("t"))
    index = lexical.build_index(docs, "doc_id", "title", "body", tokenizer)
    index.postings, index.lengths = index.postings.cache(), index.lengths.cache()
    return Corpus(docs, index, passages, embed(text, embedder, "t").select("doc_id", "seq", "embedding").cache(), embedder)


def run_suite(spark: SparkSession, corpus: Corpus, queries: list[tuple[str, str]], qrels: DataFrame, k: int = 10, configs=CONFIGS) -> list[dict]:
    """Quality and time per query of each configuration; judged queries only."""
    judged = {r.qid for r in qrels.select("qid").distinct().collect()}
    asked = [(q, t) for q, t in queries if q in judged]
    out = []
    for name, kw in configs:
        began = time.perf_counter()
        run = search(spark, corpus, asked, k=k, **kw).select("qid", "doc_id", "rank").cache()
        run.count()
        took = time.perf_counter() - began
        row = metrics.evaluate(run, qrels, k).first().asDict()
        out.append({"config": name, **{m: round(v or 0.0, 4) for m, v in row.items()}, "queries": len(asked), "ms_per_query": round(1000 * took / max(1, len(asked)), 2)})
        run.unpersist()
    return out


def dataset_fingerprint(spark: SparkSession, folder: str, qrels_path: str) -> str:
    """A SHA-256 of a test collection's rows; equal for equal rows, however they are split into files."""
    parts = {"corpus": beir.load_corpus(spark, folder), "queries": beir.load_queries(spark, folder), "qrels": beir.load_qrels(spark, qrels_path)}
    rows = [df.select(F.concat(F.lit(f"{name} "), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)).alias("row")) for name, df in parts.items()]
    return analytics.id_digest(reduce(DataFrame.unionByName, rows), "row").first().digest


def run_eval(spark: SparkSession, folder: str, qrels_path: str, embedder, k: int = 10, publish: str | None = None) -> list[dict]:
    """Every configuration on a test collection. With ``publish``, a manifest and a report appear in that folder, whole or not at all."""
    queries = [(r.qid, r.text) for r in beir.load_queries(spark, folder).collect()]
    corpus = build_corpus(beir.load_corpus(spark, folder), embedder)
    rows = run_suite(spark, corpus, queries, beir.load_qrels(spark, qrels_path), k)
    if publish:
        model = {"name": embedder.name, "revision": embedder.revision, "dimension": embedder.dimension}
        manifest = {"dataset": folder, "qrels": qrels_path, "fingerprint": dataset_fingerprint(spark, folder, qrels_path), "model": model, "k": k, "documents": corpus.documents.count(), "queries": len(queries), "created_at": time.time(), "results": rows}
        publish_report(spark, publish, {"manifest.json": json.dumps(manifest, indent=1), "report.md": report(rows, "Evaluation")})
    return rows


def publish_report(spark: SparkSession, folder: str, contents: dict[str, str]) -> None:
    """Write some small files to a new folder and rename it into place; an older report is kept beside it."""
    files, folder = Files(spark), folder.rstrip("/")
    staged = f"{folder}.writing-{time.time_ns()}"
    for name, text in contents.items():
        files.create(f"{staged}/{name}", text)
    if files.exists(folder):
        files.rename(folder, f"{folder}-before-{time.time_ns()}")
    files.rename(staged, folder)


def run_alpha_sweep(spark: SparkSession, folder: str, qrels_path: str, embedder, k: int = 10, publish: str | None = None) -> list[dict]:
    """Quality of linear fusion for alpha = 0 to 1, and of rank fusion as the row to beat."""
    corpus, qrels = build_corpus(beir.load_corpus(spark, folder), embedder), beir.load_qrels(spark, qrels_path)
    queries = [(r.qid, r.text) for r in beir.load_queries(spark, folder).collect()]
    rows = [{"alpha": r.alpha, **{m: round(r[m] or 0.0, 4) for m in ("ndcg", "map", "mrr", "precision")}} for r in run_sweep(spark, corpus, queries, qrels, k).orderBy("alpha").collect()]
    rrf = run_suite(spark, corpus, queries, qrels, k, [("rrf", {"mode": "hybrid", "precision": "float"})])[0]
    rows.append({"alpha": "rrf", **{m: rrf[m] for m in ("ndcg", "map", "mrr", "precision")}})
    if publish:
        manifest = {"dataset": folder, "qrels": qrels_path, "fingerprint": dataset_fingerprint(spark, folder, qrels_path), "k": k, "created_at": time.time(), "results": rows}
        publish_report(spark, publish, {"manifest.json": json.dumps(manifest, indent=1), "report.md": report(rows, "Sweep of alpha")})
    return rows


def run_sweep(spark: SparkSession, corpus: Corpus, queries: list[tuple[str, str]], qrels: DataFrame, k: int = 10, match: str = "all") -> DataFrame:
    """(alpha, ndcg, map, mrr, precision) for alpha = 0, 0.1 ... 1 in one plan."""
    judged = {r.qid for r in qrels.select("qid").distinct().collect()}
    asked = [(q, t) for q, t in queries if q in judged]
    lex = lexical.lexical_search(spark, corpus.index, asked, k, match)
    sem = semantic.semantic_search(corpus.vectors, query_vectors(spark, corpus.embedder, asked), k)
    key = F.concat_ws("|", F.col("alpha").cast("string"), "qid")
    swept = alpha_sweep(lex.cache(), sem.cache(), 10, k)
    grid = spark.range(11).select((F.col("id") / 10).alias("alpha"))
    wide = qrels.crossJoin(F.broadcast(grid)).select(key.alias("qid"), "doc_id", "rel")  # eleven rows
    per = metrics.per_query(swept.select(key.alias("qid"), "doc_id", "rank"), wide, k)
    alpha = F.split_part("qid", F.lit("|"), F.lit(1)).cast("double")
    return per.groupBy(alpha.alias("alpha")).agg(F.avg("ndcg").alias("ndcg"), F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.avg("precision").alias("precision"))


def run_smoke(spark: SparkSession, corpus: Corpus, gold: list[dict], k: int = 5) -> dict:
    """hit@3, MRR and no-answer accuracy of gold queries [{query, relevant, mode}]."""
    rows, runs = [], None
    for mode in sorted({g.get("mode", "hybrid") for g in gold}):
        part = [(str(i), g["query"]) for i, g in enumerate(gold) if g.get("mode", "hybrid") == mode]
        hits = search(spark, corpus, part, mode=mode, k=k, match="auto").select("qid", "doc_id", "rank", "confidence")
        runs = hits if runs is None else runs.unionByName(hits)
    for i, g in enumerate(gold):
        rows += [(str(i), d) for d in g["relevant"]] or [(str(i), None)]
    weak = runs.groupBy("qid").agg(F.bool_and(F.col("confidence") == "weak").alias("abstained"))
    return metrics.smoke(runs.join(weak, "qid"), spark.createDataFrame(rows, "qid string, doc_id string"), min(3, k)).first().asDict()


def load_gold(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def report(rows: list[dict], title: str) -> str:
    """A Markdown table of a suite."""
    names = list(rows[0]) if rows else []
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]) + "\n"
