"""Registered queries over the driver's tables, each with SQL for DuckDB where SQL can express it.

Scores are rounded to six digits before they rank, on both sides, because sums
of doubles depend on the order of their terms.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.passages import DEFAULT, count_words, split_passages
from ..functions.snippets import best_passage, segments_with_terms
from ..functions.text import content_tokens, keyword_terms, simple_tokens
from ..operators import analytics, changes, fusion, lexical, metrics, semantic
from ..operators.filters import SearchFilters, allowed
from ..sources.files import front_matter
from ..sources.tables import file_stamp, shared_folder, spread
from . import search as plan
from .store import Collection

QUERY_SET = [("q1", "tion thon ther"), ("q2", "ndtion estion the"), ("q3", "the thor anea thor"), ("q4", "éle oution")]
QUERY_VECTORS = {"q1": 1, "q2": 7, "q3": 42, "q4": 99}
K = 10
CLASS = r"[\p{L}\p{N}\p{Co}]+"

#: columns that SQL counts in 64 bits
COUNTERS = ("rank", "tf", "seq", "lex_rank", "sem_rank", "n_tokens", "n_distinct", "matched")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("long") for c in df.columns if c in COUNTERS})

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").withColumnRenamed("text", "body")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and texts, dealt over all cores for work on the texts."""
    return spread(_docs(spark, sf).select("doc_id", "body"))


def _index(spark: SparkSession, sf: str, tokenizer: str = "simple") -> lexical.TextIndex:
    """The stored index of the documents: built by the first query that needs it, and anew when a file of theirs changes."""
    stamp = hashlib.sha256(f"{tokenizer}\n{file_stamp(spark, f'{sf}/documents.parquet')}".encode()).hexdigest()[:32]
    folder = f"{shared_folder(spark)}/tessera/index-{stamp}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/stats/_SUCCESS")
    files = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(done):
        files.delete(done.getParent().getParent(), True)  # what a lost run may have left
        lexical.save_index(lexical.build_index(_texts(spark, sf), tokenizer=tokenizer), folder)
    return lexical.load_index(spark, folder, tokenizer)


def _vectors(spark: SparkSession, sf: str, per: int = 1) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    return v.select(F.floor(F.col("vec_id") / per).cast("long").alias("doc_id"), (F.col("vec_id") % per).cast("int").alias("seq"), "embedding", "label", "vec_id")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.create_map(*[F.lit(x) for q, v in QUERY_VECTORS.items() for x in (v, q)])
    return _t(spark, sf, "embeddings").where(F.col("vec_id").isin(*QUERY_VECTORS.values())).select(F.element_at(pick, F.col("vec_id").cast("int")).alias("qid"), "embedding")


# -- SQL parts -----------------------------------------------------------------


def _values(match: str) -> str:
    from ..functions.text import all_tokens

    rows = []
    for q, text in QUERY_SET:
        words = [w.lower() for w in (all_tokens if match == "all" else content_tokens)(text)]
        rows += [f"('{q}', {i}, '{w}', {len(words)})" for i, w in enumerate(words)]
    return f"(VALUES {', '.join(rows)}) AS q(qid, phrase, term, n_phrases)"


def _bm25_sql(match: str, where: str = "TRUE") -> str:
    """CTEs d, s, b: b has (qid, doc_id, score, matched, n_phrases) with rounded scores."""
    return f"""
d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '{CLASS}') AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts)) / count(*) AS avgdl FROM d),
h AS (SELECT * FROM (SELECT q.qid, q.phrase, q.n_phrases, d.doc_id, d.lang, d.source, len(d.ts) AS len, len(list_filter(d.ts, lambda x: x = q.term)) AS tf FROM d, {_values(match)}) WHERE tf > 0),
w AS (SELECT qid, phrase, CASE WHEN ln((n_docs - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)) END AS idf, avgdl FROM h, s GROUP BY qid, phrase, n_docs, avgdl),
b AS (SELECT qid, doc_id, n_phrases, count(*) AS matched, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score FROM h JOIN w USING (qid, phrase) WHERE {where} GROUP BY qid, doc_id, n_phrases)"""


def _lex_sql(match: str, where: str = "TRUE", name: str = "lex", k: int = K) -> str:
    keep = "WHERE matched = n_phrases" if match == "all" else ""
    return f"{_bm25_sql(match, where)},\n{name} AS (SELECT * FROM (SELECT qid, doc_id, score, matched, n_phrases, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM b {keep}) WHERE rank <= {k})"


def _score_sql(precision: str) -> str:
    unit = "list_transform({x}, lambda z: greatest(-127, least(127, round_even(z::DOUBLE / (1.0::DOUBLE / 127.0::DOUBLE), 0)))::DOUBLE)"
    if precision == "int8":
        return f"list_cosine_similarity({unit.format(x='a.embedding')}, {unit.format(x='v.embedding')})"
    if precision == "binary":
        return "-list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST((a.embedding[i] > 0) <> (v.embedding[i] > 0) AS INT)))::DOUBLE"
    return "list_cosine_similarity(a.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _sem_sql(precision: str = "float", per: int = 1, where: str = "TRUE", k: int = K, asked: str | None = None) -> str:
    pick = " ".join(f"WHEN {v} THEN '{q}'" for q, v in QUERY_VECTORS.items())
    asked = asked or f"SELECT CASE vec_id {pick} END AS qid, embedding FROM embeddings WHERE vec_id IN ({', '.join(map(str, QUERY_VECTORS.values()))})"
    return f"""
a AS ({asked}),
c AS (SELECT a.qid, v.vec_id // {per} AS doc_id, v.vec_id % {per} AS seq, round({_score_sql(precision)}, 6) AS score FROM a, embeddings v WHERE {where}),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, seq) AS r FROM c) WHERE r = 1),
sem AS (SELECT * FROM (SELECT qid, doc_id, seq, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM p) WHERE rank <= {k})"""


LEGS_SQL = """
legs AS (SELECT coalesce(l.qid, m.qid) AS qid, coalesce(l.doc_id, m.doc_id) AS doc_id, l.rank AS lex_rank, l.score AS lex_score, m.rank AS sem_rank, m.score AS sem_score
  FROM lex l FULL JOIN sem m ON l.qid = m.qid AND l.doc_id = m.doc_id)"""
NORM_SQL = """
mm AS (SELECT *, min(lex_score) OVER w AS ll, max(lex_score) OVER w AS lh, min(sem_score) OVER w AS sl, max(sem_score) OVER w AS sh FROM legs WINDOW w AS (PARTITION BY qid)),
nn AS (SELECT *, CASE WHEN lex_score IS NULL THEN 0.0 WHEN lh = ll THEN 1.0 ELSE (lex_score - ll) / (lh - ll) END AS l, CASE WHEN sem_score IS NULL THEN 0.0 WHEN sh = sl THEN 1.0 ELSE (sem_score - sl) / (sh - sl) END AS m FROM mm)"""


def _lex(spark: SparkSession, sf: str, match: str = "any", k: int = K, **kw) -> DataFrame:
    return lexical.lexical_search(spark, _index(spark, sf), QUERY_SET, k, match, digits=6, **kw)


def _sem(spark: SparkSession, sf: str, precision: str = "float", **kw) -> DataFrame:
    return semantic.semantic_search(_vectors(spark, sf), _asked(spark, sf), K, precision, digits=6, **kw)


# -- keyword search ---------------------------------------------------------------

HITS = ("qid", "rank", "doc_id", "score")


@query(f"WITH {_lex_sql('any')} SELECT qid, rank, doc_id, score, matched FROM lex")
def lexical_any_bm25(spark, sf):
    return _lex(spark, sf).select(*HITS, "matched")


@query(f"WITH {_lex_sql('any')} SELECT qid, rank, doc_id, score, matched FROM lex")
def lexical_any_blockmax(spark, sf):
    """The same search when the stored index skips blocks, which larger tables make it do by itself."""
    return _lex(spark, sf, skip_from=0).select(*HITS, "matched")


@query(f"WITH {_lex_sql('all')} SELECT qid, rank, doc_id, score FROM lex")
def lexical_all_bm25(spark, sf):
    return _lex(spark, sf, "all").select(*HITS)


@query(
    f"""WITH {_bm25_sql('auto')},
t AS (SELECT *, CASE WHEN matched = n_phrases THEN 0 ELSE 1 END AS tier FROM b),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, doc_id) AS rank FROM t) WHERE rank <= {K}),
f AS (SELECT *, min(CASE WHEN tier = 0 THEN score END) OVER (PARTITION BY qid) AS lo, max(CASE WHEN tier = 1 THEN score END) OVER (PARTITION BY qid) AS hi, count(CASE WHEN tier = 0 THEN 1 END) OVER (PARTITION BY qid) AS strict_count FROM r)
SELECT qid, rank, doc_id, tier, strict_count, round(CASE WHEN tier = 1 AND hi >= lo THEN CASE WHEN lo > 0 AND hi > 0 THEN score * (lo / hi) * 0.999 ELSE score - (hi - lo + greatest(1e-6, abs(lo) * 1e-3)) END ELSE score END, 5) AS score FROM f"""
)
def lexical_auto_bm25(spark, sf):
    return _lex(spark, sf, "auto").select("qid", "rank", "doc_id", "tier", "strict_count", F.round("score", 5).alias("score"))


@query(f"""WITH {_lex_sql('any', "lang = 'en' AND source IN ('src1', 'src2', 'src3', 'src4')")} SELECT qid, rank, doc_id, score FROM lex""")
def lexical_filtered_bm25(spark, sf):
    fit = _docs(spark, sf).where((F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3", "src4"))
    return _lex(spark, sf, allowed=fit).select(*HITS)


_PAIR = "len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the'))"


@query(
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{CLASS}') AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts)) / count(*) AS avgdl FROM d),
h AS (SELECT * FROM (SELECT doc_id, len(ts) AS len, {_PAIR} AS tf FROM d) WHERE tf > 0),
w AS (SELECT count(*) AS n FROM h)
SELECT doc_id, tf, rank, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT doc_id, tf, round(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl)), 6) AS score FROM h, s, w)) WHERE rank <= 20"""
)
def lexical_phrase_bm25(spark, sf):
    index = _index(spark, sf)
    wanted = lexical.phrases(spark, index, [("p", "of-the")], "all")
    tf = lexical._phrase_hits(index, wanted).select("doc_id", "tf")
    hits = lexical.lexical_search(spark, index, [("p", "of-the")], 20, "all", digits=6)
    return hits.join(tf, "doc_id").select("doc_id", "tf", "rank", "score")


@query()
def lexical_porter_bm25(spark, sf):
    return lexical.lexical_search(spark, _index(spark, sf, "porter"), QUERY_SET, K, "any").select(*HITS)


_TERMS = ", ".join(f"('{q}', '{t}')" for q, text in QUERY_SET for t in keyword_terms(text))


@query(
    f"""WITH {_lex_sql('any')}, t AS (SELECT * FROM (VALUES {_TERMS}) AS t(qid, term))
SELECT lex.qid, lex.doc_id, t.term FROM lex JOIN t USING (qid) JOIN d ON d.doc_id = lex.doc_id WHERE list_contains(d.ts, t.term)"""
)
def term_matches(spark, sf):
    terms = [(q, t) for q, text in QUERY_SET for t in keyword_terms(text)]
    found = lexical.term_matches(spark, _index(spark, sf), terms, _lex(spark, sf))
    return found.select("qid", "doc_id", F.explode("matched_terms").alias("term"))


_LABEL = "CASE WHEN matched >= n_phrases THEN 'strong' WHEN 2 * matched > n_phrases THEN 'moderate' ELSE 'weak' END"


@query(f"WITH {_lex_sql('any', k=30)} SELECT qid, doc_id, {_LABEL} AS confidence FROM lex")
def lexical_confidence(spark, sf):
    hits = _lex(spark, sf, k=30)
    return hits.select("qid", "doc_id", fusion.lexical_label(F.col("matched"), F.col("n_phrases"), F.lit(True)).alias("confidence"))


@query(f"""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{CLASS}')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{CLASS}'))) AS n_distinct FROM documents""")
def token_counts(spark, sf):
    t = _texts(spark, sf).select("doc_id", simple_tokens(F.col("body")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{CLASS}')) AS term FROM documents) GROUP BY term""")
def term_statistics(spark, sf):
    p = _texts(spark, sf).select("doc_id", F.explode(simple_tokens(F.col("body"))).alias("term"))
    per = p.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


# -- vector search ------------------------------------------------------------------


@query(f"WITH {_sem_sql('float')} SELECT qid, rank, doc_id, score FROM sem")
def semantic_float_topk(spark, sf):
    return _sem(spark, sf).select(*HITS)


@query(f"WITH {_sem_sql('int8')} SELECT qid, rank, doc_id, score FROM sem")
def semantic_int8_topk(spark, sf):
    return _sem(spark, sf, "int8").select(*HITS)


@query(f"WITH {_sem_sql('binary')} SELECT qid, rank, doc_id, score FROM sem")
def semantic_binary_topk(spark, sf):
    return _sem(spark, sf, "binary").select(*HITS)


@query(f"WITH {_sem_sql('float', where='v.label IN (1, 2)')} SELECT qid, rank, doc_id, score FROM sem")
def semantic_filtered_topk(spark, sf):
    return _sem(spark, sf, allowed=_vectors(spark, sf).where(F.col("label").isin(1, 2))).select(*HITS)


@query(f"WITH {_sem_sql('float', per=3)} SELECT qid, rank, doc_id, seq, score FROM sem")
def semantic_best_passage(spark, sf):
    return semantic.semantic_search(_vectors(spark, sf, 3), _asked(spark, sf), K, digits=6).select(*HITS, "seq")


_BATCH = "SELECT vec_id::VARCHAR AS qid, embedding FROM embeddings"


@query(f"WITH {_sem_sql('float', where='v.vec_id::VARCHAR <> a.qid', k=5, asked=_BATCH)} SELECT qid, rank, doc_id, score FROM sem")
def batch_semantic_topk(spark, sf):
    asked = _t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("qid"), "embedding")
    return semantic.semantic_search(_vectors(spark, sf), asked, 5, digits=6, exclude_self=True).select(*HITS)


@query("SELECT round(greatest(coalesce(max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 0) / 127.0, 1e-8), 12) AS scale FROM embeddings")
def int8_calibration(spark, sf):
    return V.calibrate_scale(_t(spark, sf, "embeddings")).select(F.round("scale", 12).alias("scale"))


_NIBBLE = "list_transform(range(0, len(embedding), 4), lambda i: lower(hex(" + " + ".join(f"CASE WHEN embedding[i + {j}] > 0 THEN {8 >> (j - 1)} ELSE 0 END" for j in (1, 2, 3, 4)) + ")[-1:]))"


@query(f"SELECT vec_id, list_aggregate({_NIBBLE}, 'string_agg', '') AS bits FROM embeddings")
def binary_pack_bits(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", V.pack_bits(F.col("embedding")).alias("bits"))


@query(
    """SELECT vec_id, list_sum(list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::DOUBLE / (1.0::DOUBLE / 127.0::DOUBLE), 0)))))::BIGINT AS total,
list_max(list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::DOUBLE / (1.0::DOUBLE / 127.0::DOUBLE), 0)))))::BIGINT AS top FROM embeddings"""
)
def int8_quantize(spark, sf):
    q = _t(spark, sf, "embeddings").select("vec_id", V.quantize_int8(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("q").cast("long").alias("top"))


# -- fusion ---------------------------------------------------------------------------


def _hybrid(spark, sf, match="any"):
    return _lex(spark, sf, match), _sem(spark, sf)


_RRF = f"""WITH {_lex_sql('any')}, {_sem_sql()}, {LEGS_SQL},
f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + lex_rank), 0) + coalesce(1.0::DOUBLE / (60 + sem_rank), 0) AS score FROM legs),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, sem_rank ASC NULLS LAST, doc_id) AS rank FROM f)"""


@query(f"{_RRF} SELECT qid, rank, doc_id, lex_rank, sem_rank, round(score, 9) AS score FROM o WHERE rank <= {K}")
def rrf_fusion(spark, sf):
    return fusion.rrf(*_hybrid(spark, sf)).where(F.col("rank") <= K).select("qid", "rank", "doc_id", "lex_rank", "sem_rank", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_lex_sql('any')}, {_sem_sql()}, {LEGS_SQL}, {NORM_SQL},
o AS (SELECT qid, doc_id, 0.5 * m + (1.0 - 0.5) * l AS score FROM nn)
SELECT qid, doc_id, round(score, 6) AS score FROM o"""
)
def linear_fusion(spark, sf):
    return fusion.linear(*_hybrid(spark, sf), 0.5).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_lex_sql('any')}, {_sem_sql()}, {LEGS_SQL}, {NORM_SQL},
g AS (SELECT i / 10.0::DOUBLE AS alpha FROM range(11) t(i)),
o AS (SELECT alpha, qid, doc_id, CASE WHEN alpha = 0 THEN lex_score WHEN alpha = 1 THEN sem_score ELSE alpha * m + (1 - alpha) * l END AS score, CASE WHEN alpha = 0 THEN lex_rank WHEN alpha = 1 THEN sem_rank ELSE 0 END AS r FROM nn, g
  WHERE (alpha = 0 AND lex_rank IS NOT NULL) OR (alpha = 1 AND sem_rank IS NOT NULL) OR (alpha > 0 AND alpha < 1))
SELECT round(alpha, 1) AS alpha, qid, count(*) AS n, round(sum(score), 5) AS total FROM o GROUP BY alpha, qid"""
)
def linear_alpha_grid(spark, sf):
    swept = plan.alpha_sweep(*_hybrid(spark, sf), 10, 2 * K)
    return swept.groupBy(F.round("alpha", 1).alias("alpha"), "qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 5).alias("total"))


_RERANK = f"""{_RRF},
rr AS (SELECT o.qid, o.doc_id, coalesce(round(list_dot_product(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6), -2.0) AS score FROM o LEFT JOIN embeddings v ON v.vec_id = o.doc_id LEFT JOIN a ON a.qid = o.qid)
SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM rr) WHERE rank <= 5"""


@query(_RERANK)
def hybrid_rerank(spark, sf):
    pool = fusion.rrf(*_hybrid(spark, sf))
    return semantic.rerank(pool, _vectors(spark, sf), _asked(spark, sf), 5).select("qid", "doc_id", F.round("score", 6).alias("score"))


_CONF = f"""{_RRF},
k AS (SELECT o.*, b.matched, b.n_phrases FROM o LEFT JOIN b ON b.qid = o.qid AND b.doc_id = o.doc_id AND o.lex_rank IS NOT NULL),
z AS (SELECT qid, doc_id, rank, matched, n_phrases, lex_rank, sem_rank, CASE WHEN lex_rank IS NOT NULL THEN {_LABEL} END AS ll, CASE WHEN sem_rank IS NULL THEN NULL WHEN sem_score >= 0.5 THEN 'strong' WHEN sem_score >= 0.34 THEN 'moderate' ELSE 'weak' END AS sl FROM k),
y AS (SELECT qid, doc_id, CASE WHEN lex_rank IS NOT NULL AND sem_rank IS NOT NULL AND matched >= n_phrases THEN 'strong'
  WHEN 'strong' IN (coalesce(ll, ''), coalesce(sl, '')) THEN 'strong' WHEN 'moderate' IN (coalesce(ll, ''), coalesce(sl, '')) THEN 'moderate' ELSE 'weak' END AS confidence FROM z)"""


def _confident(spark, sf):
    lex, sem = _hybrid(spark, sf)
    hits = fusion.rrf(lex, sem).join(lex.select("qid", "doc_id", "matched", "n_phrases"), ["qid", "doc_id"], "left")
    ll = F.when(F.col("lex_rank").isNotNull(), fusion.lexical_label(F.col("matched"), F.col("n_phrases"), F.lit(True)))
    sl = F.when(F.col("sem_rank").isNotNull(), fusion.semantic_label(F.col("sem_score")))
    return hits.select("qid", "doc_id", fusion.confidence("hybrid", ll, sl, F.lit(True), F.col("matched"), F.col("n_phrases")).alias("confidence"))


@query(f"{_CONF} SELECT * FROM y")
def hybrid_confidence(spark, sf):
    return _confident(spark, sf)


@query(f"{_CONF} SELECT qid, count(*) AS n_hits, count(CASE WHEN confidence = 'weak' THEN 1 END) AS weak_count, count(CASE WHEN confidence = 'weak' THEN 1 END) = count(*) AS abstained FROM y GROUP BY qid")
def hybrid_abstain(spark, sf):
    return fusion.outcome(_confident(spark, sf))


@query(
    """SELECT doc_id FROM (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'notes/' || source ELSE source END AS folder, [lang, source] AS tags, n_chars::DOUBLE AS mtime FROM documents)
WHERE (lower(folder) = 'notes' OR starts_with(lower(folder), 'notes/') OR lower(folder) = 'src5') AND (list_contains(tags, 'en') OR list_contains(tags, 'src5')) AND mtime >= 100 AND mtime <= 20000"""
)
def metadata_filters(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit("notes/"), "source")).otherwise(F.col("source")).alias("folder"), F.array("lang", "source").alias("tags"), F.col("n_chars").cast("double").alias("mtime"), F.lit(None).cast("string").alias("ext"))
    return allowed(d, SearchFilters(folders=("Notes", "src5/"), tags=("EN", "src5"), modified_after=100, modified_before=20000))


# -- read models ---------------------------------------------------------------------------


@query("SELECT count(*) AS n, min(doc_id) AS first_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return analytics.duplicate_groups(_docs(spark, sf).withColumn("content_hash", F.sha2("body", 256)))


@query("SELECT doc_id, first_id, n FROM (SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS n FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY sha256(text))) WHERE n > 1")
def duplicate_classes(spark, sf):
    return analytics.duplicate_classes(_docs(spark, sf).withColumn("content_hash", F.sha2("body", 256)))


@query("SELECT a.doc_id AS id, b.doc_id AS other FROM benchmark i JOIN documents a ON a.doc_id = i.item_id JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id")
def duplicates_of(spark, sf):
    d = _docs(spark, sf).withColumn("content_hash", F.sha2("body", 256))
    return analytics.duplicates_of(d, _t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")))


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def facets_source_lang(spark, sf):
    return analytics.facets(_docs(spark, sf), "lang", "source")


@query("SELECT value, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest([lang, source]) AS value FROM documents) WHERE value IS NOT NULL GROUP BY value")
def facets_tags(spark, sf):
    return analytics.tag_facet(_docs(spark, sf).withColumn("tags", F.array_compact(F.array("lang", "source"))))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY event_id DESC LIMIT 20")
def recent_searches(spark, sf):
    e = _t(spark, sf, "events").withColumn("id", F.col("event_id"))
    return analytics.recent_searches(e, 20, ("user_id", "event_type")).select("user_id", "event_type", "event_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 200")
def history_retention(spark, sf):
    return analytics.keep_newest(_t(spark, sf, "events"), 200, "event_id").select("event_id")


@query("SELECT lower(event_type) AS name, max(event_id) AS event_id FROM events GROUP BY lower(event_type)")
def saved_latest(spark, sf):
    e = _t(spark, sf, "events").withColumn("name", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return analytics.latest_by_name(e, "name", "event_id").select(F.lower("name").alias("name"), "event_id")


@query("SELECT user_id, max(ts) AS last_opened_at, count(*) AS open_count FROM events WHERE event_type = 'view' GROUP BY user_id")
def activity_upsert(spark, sf):
    return analytics.activity(_t(spark, sf, "events").where("event_type = 'view'"), "user_id")


@query("SELECT doc_id FROM documents d LEFT JOIN (SELECT user_id, max(ts) AS opened FROM events WHERE event_type = 'view' GROUP BY user_id) e ON e.user_id = d.doc_id ORDER BY opened DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id LIMIT 150")
def recent_documents(spark, sf):
    opened = analytics.activity(_t(spark, sf, "events").where("event_type = 'view'"), "user_id").withColumnRenamed("user_id", "doc_id")
    return analytics.recent_documents(_docs(spark, sf).withColumn("mtime", F.col("n_chars")), opened, 150).select("doc_id")


@query("SELECT DISTINCT d.doc_id, d.lang FROM documents d JOIN events e ON e.user_id = d.doc_id AND e.event_type = 'purchase'")
def bookmarks_join(spark, sf):
    marks = _t(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").alias("created_at"))
    return analytics.bookmarked(_docs(spark, sf), marks).select("doc_id", "lang")


_HEALTH = """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS passages, (SELECT count(*) FROM embeddings) AS vectors,
(SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS orphan_passages,
(SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)) AS without_passages,
(SELECT count(*) FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE e.vec_id = l.doc_id)) AS orphan_vectors,
(SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.doc_id)) AS missing_vectors"""


@query(_HEALTH)
def health_counts(spark, sf):
    d = _docs(spark, sf)
    p = _t(spark, sf, "labels").select("doc_id", F.lit(0).alias("seq"))
    v = _vectors(spark, sf).select("doc_id", F.lit(0).alias("seq"))
    return analytics.health(d, p, d, v).select("documents", "passages", "vectors", "orphan_passages", "without_passages", "orphan_vectors", "missing_vectors")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def integrity_orphans(spark, sf):
    return analytics.orphans(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), _t(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("vec_id"))


@query("SELECT count(*) AS documents, sum(n)::BIGINT AS passages, count(CASE WHEN n > 1 THEN 1 END) AS split_documents FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def passage_census(spark, sf):
    c = _t(spark, sf, "conversations")
    return analytics.passage_census(c.withColumnRenamed("conv_id", "doc_id"))


@query("SELECT count(*) AS long_notes FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) > 200")
def long_notes_census(spark, sf):
    return analytics.long_documents(_docs(spark, sf))


@query()
def split_passages_rows(spark, sf):
    from ..functions.passages import with_passages

    return with_passages(_texts(spark, sf), dict(DEFAULT)).select("doc_id", "seq", "text")


@query("SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM (SELECT left(md5(doc_id::VARCHAR), 3) AS b, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS d FROM documents GROUP BY 1)")
def id_digest(spark, sf):
    return analytics.id_digest(_docs(spark, sf))


@query("SELECT doc_id, left(text, 200000) AS body, length(text) > 200000 AS truncated FROM documents")
def document_view(spark, sf):
    return analytics.document_view(_docs(spark, sf)).select("doc_id", "body", "truncated")


# -- incremental changes -----------------------------------------------------------------------

_NEW = "SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 13 <> 0"


def _current(spark, sf):
    d = _docs(spark, sf).where("doc_id % 13 <> 0")
    body = F.coalesce("body", F.lit(""))
    return d.select(F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("doc_id"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat(body, F.lit("!"))).otherwise(body), 256).alias("content_hash"))


def _stored(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("content_hash"))


_OLD = "SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents"
_DIFF = f"""WITH n AS ({_NEW}), o AS ({_OLD}),
c AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'stale' WHEN n.h <> o.h THEN 'updated' ELSE 'unchanged' END AS change FROM n FULL JOIN o ON n.doc_id = o.doc_id)"""


@query(
    """WITH i AS (SELECT DISTINCT item_id AS doc_id FROM benchmark),
o AS (SELECT a.doc_id, b.doc_id AS other, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS r FROM documents a JOIN i USING (doc_id) JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id)
SELECT a.doc_id, left(a.text, 200000) AS body, length(a.text) > 200000 AS truncated, coalesce(string_agg(other::VARCHAR, ',' ORDER BY other) FILTER (r <= 20), '') AS duplicates, count(other) AS n_duplicates
FROM documents a JOIN i USING (doc_id) LEFT JOIN o USING (doc_id) GROUP BY a.doc_id, a.text"""
)
def document_view_duplicates(spark, sf):
    d = _docs(spark, sf).withColumn("content_hash", F.sha2("body", 256))
    shown = analytics.document_view(d, ids=_t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")))
    return shown.select("doc_id", "body", "truncated", F.coalesce(F.array_join("duplicates", ","), F.lit("")).alias("duplicates"), "n_duplicates")


@query(f"{_DIFF} SELECT * FROM c")
def ingest_diff(spark, sf):
    return changes.classify(_current(spark, sf), _stored(spark, sf))


@query(f"{_DIFF}, a AS (SELECT n.h, min(n.doc_id) AS new_id FROM n JOIN c ON c.doc_id = n.doc_id AND c.change = 'added' GROUP BY n.h) SELECT o.doc_id AS old_id, new_id FROM o JOIN c ON c.doc_id = o.doc_id AND c.change = 'stale' JOIN a ON a.h = o.h")
def rename_detection(spark, sf):
    diff = changes.classify(_current(spark, sf), _stored(spark, sf))
    added = _current(spark, sf).join(diff.where("change = 'added'"), "doc_id", "left_semi")
    return changes.renames(added, _stored(spark, sf).join(diff.where("change = 'stale'"), "doc_id", "left_semi"))


@query(f"{_DIFF} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE change = 'stale')")
def prune_stale(spark, sf):
    gone = changes.classify(_current(spark, sf), _stored(spark, sf)).where("change = 'stale'")
    return changes.remove(_docs(spark, sf), gone).select("doc_id")


@query(f"WITH n AS ({_NEW}), o AS ({_OLD}) SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.h, o.h) AS content_hash FROM n FULL JOIN o ON n.doc_id = o.doc_id")
def upsert_documents(spark, sf):
    return changes.upsert(_stored(spark, sf), _current(spark, sf))


@query(
    f"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN coalesce(text, '') || ' revised edition' ELSE coalesce(text, '') END AS body, CASE WHEN lang = 'de' THEN 'revised' ELSE source END AS title
  FROM documents WHERE lang IS DISTINCT FROM 'fr' OR n_chars >= 1000),
t AS (SELECT doc_id, title, body, regexp_extract_all(lower(coalesce(title, '')), '{CLASS}') || regexp_extract_all(lower(body), '{CLASS}') AS ts FROM d)
SELECT doc_id::VARCHAR AS doc_id, coalesce(title, '') AS title, md5(body) AS body_md5, len(ts)::BIGINT AS n_tokens, len(list_distinct(ts))::BIGINT AS n_terms FROM t"""
)
def segmented_upsert(spark, sf):
    """Documents inserted, then those of one language revised and short ones of another removed: three segments and two burials, read as one table."""
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), "lang", "n_chars")
    col = Collection.create(spark, f"{shared_folder(spark)}/tessera/segments-{uuid.uuid4().hex}", chunking="off", tokenizer="simple")
    col.add_documents(docs)
    col.add_documents(docs.where("lang = 'de'").withColumns({"title": F.lit("revised"), "body": F.concat("body", F.lit(" revised edition"))}))
    col.remove_documents(docs.where("lang = 'fr' and n_chars < 1000").select("doc_id"))
    terms = col.postings().per_document().select("doc_id", "n_tokens", "n_terms")
    none = F.lit(0).cast("long")
    shown = col.table("documents").select("doc_id", "title", F.md5("body").alias("body_md5"))  # the join moves no texts
    return shown.join(terms, "doc_id", "left").select("doc_id", "title", "body_md5", F.coalesce("n_tokens", none).alias("n_tokens"), F.coalesce("n_terms", none).alias("n_terms"))


@query(
    """WITH a AS (SELECT doc_id, n_chars, hash_ FROM (SELECT doc_id, n_chars, md5(coalesce(text, '')) AS hash_ FROM documents)),
d AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n_chars, CASE WHEN doc_id % 8 = 0 THEN 'x' ELSE hash_ END AS hash_ FROM a WHERE doc_id % 9 <> 0)
SELECT coalesce(a.doc_id, d.doc_id)::VARCHAR AS path, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'deleted' WHEN a.n_chars = d.n_chars OR a.hash_ = d.hash_ THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN d ON a.doc_id = d.doc_id"""
)
def scan_changes(spark, sf):
    stored = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.lit(1.0).alias("mtime"), F.col("n_chars").alias("size"), F.md5(F.coalesce("body", F.lit(""))).alias("content_hash"), "doc_id")
    disk = stored.where("doc_id % 9 <> 0").withColumns({"size": F.col("size") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0), "content_hash": F.when(F.col("doc_id") % 8 == 0, "x").otherwise(F.col("content_hash"))})
    return changes.scan_changes(disk, stored)


@query(
    """WITH p AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT *, lag(n) OVER w AS before, lag(1) OVER w AS had FROM p WINDOW w AS (PARTITION BY user_id ORDER BY day)),
r AS (SELECT *, sum(CASE WHEN had IS NOT NULL AND n <> before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS run FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY day) AS held FROM r)
SELECT user_id, day::DATE AS day, n FROM h WHERE run > 0 AND held = 2"""
)
def snapshot_diff_debounce(spark, sf):
    polls = _t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return changes.stable_polls(polls, "user_id", "day", F.col("n")).select("user_id", "day", "n")


@query("SELECT count(CASE WHEN a.doc_id IS NULL THEN 1 END) AS new, count(CASE WHEN a.n <> b.n THEN 1 END) AS changed, count(CASE WHEN b.doc_id IS NULL THEN 1 END) AS deleted FROM (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 6 <> 0) a FULL JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n FROM documents WHERE doc_id % 10 <> 0) b ON a.doc_id = b.doc_id")
def snapshot_diff(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("path"), F.lit(1).alias("mtime_ns"), F.col("n_chars").alias("size"))
    after = d.where("path % 10 <> 0").withColumn("size", F.col("size") + F.when(F.col("path") % 7 == 0, 1).otherwise(0))
    return changes.diff_snapshots(d.where("path % 6 <> 0"), after)


# -- evaluation -------------------------------------------------------------------------------------

_RUN = "SELECT (doc_id % 20)::VARCHAR AS qid, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY length(coalesce(text, '')) DESC, doc_id) AS rank FROM documents"
_QRELS = "SELECT (doc_id % 20)::VARCHAR AS qid, doc_id, (quality + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::INT AS rel FROM labels"


def _run(spark, sf):
    d = _docs(spark, sf).select((F.col("doc_id") % 20).cast("string").alias("qid"), "doc_id", F.length(F.coalesce("body", F.lit(""))).alias("n"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "doc_id")))


def _qrels(spark, sf):
    return _t(spark, sf, "labels").select((F.col("doc_id") % 20).cast("string").alias("qid"), "doc_id", (F.col("quality") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("int").alias("rel"))


@query(
    f"""WITH run AS ({_RUN}), rels AS ({_QRELS}), good AS (SELECT * FROM rels WHERE rel > 0),
i AS (SELECT qid, sum(CASE WHEN r <= 10 THEN rel / log2(r + 1) END) AS idcg, count(*) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS r FROM good) GROUP BY qid),
h AS (SELECT run.qid, run.rank, rel, row_number() OVER (PARTITION BY run.qid ORDER BY run.rank) AS found FROM run JOIN good ON good.qid = run.qid AND good.doc_id = run.doc_id WHERE run.rank <= 10),
g AS (SELECT qid, sum(rel / log2(rank + 1)) AS dcg, sum(found / rank::DOUBLE) AS ap, min(rank) AS first, count(*) AS n FROM h GROUP BY qid)
SELECT qid, round(coalesce(dcg / idcg, 0), 9) AS ndcg, round(coalesce(ap / n_rel, 0), 9) AS ap, round(coalesce(1.0::DOUBLE / first, 0), 9) AS rr, round(coalesce(n / 10.0::DOUBLE, 0), 9) AS precision FROM (SELECT DISTINCT qid FROM rels) LEFT JOIN i USING (qid) LEFT JOIN g USING (qid)"""
)
def ir_metrics(spark, sf):
    per = metrics.per_query(_run(spark, sf), _qrels(spark, sf))
    return per.select("qid", *[F.round(c, 9).alias(c) for c in ("ndcg", "ap", "rr", "precision")])


@query(
    f"""WITH run AS ({_RUN}), gold AS (SELECT qid, doc_id FROM ({_QRELS}) WHERE rel = 2 AND qid <> '3' UNION ALL SELECT '3', NULL),
f AS (SELECT gold.qid, min(rank) AS rank FROM gold LEFT JOIN run ON run.qid = gold.qid AND run.doc_id = gold.doc_id WHERE gold.doc_id IS NOT NULL GROUP BY gold.qid)
SELECT round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 9) AS hit, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr, 0.0::DOUBLE AS no_answer FROM f"""
)
def smoke_metrics(spark, sf):
    gold = _qrels(spark, sf).where("rel = 2 and qid <> '3'").select("qid", "doc_id").unionByName(spark.createDataFrame([("3", None)], "qid string, doc_id long"))
    out = metrics.smoke(_run(spark, sf).withColumn("abstained", F.lit(False)), gold)
    return out.select(F.round("hit", 9).alias("hit"), F.round("mrr", 9).alias("mrr"), "no_answer")


@query("SELECT list_sort(list(value))[(round_even((count(*) - 1) * 0.95, 0))::INT + 1] AS value FROM events WHERE value IS NOT NULL")
def latency_percentile(spark, sf):
    return metrics.percentile(_t(spark, sf, "events").where("value is not null"), "value", 0.95)


# -- text functions (no SQL) ---------------------------------------------------------------------


@query()
def front_matter_parse(spark, sf):
    text = F.concat(F.lit("---\ntitle: "), "source", F.lit("\ntags: ["), "lang", F.lit(", x]\n---\n"), F.coalesce("body", F.lit("")))

    @F.pandas_udf("struct<title: string, tags: array<string>, body: string>")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([front_matter(t) for t in s], columns=["title", "tags", "body"])

    return _docs(spark, sf).select("doc_id", parse(text).alias("p")).select("doc_id", "p.*")


@query()
def highlight_segments(spark, sf):
    @F.pandas_udf("array<struct<text: string, highlight: boolean>>")
    def light(bodies: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([segments_with_terms(best_passage(b, q), q) for b, q in zip(bodies, asked)])

    asked = spark.createDataFrame(QUERY_SET, "qid string, query string")
    hits = _lex(spark, sf).select("qid", "doc_id").join(asked, "qid")  # K rows a query, so the texts stay where they are
    return _docs(spark, sf).join(F.broadcast(hits), "doc_id").select("qid", "doc_id", light("body", "query").alias("segments"))


@query()
def passage_word_counts(spark, sf):
    @F.pandas_udf("int")
    def n(b: pd.Series) -> pd.Series:
        return b.map(lambda t: count_words(t)).astype("int32")

    @F.pandas_udf("int")
    def k(b: pd.Series) -> pd.Series:
        return b.map(lambda t: len(split_passages(t, dict(DEFAULT)))).astype("int32")

    return _texts(spark, sf).select("doc_id", n("body").alias("words"), k("body").alias("passages"))


# -- extensions over the event tables (not part of the search engine proper) ------------------------


@query("SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    from ..streaming.watch import tumbling

    return tumbling(_t(spark, sf, "events")).select("event_type", F.col("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    """WITH l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 minute THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session"""
)
def events_sessions(spark, sf):
    from ..streaming.watch import session_windows

    return session_windows(_t(spark, sf, "events")).select("user_id", F.col("session_window.start").alias("start"), "n", F.round("total", 4).alias("total"))
