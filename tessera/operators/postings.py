"""Stored postings: blocks of bounded size, files by ranges of terms, and top-k search that skips blocks.

A term's postings are dealt by a hash of the document into a power of two of
slots, so that a block (one row) holds ``BLOCK`` postings on average however
common the term is. Blocks are written sorted by (term, slot) and cut into files
by ranges of it: a rare term lies in one file, a common one in as many as it
needs, and no task or file grows with a term. A small table beside them says
which file holds which terms, so a search opens the files of its own terms.

A block says how often its term occurs in a document at most and how short its
shortest document is, which bounds what it can add to a BM25 score under any
corpus statistics. Slots are nested (one of 4 slots holds two of 8), so the
blocks of all terms of a query line up in the cells of its finest term, and the
sum of their bounds is a bound for every document of a cell. A cell below a
score that k documents are known to reach is skipped: its documents can't be
among the first k, and leaving them out changes no other document's score.

Postings of several segments lie side by side; ``buried`` documents of earlier
segments are left out wherever postings are read. The bounds stay valid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import partial, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import delete, small

K1, B = 1.2, 0.75
#: postings of a block on average, at most
BLOCK = 128
#: postings of a file, about
FILE_POSTINGS = 1 << 21
#: bytes of a row group: what a look-up of one term reads at least
GROUP_BYTES = 4 << 20
#: files whose ranges of terms the driver keeps; beyond, each look-up asks the table of ranges
KEPT_RANGES = 50_000
#: postings of a query from which on blocks are skipped; below, finding out costs more than reading them
SKIP_FROM = 1 << 19

_ranges: dict[str, list[tuple[str, str, str]]] = {}


def schema(doc_type: T.DataType) -> T.StructType:
    """A block: the postings of one term in one slot."""
    one = [("term", T.StringType()), ("slots", T.IntegerType()), ("slot", T.IntegerType()), ("n", T.LongType()), ("max_tf", T.IntegerType()), ("min_len", T.LongType())]
    many = [("docs", doc_type), ("tfs", T.IntegerType()), ("lens", T.LongType()), ("positions", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField(n, t) for n, t in one] + [T.StructField(n, T.ArrayType(t)) for n, t in many] + [T.StructField("segment", T.LongType())])


def to_blocks(postings: DataFrame, common: DataFrame, files: int, segment: int = 0) -> DataFrame:
    """Blocks, sorted by (term, slot) and dealt over ``files`` by ranges of it, of stored postings (term, doc_id, positions, len).

    ``common``: (term, n) of the terms with more than ``BLOCK``. Postings are
    shuffled once, to the file they go to, and sorted there; a block is then a
    run of rows.
    """
    slots = F.expr(f"shiftleft(1, cast(ceil(log2(coalesce(n, {BLOCK}) / {BLOCK})) as int))").alias("slots")
    dealt = postings.join(common, "term", "left").select("term", slots, "doc_id", "len", "positions")
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int"))
    placed = dealt.repartitionByRange(files, "term", "slot").sortWithinPartitions("term", "slot", "doc_id")
    return placed.mapInArrow(partial(_runs, segment), schema(postings.schema["doc_id"].dataType))


def _runs(segment: int, batches):
    """A block of each run of rows (term, slots, doc_id, len, positions, slot) with one term and slot; the last may go on in the next batch."""

    def made(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        column = {c: t.column(c).chunk(0) for c in t.column_names}
        tf, size = pc.list_value_length(column["positions"]), column["len"]
        ends = pa.array(np.r_[first, t.num_rows], pa.int32())
        n = np.diff(np.r_[first, t.num_rows])
        one = [column[c].take(pa.array(first)) for c in ("term", "slots", "slot")]
        least = [np.maximum.reduceat(tf.to_numpy(), first), np.minimum.reduceat(size.to_numpy(zero_copy_only=False), first)]
        many = [pa.ListArray.from_arrays(ends, x) for x in (column["doc_id"], tf, size, column["positions"])]
        out = [*one, pa.array(n, pa.int64()), pa.array(least[0], pa.int32()), pa.array(least[1], pa.int64()), *many, pa.array(np.full(len(n), segment, np.int64))]
        return pa.RecordBatch.from_arrays(out, names=["term", "slots", "slot", "n", "max_tf", "min_len", "docs", "tfs", "lens", "positions", "segment"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        term, slot = t.column("term").combine_chunks(), t.column("slot").to_numpy()
        new = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False) | (slot[1:] != slot[:-1])
        first = np.r_[0, np.flatnonzero(new) + 1]
        if len(first) > 1:
            yield made(t.slice(0, first[-1]), first[:-1])
        held = t.slice(first[-1])
    if held is not None:
        yield made(held, np.zeros(1, np.int64))


def write(postings: DataFrame, folder: str, segment: int = 0, file_postings: int = FILE_POSTINGS) -> None:
    """Store postings (term, doc_id, positions, len) as a segment: ``blocks``, and last ``ranges`` (file, first, last).

    Postings without a document are left out. They are staged, and so are the
    counts of common terms: the join of the two then reads scans alone, so its
    rows of a very common term may be split over tasks where it isn't broadcast.
    """
    spark = postings.sparkSession
    postings.where("doc_id is not null").select("term", "doc_id", "positions", "len").write.parquet(f"{folder}/staged")
    staged = spark.read.parquet(f"{folder}/staged")
    staged.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).write.parquet(f"{folder}/common")
    common = spark.read.schema("term string, n long").parquet(f"{folder}/common")
    files = max(1, -(-staged.count() // file_postings))
    blocks = to_blocks(staged, small(common, common.count()), files, segment)
    blocks.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/blocks")
    delete(spark, f"{folder}/staged")
    delete(spark, f"{folder}/common")
    written = spark.read.schema(blocks.schema).parquet(f"{folder}/blocks")
    ranges = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("term").alias("first"), F.max("term").alias("last"))
    ranges.coalesce(1).write.parquet(f"{folder}/ranges")


@dataclass
class Postings:
    """The postings of some segments (their folders), without buried documents (doc_id, since)."""

    spark: SparkSession
    folders: list[str]
    doc_type: T.DataType = field(default_factory=T.StringType)
    buried: DataFrame | None = None

    def _files(self, folder: str, terms: list[str]) -> list[str]:
        held = _ranges.get(folder)
        if held is None:
            table = self.spark.read.schema("file string, first string, last string").parquet(f"{folder}/ranges")
            found = [tuple(r) for r in table.limit(KEPT_RANGES + 1).collect()]
            if len(found) > KEPT_RANGES:
                met = reduce(or_, ((F.col("first") <= t) & (F.col("last") >= t) for t in terms))
                return [f"{folder}/blocks/{r.file}" for r in table.where(met).select("file").collect()]  # the files of these terms
            held = _ranges[folder] = found
        return [f"{folder}/blocks/{name}" for name, first, last in held if any(first <= t <= last for t in terms)]

    def _read(self, paths: list[str]) -> DataFrame:
        kind = schema(self.doc_type)
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """All blocks, or those of some terms, from the files that hold them."""
        if terms is None:
            return self._read([f"{f}/blocks" for f in self.folders])
        return self._read([p for f in self.folders for p in self._files(f, terms)] if terms else []).where(F.col("term").isin(terms))

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with doc_id and segment) without those of buried documents."""
        if self.buried is None:
            return rows
        return rows.join(self.buried, "doc_id", "left").where("since is null or segment >= since").drop("since")

    def each(self, blocks: DataFrame, *columns: str) -> DataFrame:
        """One row a posting: doc_id, tf and len, and positions if they are asked for among ``columns``; others are the blocks' own."""
        arrays = [F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"), F.col("lens").alias("len"), *([F.col("positions")] if "positions" in columns else [])]
        own = [c for c in columns if c != "positions"]
        return self.live(blocks.select(*own, "segment", F.inline(F.arrays_zip(*arrays))))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, doc_id, positions, len)."""
        return self.each(self.blocks(terms), "term", "positions").select("term", "doc_id", "positions", "len")

    def per_document(self) -> DataFrame:
        """(doc_id, n_tokens, n_terms) of documents with any; buried ones leave as sums, before which no posting is joined."""
        each = self.blocks().select("segment", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"))))
        sums = each.groupBy("doc_id", "segment").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))
        return self.live(sums).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_terms").alias("n_terms"))

    def document_counts(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each of some terms occurs: from the blocks' counts if nothing is buried."""
        blocks = self.blocks(terms)
        counts = blocks.groupBy("term").agg(F.sum("n")) if self.buried is None else self.live(blocks.select("term", "segment", F.explode("docs").alias("doc_id"))).groupBy("term").agg(F.count("*"))
        return dict(counts.collect())


def impact(idf: Column, tf: Column, size: Column, avgdl: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avgdl))


def _table(spark: SparkSession, weights: list[tuple]) -> tuple[list[str], DataFrame]:
    """The terms of (qid, phrase, term, n_phrases, idf), and those rows, a few for each query, to be broadcast."""
    return sorted({w[2] for w in weights}), F.broadcast(spark.createDataFrame(weights, "qid string, phrase int, term string, n_phrases int, idf double"))


def needed(store: Postings, weights: list[tuple], counts: dict[str, int], k: int, match: str, avgdl: float, slack: float = 0.0) -> DataFrame:
    """(term, segment, slot): the blocks that can hold one of the first k documents of a query.

    ``weights``: rows (qid, phrase, term, n_phrases, idf); ``counts``: in how
    many documents each term is. Cells are those of the commonest term. A term
    in fewer documents than there are cells is placed by its documents, others
    by their blocks' bounds. A query's known score is the k-th best of the
    documents in the blocks with the highest bounds, as far as those blocks
    tell; ``slack`` allows for rounding.
    """
    terms, weights = _table(store.spark, weights)
    cells = 1 << max(0, math.ceil(math.log2(max(counts[t] for t in terms) / BLOCK)) if max(counts[t] for t in terms) > BLOCK else 0)
    rare = [t for t in terms if counts[t] < cells]
    own = ["qid", "phrase", "n_phrases", "term", "segment", "slot"]
    bound = impact(F.col("idf"), F.col("max_tf"), F.col("min_len"), avgdl)
    met = store.blocks(terms).select("term", "segment", "slots", "slot", "max_tf", "min_len").join(weights, "term").withColumn("bound", bound)
    # slots are nested: a block of fewer slots than there are cells covers several of them, one of more lies in a part of one
    spread = F.when(F.col("slots") < cells, F.expr(f"sequence(slot, {cells - 1}, slots)")).otherwise(F.array(F.expr(f"slot % {cells}")))
    placed = met.where(~F.col("term").isin(rare)).select(*own, "bound", F.explode(spread).alias("cell"))
    if rare:
        each = store.blocks(rare).select("term", "segment", "slot", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"), F.col("lens").alias("len")))).join(weights, "term")
        cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("cell")
        placed = placed.unionByName(each.select(*own, impact(F.col("idf"), F.col("tf"), F.col("len"), avgdl).alias("bound"), cell))
    per = placed.groupBy("qid", "segment", "cell", "phrase", "n_phrases").agg(F.max("bound").alias("bound"))
    seen = per.groupBy("qid", "segment", "cell", "n_phrases").agg(F.sum("bound").alias("most"), (F.count("*") == F.col("n_phrases")).alias("whole"))
    if match == "all":
        seen = seen.where("whole")
    else:
        best = Window.partitionBy("qid", "phrase").orderBy(F.desc("bound"), "segment", "slot")
        first = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 + 2 * k // BLOCK).select("term", "segment", "slot").distinct()
        seeds = store.each(store.blocks(terms).join(first, ["term", "segment", "slot"]), "term").join(weights, "term")
        known = seeds.select("qid", "doc_id", impact(F.col("idf"), F.col("tf"), F.col("len"), avgdl).alias("s")).groupBy("qid", "doc_id").agg(F.sum("s").alias("s"))
        nth = known.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s")))).where(F.col("place") == k).select("qid", F.col("s").alias("known"))
        reach = F.col("known").isNull() | (F.col("most") >= F.col("known") * (1 - 1e-9) - slack)
        seen = seen.join(F.broadcast(nth), "qid", "left").where(reach | (F.lit(match == "auto") & F.col("whole")))  # a row for each query
    return placed.join(seen.select("qid", "segment", "cell"), ["qid", "segment", "cell"], "left_semi").select("term", "segment", "slot").distinct()


def scored(store: Postings, weights: list[tuple], counts: dict[str, int], k: int | None, match: str, avgdl: float, slack: float = 0.0, skip_from: int | None = None) -> DataFrame:
    """(qid, doc_id, n_phrases, score, matched): sums of the impacts of each query's single-word phrases.

    With ``k`` only documents that can be among the first k are sure to be
    there, if the query has ``skip_from`` postings (or ``SKIP_FROM``) or more.
    """
    terms, table = _table(store.spark, weights)
    blocks = store.blocks(terms)
    if weights and k is not None and sum(counts[w[2]] for w in weights) >= (SKIP_FROM if skip_from is None else skip_from):
        blocks = blocks.join(needed(store, weights, counts, k, match, avgdl, slack), ["term", "segment", "slot"], "left_semi")
    hits = store.each(blocks, "term").join(table, "term")
    part = impact(F.col("idf"), F.col("tf"), F.col("len"), avgdl)
    return hits.groupBy("qid", "doc_id", "n_phrases").agg(F.sum(part).alias("score"), F.count("*").cast("int").alias("matched"))
