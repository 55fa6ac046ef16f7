"""Interaction of document filters, by direct replay of every order.

Every document has one bit a filter that it fails. These flags are crossed with
the 120 orders of the five filters (a broadcast table of 120 rows), the first
failing step follows from the orders' growing masks, five rows a pair of
document and order are exploded, and conditional sums by (part, order, step)
are combined on the map side: what is shuffled is 600 rows a part and task,
however many documents there are.

Filter E (the text is that of a document with a smaller id) needs the table as
a whole: documents are grouped by the SHA-256 digest of their texts, whose
least id is combined on the map side, and looked up by (id, digest), so a text
that a third of all documents share is no hot key of the join.

Defined cases: a null text is empty, a null part is the empty string; a
document without an id has no smaller id's text and no label; repeated ids are
documents of their own, and equal rows are no copies of each other, as neither
id is smaller; several labels of an id count as 1 if one of them is; an empty
table gives no part and hence no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, materialise

LETTERS = "ABCDE"
MIN_WORDS = 200
#: percent of distinct words, and of capitals
MIN_DISTINCT, MAX_CAPITALS = 50, 3
MARKS = re.compile(r"[#$%&*|]")
CAPITALS = bytes(range(65, 91))


def text_flags(text: str | None) -> int:
    """Bits of the filters A to D that one whole text fails."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1 | (100 * capitals > MAX_CAPITALS * len(text)) << 2 | (MARKS.search(text) is not None) << 3


def _flagged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("part", pa.string()), ("flags", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            flags = np.fromiter(map(text_flags, texts), np.int32, len(texts))
            digests = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
            ids, none = longs(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), b.column(1).cast(pa.string()), pa.array(flags), pa.array(digests, pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, part string, flags int, digest binary")


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, flags, good, toxic): one row a document, a bit for each of the five filters it fails."""
    rows = materialise(_flagged(docs, id_col, text_col, part_col), "audit-flags")
    first = materialise(rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")), "audit-first").withColumn("first", F.lit(True))
    told = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(first, ["id", "digest"], "left")
        .join(materialise(told, "audit-labels"), "id", "left")
        .select("id", "part", (F.col("flags") + F.when(copy, 16).otherwise(0)).alias("flags"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )


def _orders(spark) -> DataFrame:
    """(filter_order, m1 .. m5): the filters up to each step, as masks; 120 rows."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        masks = np.cumsum([1 << f for f in order]).tolist()
        rows.append(("".join(LETTERS[f] for f in order), *masks))
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"m{k} int" for k in range(1, 6)))


def replay(flagged: DataFrame) -> DataFrame:
    """Counts of every (part, filter_order, step), by replaying each order on each document."""
    orders = F.broadcast(_orders(flagged.sparkSession))
    steps = F.array(*(F.struct(F.lit(k).alias("step"), (F.col(f"m{k}") - (F.col(f"m{k - 1}") if k > 1 else 0)).alias("bit")) for k in range(1, 6)))
    first = sum((F.col("flags").bitwiseAND(F.col(f"m{k}")) == 0).cast("int") for k in range(1, 6)) + 1
    each = (
        flagged.crossJoin(orders)
        .select("part", "flags", "good", "toxic", "filter_order", first.alias("first"), F.explode(steps).alias("s"))
        .select("part", "filter_order", "s.step", "s.bit", "flags", "good", "toxic", "first")
    )
    fails, removed = F.expr("flags & bit <> 0"), F.expr("first = step")
    count = lambda what: F.sum(what.cast("long"))
    counts = each.groupBy("part", "filter_order", "step").agg(
        count(F.expr("first > step")).alias("kept"), count(removed).alias("removed"), count(fails & F.expr("first < step")).alias("redundant"),
        count(F.expr("flags = bit")).alias("unique_fails"), count(removed & F.col("good")).alias("good_lost"), count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    counts = materialise(counts, "audit-counts")
    letter = F.expr("substring(filter_order, step, 1)")
    share = counts.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return counts.withColumn("letter", letter).join(share, ["part", "letter"]).select(*counts.columns, "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps, removes and would have removed."""
    flagged = materialise(document_flags(docs, labels, id_col, text_col, part_col), "audit-documents")
    return replay(flagged)


def oracle() -> str:
    """The same counts as DuckDB SQL."""
    blank = "[^\\x20\\x09-\\x0D]+"
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(LETTERS))
    return rf"""
with recursive letter(c, bit) as (values {letters}),
grow(o, step, bit, mask) as (
  select c, 1, bit, bit from letter
  union all
  select o || c, step + 1, l.bit, mask | l.bit from grow, letter l where (mask & l.bit) = 0
),
orders as (select o from grow where step = 5),
plan as (
  select o, k as step, substring(o, k, 1) as c, l.bit, (select bit_or(x.bit) from letter x where strpos(substring(o, 1, k), x.c) > 0) as mask
  from orders, range(1, 6) r(k), letter l where l.c = substring(o, k, 1)
),
doc as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
word as (select *, regexp_extract_all(t, '{blank}') as w, min(doc_id) over (partition by t) as least from doc),
flag as (
  select doc_id, part,
    (len(w) < {MIN_WORDS})::int + 2 * (100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as flags
  from word
),
told as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
known as (select part, flags, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from flag left join told using (doc_id)),
counts as (
  select part, o as filter_order, step, c,
    sum(((flags & mask) = 0)::int) as kept,
    sum(((flags & bit) <> 0 and (flags & (mask - bit)) = 0)::int) as removed,
    sum(((flags & bit) <> 0 and (flags & (mask - bit)) <> 0)::int) as redundant,
    sum((flags = bit)::int) as unique_fails,
    sum(good * ((flags & bit) <> 0 and (flags & (mask - bit)) = 0)::int) as good_lost,
    sum(toxic * ((flags & bit) <> 0 and (flags & (mask - bit)) = 0)::int) as toxic_lost
  from known, plan group by all
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, c))::bigint as shapley
from counts"""
