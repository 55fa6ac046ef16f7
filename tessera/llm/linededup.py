"""Line dedup by a log-template tree.

Lines are parsed by a tree of fixed depth: token count, then the leading tokens
(tokens with digits are variable from the start); below that a line's leaf
generalises its variable fields in two steps. A token stays fixed only where
``min_docs`` line occurrences of the leaf have it at its place. A place becomes
variable, too, where ``min_docs`` occurrences of lines that agree in all other
places hold different tokens there. A line so has up to three templates, each
more general than the last: itself, that of the first step and that of both. A
generalised one counts only if at least ``similarity`` of the places after the
leading ones are fixed.

Rows of equal text are one document here: copies of a document are no lines
that recur, and all of them come out alike, for near-duplicate removal to deal
with. A template found in ``min_docs`` documents or more is recurring: its lines
are dropped from every document but the first (that of the least id), so
boilerplate goes and nothing is lost from the corpus as a whole. A line of
``long_tokens`` tokens or more goes from the second document on, unless such
lines are half of a document or more: it is a near copy then, and stays whole.
Templates depend on counts alone, not on an order of the lines: every step is
an aggregation or an equi-join on (leaf, place, token), and no leaf, template or
line is gathered in one task.

A first pass sends leaf, hash of the masked text and document of every line;
leaves with lines of ``min_docs`` documents or more are candidates. They set
bits in a bitmap of fixed size, and a second pass sends the masked texts of
lines in candidate leaves only (a false bit costs work, never results). Equal
lines are combined before the shuffle. Likewise only documents that lose a line
are shuffled at the end.

Defined cases: a null text stays null; blank lines and lines of fewer than
``min_tokens`` tokens (none by default) always stay; a line of no more than
``depth`` tokens is a leaf of its own, so such lines merge only when equal;
rows of one id and different texts are different documents; the lines of a row
without an id count for nothing and stay; an empty table gives an empty result;
extra columns pass through under any name (but a column ``n_dropped``, which
the result's replaces).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import drop, materialise

VARIABLE = "<*>"
DIGIT = re.compile(r"\d")
#: bytes of a bitmap of hashes
BITMAP = 1 << 22


def masked_tokens(line: str) -> list[str]:
    tokens = line.split()
    return [VARIABLE if DIGIT.search(w) else w for w in tokens] if DIGIT.search(line) else tokens


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 2) - (1 << 63)


def line_rows(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, long_tokens: int, bitmap: Broadcast | None = None) -> DataFrame:
    """(leaf, line, doc, text, long) of every line that can be dropped, documents and texts as numbers; given a bitmap of leaves, (leaf, line, masked) of the lines in those."""
    fields = [("leaf", pa.int64()), ("line", pa.int64()), *([("masked", pa.string())] if bitmap else [("doc", pa.int64()), ("text", pa.int64()), ("long", pa.bool_())])]
    schema = pa.schema(fields)

    def run(batches):
        bits = bitmap.value if bitmap else None
        for b in batches:
            out = []
            for d, t, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = set()
                for s in (t or "").split("\n"):
                    tokens = masked_tokens(s)
                    if len(tokens) < max(1, min_tokens):
                        continue
                    leaf = _hash(f"{len(tokens)} {' '.join(tokens[:depth])}")
                    if bits is not None and not bits[leaf >> 3 & BITMAP - 1] >> (leaf & 7) & 1:
                        continue
                    m = " ".join(tokens)
                    h = _hash(m)
                    if h not in own:
                        own.add(h)
                        out.append((leaf, h, m) if bitmap else (leaf, h, d, x, len(tokens) >= long_tokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(fields), schema)], schema=schema)

    text = F.col(f"`{text_col}`").cast("string")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash")).where("id is not null")
    return plain.mapInArrow(run, f"leaf long, line long, {'masked string' if bitmap else 'doc long, text long, long boolean'}")


def _bitmap(hashes: DataFrame) -> Broadcast:
    """Bits of the hashes (the only column) in ``BITMAP`` bytes; at most one row for each byte reaches the driver."""
    h = f"`{hashes.columns[0]}`"
    rows = hashes.select(F.expr(f"cast(shiftright({h}, 3) & {BITMAP - 1} as int)").alias("byte"), F.expr(f"shiftleft(1, cast({h} & 7 as int))").alias("bit"))
    rows = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def _templates(seen: DataFrame, depth: int, similarity: float, min_docs: int) -> DataFrame:
    """(line, template): the templates of each line of ``seen`` (leaf, line, masked, n)."""
    key = ["leaf", "place", "token"]
    tokens = F.split("masked", " ")
    places = seen.select("leaf", "line", "n", F.posexplode(tokens).alias("place", "token")).where(F.col("place") >= depth)
    common = materialise(places.where(F.col("token") != VARIABLE).groupBy(*key).agg(F.sum("n").alias("s")).where(F.col("s") >= min_docs).select(*key, F.lit(True).alias("fixed")), "lines-common")
    places = places.join(common, key, "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    code = lambda token: F.xxhash64("place", token)
    places = materialise(places.select("leaf", "line", "n", "place", "token", "fixed", code("token").alias("code"), code(F.when(F.col("fixed"), F.col("token")).otherwise(VARIABLE)).alias("first")), "lines-places")
    lines = places.groupBy("leaf", "line").agg(F.bit_xor("code").alias("whole"), F.bit_xor("first").alias("step"), F.count_if("fixed").alias("fixed"), F.count("*").alias("m"))
    lines = materialise(lines, "lines-codes")
    # what a line is but for one place: lines alike in it with different tokens there make the place variable
    context = places.where(F.col("token") != VARIABLE).select("leaf", "line", "n", "place", "token", "fixed", "first").join(lines.select("leaf", "line", "step"), ["leaf", "line"])
    context = materialise(context.select("leaf", "line", "n", "place", "token", "fixed", "first", F.expr("step ^ first").alias("rest")), "lines-contexts")
    varying = context.groupBy("leaf", "place", "rest").agg(F.min("token").alias("a"), F.max("token").alias("b"), F.sum("n").alias("s")).where((F.col("a") < F.col("b")) & (F.col("s") >= min_docs))
    varying = materialise(varying.select("leaf", "place", "rest"), "lines-varying")
    change = F.bit_xor(F.expr("first").bitwiseXOR(code(F.lit(VARIABLE)))).alias("change")
    freed = context.where("fixed").join(varying, ["leaf", "place", "rest"]).groupBy("leaf", "line").agg(change, F.count("*").alias("freed"))
    every = seen.select("leaf", "line").join(lines, ["leaf", "line"], "left").join(freed, ["leaf", "line"], "left")
    name = lambda step, code: F.xxhash64(F.lit(step), "leaf", code)
    whole = name("", F.coalesce("whole", F.lit(0).cast("long")))
    first = F.when(F.col("fixed") >= similarity * F.col("m") - 1e-9, name("*", "step"))
    second = F.when(F.col("fixed") - F.coalesce("freed", F.lit(0)) >= similarity * F.col("m") - 1e-9, name("**", F.expr("step ^ coalesce(change, 0L)")))
    out = materialise(every.select("line", F.explode(F.filter(F.array(whole, first, second), lambda x: x.isNotNull())).alias("template")), "lines-templates")
    drop(common, places, lines, context, varying)
    return out


def recurring_lines(docs: DataFrame, slim: DataFrame, depth: int = 3, similarity: float = 0.7, min_docs: int = 5, min_tokens: int = 1, long_tokens: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(line, keeper, recurring): lines (by hash) that go, the text that keeps them, and whether by their template or as long ones only.

    ``slim``: what ``line_rows`` gives.
    """
    ends = [F.min("text").alias("a"), F.max("text").alias("b")]
    first = F.min(F.struct("doc", "text")).alias("first")
    leaves = slim.groupBy("leaf").agg(F.count("*").alias("n"), *ends).where((F.col("n") >= min_docs) & (F.col("a") < F.col("b")))
    leaves = materialise(leaves.select("leaf"), "lines-leaves")
    seen = line_rows(docs, id_col, text_col, depth, min_tokens, long_tokens, _bitmap(leaves)).groupBy("leaf", "line").agg(F.min("masked").alias("masked"), F.count("*").alias("n"))
    seen = materialise(seen.join(leaves, "leaf", "left_semi"), "lines-seen")
    of = _templates(seen, depth, similarity, min_docs)
    # documents of a template: those of its lines, counted once each
    counted = slim.select("line", "doc", "text").join(of, "line").groupBy("template", "text").agg(F.min("doc").alias("doc")).groupBy("template").agg(F.count("*").alias("docs"), first)
    found = of.join(materialise(counted.where(F.col("docs") >= min_docs).select("template", "first"), "lines-recurring"), "template").select("line", "first", F.lit(True).alias("recurring"))
    twice = slim.where("long").groupBy("line").agg(*ends, first).where("a < b").select("line", "first", F.lit(False).alias("recurring"))
    out = materialise(found.unionByName(twice).groupBy("line").agg(F.min("first").alias("first"), F.max("recurring").alias("recurring")).select("line", F.col("first.text").alias("keeper"), "recurring"), "lines-drop")
    drop(seen, leaves, of)
    return out


def drop_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.7, min_docs: int = 5, min_tokens: int = 1, long_tokens: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with recurring lines taken out of the texts; adds ``n_dropped``, the number of lines taken out of each."""
    docs = docs.drop("n_dropped")
    slim = materialise(line_rows(docs, id_col, text_col, depth, min_tokens, long_tokens), "lines-slim")
    keepers = recurring_lines(docs, slim, depth, similarity, min_docs, min_tokens, long_tokens, id_col, text_col)
    hits = slim.join(keepers, "line").where("text <> keeper")
    own = lambda recurring: F.collect_set(F.when(F.col("recurring") == F.lit(recurring), F.col("line")))
    lists = materialise(hits.groupBy(F.col("text").alias("h")).agg(own(True).alias("lines"), own(False).alias("long")), "lines-lists")  # at most a text's own lines
    bitmap = _bitmap(lists.select("h"))
    drop(slim, keepers)
    # the caller's columns travel in a struct, so no name of theirs can clash
    key = F.when(F.col(f"`{id_col}`").cast("long").isNotNull(), F.xxhash64(F.col(f"`{text_col}`").cast("string"))).alias("h")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key)
    names, at = docs.columns, docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("n_dropped", IntegerType())])

    def hit(b: pa.RecordBatch) -> np.ndarray:
        known, h = np.frombuffer(bitmap.value, np.uint8), b.column(1)
        there = h.is_valid().to_numpy(zero_copy_only=False)
        h = h.fill_null(0).to_numpy()
        return there & (known[h >> 3 & BITMAP - 1] >> (h & 7).astype(np.uint8) & 1).astype(bool)

    def other(batches):
        for b in batches:
            own = b.filter(pa.array(~hit(b)))
            yield pa.RecordBatch.from_arrays([*own.column(0).flatten(), pa.array(np.zeros(own.num_rows, np.int32))], names=[*names, "n_dropped"])

    def affected(batches):
        for b in batches:
            yield b.filter(pa.array(hit(b)))

    def strip(batches):
        for b in batches:
            texts, counts = [], []
            columns = b.column(0).flatten()
            for t, gone, long in zip(columns[at].to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t is None or not (gone or long):
                    texts.append(t)
                    counts.append(0)
                    continue
                gone, long = set(gone), set(long)
                lines = [(s, len(k), _hash(" ".join(k)) if len(k) >= max(1, min_tokens) else None) for s in t.split("\n") for k in [masked_tokens(s)]]
                if 2 * sum(n for _, n, h in lines if h in long) < sum(n for _, n, _ in lines):
                    gone |= long
                kept = [s for s, _, h in lines if h not in gone]
                texts.append("\n".join(kept))
                counts.append(len(lines) - len(kept))
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], names=[*names, "n_dropped"])

    # the lists have no proven bound, so they are merged and not broadcast, with few documents as with many
    joined = rows.mapInArrow(affected, rows.schema).join(lists.hint("merge"), "h", "left").select("row", "lines", "long")
    return joined.mapInArrow(strip, schema).unionByName(rows.mapInArrow(other, schema))
