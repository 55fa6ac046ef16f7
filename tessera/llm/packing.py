"""First-fit-decreasing packing with a tournament tree, in randomised groups.

A document's ids are cut into full sequences and one rest. The pieces (a few
numbers each, no text or ids) are dealt by a salted hash into groups of about
``group_rows`` documents; every group is packed by itself, so one group is one
bounded task however large or skewed the corpus is. In a group the rests go,
longest first, into the first bin with room: a tournament tree holds the
largest free capacity below every node and finds that bin in log time.

Defined cases: a null or empty text is just the closing id; repeated rows and
ids are packed as rows of their own (rows equal in id and text are counted and
numbered, so the packing depends on the data alone, not on files or cores); a
null id is kept; ties of length go by id, text hash, number and start; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encode

PIECES = "doc_id long, key long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """Free capacities of a growing row of bins; each inner node holds the best below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """Take ``need`` from the leftmost bin that has it; return the bin."""
        tree, node = self.tree, 1
        if tree[1] < need:
            raise ValueError("no bin has room")
        while node < self.size:
            node *= 2
            if tree[node] < need:
                node += 1
        found = node - self.size
        tree[node] -= need
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) of each piece; pieces are taken longest first, equals in the given order."""
    tree = Tournament(max(1, len(lengths)), capacity)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    filled: dict[int, int] = {}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = tree.first_fit(lengths[i])
        bins[i], offsets[i] = b, filled.get(b, 0)
        filled[b] = offsets[i] + lengths[i]
    return bins, offsets


def pieces(docs: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", closing_id: int = 0) -> DataFrame:
    """Each document's ids cut into full pieces and a rest."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "key", "start", "length", "ids_crc32", "doc_tokens")])

    def run(batches):
        for b in batches:
            out = []
            for d, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = np.append(encode(t), np.uint32(closing_id)).astype("<u4")
                raw = memoryview(ids.tobytes())
                for s in range(0, len(ids), capacity):
                    e = min(s + capacity, len(ids))
                    out.append((d, r, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6, schema=schema)

    text = F.col(f"`{text_col}`").cast("string")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return plain.mapInArrow(run, PIECES)


def pack(docs: DataFrame, capacity: int = 1024, group_rows: int = 16384, seed: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity < 1 or group_rows < 1:
        raise ValueError("capacity and group_rows must be positive")
    cut = materialise(pieces(docs, capacity, id_col, text_col), "packing-pieces")
    rows = cut.where("start = 0").count()
    alike = cut.groupBy(*cut.columns).agg(F.count("*").alias("n"))
    cut = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    groups = max(1, -(-rows // group_rows))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("key", "ascending"), ("copy", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(t.column("length").to_pylist(), capacity)
        base = t.column("grp")[0].as_py() << 32
        got = [t.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        return pa.Table.from_arrays([*got, pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())], schema=schema)

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key", "copy"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(run, ", ".join(f"{f.name} long" for f in schema))
