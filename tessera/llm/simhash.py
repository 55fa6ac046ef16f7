"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits. The vector of the
segments' bit counts embeds the Hamming cube into a grid on which Manhattan
distance never exceeds Hamming distance, so two fingerprints within k bits are
within Manhattan distance k. Their halves (16 dimensions each) share the
distance, so in one half it is at most k // 2 = 2. Every fingerprint enters the
grid cells within distance 1 of its own in each half; two grid points at
distance 2 or less have a cell within 1 of both, hence every true pair meets.
Whatever meets is verified exactly by XOR and bit count. Only a spanning forest
of a cell's links leaves a task, never all pairs of a group.

Everything works on *distinct* fingerprints, so exact copies cost nothing, and
a cell beyond ``CELL_LIMIT`` fingerprints is dealt out in pairs of blocks.

Defined cases: a null or blank text has fingerprint zero and links like any
other; repeated rows and ids stay one row each; ties need no rule (components
are sets); an empty table gives an empty result; extra columns are ignored; a
null id keeps its row and is never a component's id unless all ids are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell_runs, materialise, partitions
from .graph import connected_components

SEED = 42
CELL_LIMIT = 16384
BLOCK = 2048


def fingerprint(text: str | None, words: int = 4, chunk: int = 1 << 15) -> int:
    """64-bit SimHash of word shingles; whole text, memory bounded by ``chunk`` shingles."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(joined[s:e], SEED) for s, e in zip(starts[i : i + chunk].tolist(), ends[i : i + chunk].tolist())], "<u8") for i in range(0, len(starts), chunk))


def majority(parts) -> int:
    """The fingerprint of hashes that come in arrays: the bits that over half of them have."""
    counts, n = np.zeros(64, np.int64), 0
    for part in parts:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([(id_col, pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for x in batches:
            fp = np.fromiter((fingerprint(t, words) for t in x.column(1).to_pylist()), np.uint64, x.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fp)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, fp long")


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells within Manhattan distance 1, of both halves: (row index, cell)."""
    rows, keys = [], []
    n = np.arange(len(fp))
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        own = (x - ((x >> np.uint64(1)) & np.uint64(0x55555555))).astype(np.int64)  # sixteen counts of 0 to 2, two bits each
        tag = np.int64(half) << 32
        rows.append(n)
        keys.append(own | tag)
        for i in range(16):
            count, unit = (own >> (2 * i)) & 3, np.int64(1) << (2 * i)
            for more, step in ((count < 2, unit), (count > 0, -unit)):
                rows.append(n[more])
                keys.append((own[more] + step) | tag)
    return np.concatenate(rows), np.concatenate(keys)


def forest(x: np.ndarray, y: np.ndarray | None, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of the blocks x and y (or x with itself) thinned to edges that keep its components."""
    own = y is None
    y = x if own else y
    near = np.bitwise_count(x[:, None] ^ y[None, :]) <= bits
    if own:
        np.fill_diagonal(near, False)
    label, big = np.arange(len(x)), len(x) + len(y)
    if not near.any():
        return []
    if not own:  # bipartite: label the columns by the least row they touch, rows by the least column label
        while True:
            col = np.where(near, label[:, None], big).min(0)
            new = np.minimum(label, np.where(near, col[None, :], big).min(1))
            if (new == label).all():
                break
            label = new
        r, c = near.any(1), near.any(0)
        return [(x[r], x[label[r]]), (y[c], x[col[c]])]
    while True:
        new = np.minimum(label, np.where(near, label[None, :], big).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(x))
    return [(x[moved], x[label[moved]])]


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) with the same components as all links have."""
    if not 0 <= bits <= 5:
        raise ValueError("bits must be between 0 and 5: the grid enters cells within distance 1 of each half")
    spark = distinct.sparkSession
    pair = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])

    def embed(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                rows, keys = cells(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], schema=pair)

    kind = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def out(k, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k, np.int32)), pa.array(a.astype(np.uint64, copy=False).view(np.int64)), pa.array(b.astype(np.uint64, copy=False).view(np.int64))], schema=kind)

    def join(batches):
        for (c, f), whole in cell_runs(batches, CELL_LIMIT):
            f = f.view(np.uint64)
            if not whole:
                yield out(1, c.view(np.uint64), f)
                continue
            start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[start, len(c)])
            small = np.repeat(size <= 48, size)
            sc, sf = c[small], f[small]
            for d in range(1, int(size[size <= 48].max(initial=0))):
                same = np.flatnonzero(sc[d:] == sc[:-d])
                if not len(same):
                    break
                near = same[np.bitwise_count(sf[same] ^ sf[same + d]) <= bits]
                if len(near):
                    e = np.unique(np.stack([sf[near], sf[near + d]], 1), axis=0)
                    yield out(0, e[:, 0], e[:, 1])
            for s, n in zip(start[size > 48].tolist(), size[size > 48].tolist()):
                x = f[s : s + n]
                if n > CELL_LIMIT:
                    yield out(1, np.full(n, c[s]).view(np.uint64), x)
                    continue
                for i in range(0, n, BLOCK):
                    for j in range(i, n, BLOCK):
                        for a, b in forest(x[i : i + BLOCK], None if i == j else x[j : j + BLOCK], bits):
                            yield out(0, a, b)

    n = max(partitions(spark), 12)
    met = distinct.select("fp").mapInArrow(embed, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(join, "kind int, a long, b long")
    met = materialise(met, "simhash-links")
    edges = met.where("kind = 0").select("a", "b")
    hot = met.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("fp"))
    if hot.limit(1).count():
        edges = edges.unionByName(_hot_links(hot, bits))
    return edges


def _hot_links(hot: DataFrame, bits: int) -> DataFrame:
    """Cells with many fingerprints: every pair of blocks is a task of its own."""
    many = materialise(hot.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "simhash-hot")
    dealt = (
        hot.join(many, "cell")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        fp, own = t.column("fp").to_numpy().view(np.uint64), t.column("own").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x, y = fp[own == i], None if i == j else fp[own == j]
        got = forest(x, y, bits) if len(x) and (y is None or len(y)) else []
        a, b = (np.concatenate([g[k] for g in got]) if got else np.empty(0, np.uint64) for k in (0, 1))
        return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    return dealt.groupBy("cell", "i", "j").applyInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): one row per row of ``docs``."""
    fps = materialise(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    ids = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("low")), "simhash-distinct")
    comp = connected_components(links(ids, bits))
    of = ids.join(comp, ids["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = materialise(of.join(least, "root").select("fp", "component_id"), "simhash-class")
    return fps.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
