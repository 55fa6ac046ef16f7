"""SimHash near-dedup of documents by word shingles, at an exact Jaccard similarity.

A document is the set of its five-word shingles (64-bit hashes). The first step
is that of ``simhash.py``: fingerprints of the sets meet by the segment-popcount
embedding within ``BITS`` bits, and what meets is verified by the sets' exact
similarity. That joins the large groups of near copies cheaply. It can't be the
only step: sets of similarity 0.8 lie about 10 of 64 bits apart, where the
grid's lower bound no longer tells near from far.

So a second step brings together what the fingerprints leave apart. Two sets of
similarity t or more share a shingle among the first n - ceil(t n) + 1 of each,
whatever the order, as long as it is one order for all: these prefixes are
dealt out by shingle, so every true pair meets and nothing hangs on a radius or
on chance. Shingles that are common in a sample of documents come last in the
order, so passages that many documents share hardly enter a prefix; the sample
changes the work, never the result. Pairs that the first step has joined are
not looked at again. Where two sets meet at places i and j of their orders and
nowhere before, they share at most one shingle and what follows either place:
pairs for which that is too little are left to an earlier meeting or are out.
Pairs whose bitmaps of parities (four bits a shingle) differ in more bits than
similar sets may differ in shingles are out for certain; all others are
verified on whole sets, which are cut again for their documents only.

A shingle that at most ``SMALL`` documents have in their prefixes gives all its
pairs at once. For a larger one neighbours by size are linked first; then only
pairs of documents whose components still differ are compared, dealt out in
pairs of blocks, so a large group of near copies isn't compared with itself.

Defined cases: documents with equal sets are one node (exact copies cost
nothing); a text of fewer words than a shingle is one shingle; null and blank
texts are equal to each other only; a null id keeps its row and links to
nothing; rows with one id and different texts are judged by their texts; of
rows equal in id and text one stays; an empty table gives an empty result;
extra columns pass through under any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell_runs, drop, materialise, partitions
from .graph import connected_components
from .simhash import SEED, links, majority

#: the widest radius of the grid of fingerprints
BITS = 5
SAMPLE = 16384
COMMON = 1 << 19
SMALL = 48
BLOCK = 1024
#: the fewest bits of a set's bitmap of parities
PARITY = 1024
#: pairs of sets that a worker holds at once
PAIRS = 256
#: bytes of the bitmap of documents to be cut again (a false bit costs work, never results)
BITMAP = 1 << 22


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n))


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), len(found))).view(np.int64))


def least(n: int, similarity: float) -> int:
    """The fewest shingles that a set must share with one of n to be similar."""
    return math.ceil(similarity * n - 1e-9)


def parity(found: np.ndarray) -> bytes:
    """Bits set by an odd number of shingles, a power of two of them, four for each shingle: two of them differ in no more bits than the sets in shingles."""
    bits = max(PARITY, 1 << (4 * len(found) - 1).bit_length()) if len(found) else PARITY
    return np.packbits(np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """The bitmap with ``size`` bytes that a larger one stands for."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size), axis=0)


def enough(size_a: np.ndarray, place_a: np.ndarray, size_b: np.ndarray, place_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets that first meet at these places can be similar: the larger one no larger than it may be, and enough shingles left."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    left = np.minimum(size_a - place_a, size_b - place_b)
    return (small >= similarity * large - 1e-9) & (left >= similarity / (1 + similarity) * (small + large) - 1e-6)


def _common(plain: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more sampled documents, ascending, and their counts."""
    every = max(1, plain.count() // SAMPLE)
    schema = pa.schema([("h", pa.int64())])

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words).view(np.int64))], schema=schema)

    sample = plain.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long")
    counted = sample.groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h = counted.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], counted.column("count").to_numpy()[order]


def prefixes(plain: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, node, size, fp, prefix, parity) of every row; prefix holds the hashes as bytes."""
    common = plain.sparkSession.sparkContext.broadcast(_common(plain, words))
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()), ("prefix", pa.binary()), ("parity", pa.binary())])

    def run(batches):
        known, counts = common.value
        for b in batches:
            nodes, sizes, prints, heads, odd = [], [], [], [], []
            for t in b.column(1).to_pylist():
                found = shingles(t, words)
                n = len(found)
                nodes.append(node_of(found))
                sizes.append(n)
                odd.append(parity(found))
                prints.append(majority(found[i : i + (1 << 15)] for i in range(0, n, 1 << 15)))
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    found = found[np.lexsort((found, np.where(known[at] == found, counts[at], 0)))]
                heads.append(found[: n - least(n, similarity) + 1].tobytes() if n else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(heads, pa.binary()), pa.array(odd, pa.binary())], schema=schema)

    return plain.mapInArrow(run, "id long, node long, size int, fp long, prefix binary, parity binary")


def by_fingerprint(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) that link all nodes whose fingerprints are linked: nodes with the first of their fingerprint, those by the grid."""
    prints = materialise(reps.groupBy("fp").agg(F.min("node").alias("head")), "near-prints")
    own = reps.select("fp", "node").join(prints, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    met = links(prints.select("fp"), BITS)
    x, y = (prints.select(F.col("fp").alias(k), F.col("head").alias(f"h{k}")) for k in "ab")
    across = met.join(x, "a").join(y, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    both = own.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = materialise(both, "near-fingerprints")
    drop(prints)
    return out


def meetings(reps: DataFrame, similarity: float) -> DataFrame:
    """kind 0: pairs (a, b); kind 1: (cell, node) with its size where more than ``SMALL`` meet. Pairs of one ``root`` are left out."""
    entry = pa.schema([("cell", pa.int64()), ("size", pa.int32()), ("node", pa.int64()), ("root", pa.int64()), ("place", pa.int32())])

    def deal(batches):
        for b in batches:
            for n, s, r, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                cells = np.frombuffer(raw, np.int64)
                k = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(k, s, np.int32)), pa.array(np.full(k, n, np.int64)), pa.array(np.full(k, r, np.int64)), pa.array(np.arange(k, dtype=np.int32))], schema=entry)

    kind = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])

    def out(k, a, b, size, place):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k, np.int32)), pa.array(a), pa.array(b), pa.array(size), pa.array(place)], schema=kind)

    def meet(batches):
        for (c, size, node, root, place), whole in cell_runs(batches, BLOCK):
            start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            many = np.diff(np.r_[start, len(c)])
            big = np.repeat((many > SMALL) | (not whole), many)
            if big.any():
                yield out(1, c[big], node[big], size[big], place[big])
            pairs = []
            for d in range(1, int(np.minimum(many, SMALL).max(initial=0))):
                same = np.flatnonzero((c[d:] == c[:-d]) & ((d == 1) | ~big[d:]))
                if not len(same):
                    break
                other = same + d
                same = same[(root[same] != root[other]) & enough(size[same], place[same], size[other], place[other], similarity)]
                pairs.append(np.stack([np.minimum(node[same], node[same + d]), np.maximum(node[same], node[same + d])], 1))
            if pairs:
                e = np.unique(np.concatenate(pairs), axis=0)
                yield out(0, e[:, 0], e[:, 1], np.zeros(len(e), np.int32), np.zeros(len(e), np.int32))

    n = max(partitions(reps.sparkSession), 12)
    dealt = reps.select("node", "size", "root", "prefix").mapInArrow(deal, "cell long, size int, node long, root long, place int")
    return dealt.repartition(n, "cell").sortWithinPartitions("cell", "size", "node").mapInArrow(meet, "kind int, a long, b long, size int, place int")


def plausible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs but those that sizes and parities rule out, with the ids of their documents."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ida", pa.int64()), ("idb", pa.int64())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            total = b.column(4).to_numpy().astype(np.int64) + b.column(5).to_numpy()
            both = zip(b.column(6).to_pylist(), b.column(7).to_pylist())
            apart = np.array([int(np.bitwise_count(folded(x, min(len(x), len(y))) ^ folded(y, min(len(x), len(y)))).sum()) for x, y in both])
            keep = apart * (1 + similarity) <= total * (1 - similarity) + 1e-6
            yield pa.RecordBatch.from_arrays(b.columns[:4], schema=schema).filter(pa.array(keep))

    x, y = (reps.select(F.col("node").alias(k), F.col("low").alias(f"id{k}"), F.col("size").alias(f"n{k}"), F.col("parity").alias(f"p{k}")).hint("merge") for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ida", "idb", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long, ida long, idb long")


def similar(pairs: DataFrame, reps: DataFrame, plain: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    left = materialise(plausible(pairs, reps, similarity), "near-plausible", 16 * PAIRS)
    wanted = materialise(left.select(F.col("a").alias("node"), F.col("ida").alias("id")).union(left.select("b", "idb")).distinct(), "near-wanted")
    hashed = wanted.select(F.xxhash64("id").alias("h"))
    rows = hashed.select(F.expr(f"cast((h >> 3) & {BITMAP - 1} as int)").alias("byte"), F.expr("shiftleft(1, cast(h & 7 as int))").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(BITMAP, np.uint8)
    bits[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    bitmap = plain.sparkSession.sparkContext.broadcast(bits.tobytes())
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def cut(batches):
        known = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy()
            hit = (known[h >> 3 & BITMAP - 1] >> (h & 7).astype(np.uint8) & 1).astype(bool)
            found = [shingles(t, words) for t in b.column(1).filter(pa.array(hit)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], schema=schema)

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(b.columns[:2], schema=edge).filter(pa.array(keep, pa.bool_()))

    texts = plain.select(F.xxhash64("id").alias("h"), "text").mapInArrow(cut, "node long, shingles binary")
    sets = materialise(texts.join(wanted.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}s")).hint("merge") for k in "ab")
    out = materialise(left.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "as", "bs").mapInArrow(verify, "a long, b long"), "near-edges", PAIRS)
    drop(left, wanted, sets)
    return out


def _apart(big: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of large cells (cell, node, size, place) that lie in different components (``root`` of ``reps``) and that nothing rules out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    slim = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("bits", pa.binary())])

    def fold(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([folded(x, PARITY // 8).tobytes() for x in b.column(2).to_pylist()], pa.binary())], schema=slim)

    roots = reps.select("node", "root", "parity").mapInArrow(fold, "node long, root long, bits binary")
    rows = materialise(big.join(roots.hint("merge"), "node").select("cell", "node", "size", "place", "root", "bits"), "near-roots")
    open_ = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell", "blocks")
    dealt = (
        rows.join(open_, "cell")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "place", "root", "bits")
    )

    def run(t: pa.Table) -> pa.Table:
        own, node, size, place, root = (t.column(k).to_numpy() for k in ("own", "node", "size", "place", "root"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(own), -1)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = (root[x][:, None] != root[y][None, :]) & enough(size[x][:, None], place[x][:, None], size[y][None, :], place[y][None, :], similarity)
        if i == j:
            near = np.triu(near, 1)
        p, q = np.nonzero(near)
        p, q = x[p], y[q]
        on = [np.bitwise_count(bits[p[k : k + 65536]] ^ bits[q[k : k + 65536]]).sum(1, dtype=np.int64) * (1 + similarity) <= (size[p[k : k + 65536]].astype(np.int64) + size[q[k : k + 65536]]) * (1 - similarity) + 1e-6 for k in range(0, len(p), 65536)]
        on = np.concatenate(on) if on else np.zeros(0, bool)
        a, b = node[p[on]], node[q[on]]
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return dealt.groupBy("cell", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _rooted(reps: DataFrame, comp: DataFrame) -> DataFrame:
    return reps.join(comp.hint("merge"), "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")


def simhash_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` (of the least id) for each component of documents of ``similarity`` or more."""
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null")
    rows = materialise(prefixes(plain, words, similarity), "near-prefixes")
    twice = materialise(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("low")), "near-twice")
    reps = materialise(rows.groupBy("node").agg(F.min("id").alias("low"), *[F.first(c).alias(c) for c in ("size", "fp", "prefix", "parity")]), "near-nodes")
    drop(rows)
    edges = similar(by_fingerprint(reps), reps, plain, words, similarity)
    joined = materialise(connected_components(edges), "near-joined")
    met = materialise(meetings(_rooted(reps, joined), similarity), "near-met")
    pairs = materialise(met.where("kind = 0").select("a", "b").distinct(), "near-pairs")
    edges = edges.unionByName(similar(pairs, reps, plain, words, similarity))
    comp = materialise(connected_components(edges), "near-components")
    big = met.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("node"), "size", "place")
    if big.limit(1).count():
        more = materialise(_apart(big, _rooted(reps, comp), similarity), "near-apart")
        comp = connected_components(edges.unionByName(similar(more, reps, plain, words, similarity)))
    of = _rooted(reps.select("node", "low"), comp)
    heads = of.groupBy("root").agg(F.min(F.struct("low", "node")).alias("head")).select("head.low", "head.node")
    heads = materialise(heads, "near-heads")
    drop(reps, joined, met, pairs)
    # almost all ids stand in one row; only those that don't need their texts told apart
    return _keep(docs, twice, heads, words, id_col, text_col)


def _keep(docs: DataFrame, twice: DataFrame, heads: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` that are a head, one each, and rows without an id."""
    # the caller's columns travel in a struct, so no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("low"), F.col(f"`{text_col}`").cast("string").alias("text"))
    nodes = pa.schema([("low", pa.int64()), ("node", pa.int64()), ("text", pa.string())])

    def tell(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([node_of(shingles(t, words)) for t in b.column(1).to_pylist()], pa.int64()), b.column(1)], schema=nodes)

    once = rows.join(heads.select("low").join(twice, "low", "left_anti").hint("merge"), "low", "left_semi")
    out = once.select("row").unionByName(rows.where("low is null").select("row"))
    if twice.limit(1).count():
        repeated = rows.join(twice, "low", "left_semi")
        told = repeated.select("low", "text").mapInArrow(tell, "low long, node long, text string")
        # of several texts of one head the least one stands for it
        told = told.join(heads, ["low", "node"], "left_semi").groupBy("low", "node").agg(F.min("text").alias("least")).select(F.col("low").alias("own"), "least")
        same = (F.col("low") == F.col("own")) & F.col("text").eqNullSafe(F.col("least"))
        out = out.unionByName(repeated.join(told, same, "left_semi").dropDuplicates(["low", "text"]).select("row"))
    return out.select("row.*")
