"""Embedding near-duplicates by collision-counting projections.

Unit vectors with cosine c lie sqrt(2 - 2c) = r apart. They are projected on
the D axes of a random rotation. Of a pair within r, at most r^2 / w^2 of its
D projected gaps can exceed w, as the squares of all gaps sum to r^2 or less;
so with the half-width w = r / sqrt(MISSES) every true pair collides in at
least D - MISSES of the windows centred at the query vector: the count is
calibrated to a recall of one, not to a sample. Pairs that reach it, and no
others, are verified by their cosine in double precision.

Which pairs meet at all rests on the same sum. Deal the axes to GROUPS groups:
in one of them at least, the squared gaps of a true pair sum to r^2 / GROUPS or
less, so no gap there exceeds r / sqrt(GROUPS). In each group a vector enters the
cells, on the group's first few axes, that its window of that width touches (a
cell is ``WIDE`` = 2 windows wide, so 3/2 cells an axis); a true pair shares the
cell of its midpoint. The number of axes follows the size of the largest label,
so cells hold about ``BLOCK`` rows, and a label of few rows is one cell. A link counts in the first
group whose axes all collide, in the midpoint's cell only. A cell of more rows
is dealt out in pairs of blocks. A task returns link counts and a spanning
forest of its links, never all pairs.

Equal vectors of a label are one row with a weight, so copies cost nothing.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows without a label, link with nothing and are their own
component; vectors of different lengths don't link; repeated rows count as rows
(a vector's copy is a link); a row without an id is never kept and never a
component's id unless all are; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import by_length, rows_of, usable
from .common import drop, materialise, partitions
from .graph import connected_components

BLOCK, STRIP, MISSES, FIRST = 4096, 512, 4, 16
#: groups of axes, and windows in the width of a cell
GROUPS, WIDE = 8, 2


@lru_cache(64)
def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def projected(x: np.ndarray) -> np.ndarray:
    """Unit vectors on the axes of the rotation."""
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] @ rotation(x.shape[1])


def radius(cosine: float) -> float:
    return np.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9


def _mixed(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    key = (key ^ place.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(29))


def _axes(d: int, group: int, axes: int) -> range:
    per = d // min(GROUPS, d)
    return range(group * per, group * per + min(axes, per))


def cells(x: np.ndarray, cosine: float, axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, cell) of the cells that projected rows enter."""
    d = x.shape[1]
    eps = radius(cosine) / np.sqrt(min(GROUPS, d))
    half = eps / 2 * (1 + 1e-9) + 1e-12
    rows, groups, keys = [], [], []
    for g in range(min(GROUPS, d) if axes else 1):
        at, key = np.arange(len(x)), np.full(len(x), g + 1, np.uint64)
        for a in _axes(d, g, axes):
            low, high = (np.floor((x[at, a] + s) / (WIDE * eps)) for s in (-half, half))
            two = high > low
            at, key = np.concatenate([at, at[two]]), np.concatenate([_mixed(key, low), _mixed(key[two], high[two])])
        rows.append(at)
        groups.append(np.full(len(at), g))
        keys.append(key.view(np.int64))
    return tuple(map(np.concatenate, (rows, groups, keys)))


def counted_here(x: np.ndarray, y: np.ndarray, cosine: float, axes: int, group: int, cell: int) -> np.ndarray:
    """Which pairs of projected rows count in this cell: their first group that collides, the cell of their midpoint."""
    d = x.shape[1]
    eps = radius(cosine) / np.sqrt(min(GROUPS, d))
    ok = np.ones(len(x), bool)
    for g in range(group):
        own = list(_axes(d, g, axes))
        ok &= (np.abs(x[:, own] - y[:, own]) > eps).any(1)
    key = np.full(len(x), group + 1, np.uint64)
    for a in _axes(d, group, axes):
        ok &= np.abs(x[:, a] - y[:, a]) <= eps
        key = _mixed(key, np.floor((x[:, a] + y[:, a]) / 2 / (WIDE * eps)))
    return ok & (key.view(np.int64) == cell)


def collisions(x: np.ndarray, y: np.ndarray, w: float, misses: int) -> np.ndarray:
    """Which pairs of projected rows collide in all but ``misses`` windows.

    Rows y are sorted on a projection, each x has its window there, and the
    members of the windows are counted; after ``FIRST`` projections the pairs
    that can still reach the count are few, and the rest is counted for them.
    """
    lacking = np.full((len(x), len(y)), 0, np.int8)
    first = min(FIRST, x.shape[1])
    place = np.arange(len(y))
    for j in range(first):
        order = np.argsort(y[:, j], kind="stable")
        line = y[order, j]
        lo, hi = np.searchsorted(line, x[:, j] - w, "left"), np.searchsorted(line, x[:, j] + w, "right")
        at = np.empty_like(order)
        at[order] = place
        lacking += (at[None, :] < lo[:, None]) | (at[None, :] >= hi[:, None])
    ok = lacking <= misses
    if first == x.shape[1] or not ok.any():
        return ok
    if ok.mean() > 0.2:
        for j in range(first, x.shape[1]):
            lacking += np.abs(x[:, j][:, None] - y[:, j][None, :]) > w
        return lacking <= misses
    a, b = np.nonzero(ok)
    for i in range(0, len(a), 1 << 16):
        p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        more = (np.abs(x[p, first:] - y[q, first:]) > w).sum(1)
        ok[p, q] = lacking[p, q] + more <= misses
    return ok


def linked(u: np.ndarray, v: np.ndarray, xu: np.ndarray, xv: np.ndarray, cosine: float) -> np.ndarray:
    """Verified links between the rows of two blocks. u, v: as given; xu, xv: projected."""
    misses = min(MISSES, u.shape[1] - 1)
    ok = collisions(xu, xv, radius(cosine) / np.sqrt(max(1, misses)) * (1 + 1e-9), misses)
    a, b = np.nonzero(ok)
    if not len(a):
        return ok
    nu, nv = np.sqrt(np.einsum("ij,ij->i", u, u)), np.sqrt(np.einsum("ij,ij->i", v, v))
    if len(a) > 0.1 * ok.size:  # most collide: one matrix product is the cheaper way to their cosines
        c = (u @ v.T) / (nu[:, None] * nv[None, :])
        ok &= c >= cosine - 1e-9
        a, b = np.nonzero(ok & (c < cosine + 1e-9))  # where the order of the sum may matter
    for i in range(0, len(a), 1 << 16):
        p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        ok[p, q] = np.einsum("ij,ij->i", u[p], v[q]) / (nu[p] * nv[q]) >= cosine
    return ok


def _forest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (ids) with the components of a block's links; rows and cols: ids of its sides."""
    big = np.iinfo(np.int64).max
    a, b = [], []
    r = np.flatnonzero(link.any(1))
    if not len(r):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sub = link[r]
    c = np.flatnonzero(sub.any(0))
    sub = sub[:, c]
    label = np.arange(len(r))
    while True:
        col = np.where(sub, label[:, None], big).min(0)
        new = np.where(sub, col[None, :], big).min(1)
        if (new == label).all():
            break
        label = new
    a += [rows[r], cols[c]]
    b += [rows[r[label]], rows[r[col]]]
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def embedding_dedup(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.col(label_col).cast("string").alias("label"))
    able = usable(plain, "v") & F.col("label").isNotNull()
    seen = plain.where(able).groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    rows = materialise(seen.withColumn("row", F.monotonically_increasing_id()), "embdedup-rows")
    most = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    # an axis leaves about half of the pairs in a cell, and there are GROUPS chances to meet; with fewer rows one cell is less work
    axes = 0 if most <= 16 * BLOCK else max(6, int(np.ceil(np.log2(most / BLOCK))))

    entry = pa.schema([("label", pa.string()), ("d", pa.int32()), ("grp", pa.int32()), ("cell", pa.int64()), ("row", pa.int64())])

    def enter(batches):
        for b in batches:
            for at, x in by_length(b.column(2)):
                for i in range(0, len(x), 1024):
                    which, group, cell = cells(projected(x[i : i + 1024]), cosine, axes)
                    own = pa.array(at[i : i + 1024][which])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), pa.array(np.full(len(which), x.shape[1]), pa.int32()), pa.array(group, pa.int32()), pa.array(cell), b.column(1).take(own)], schema=entry)

    key = ["label", "d", "grp", "cell"]
    entries = materialise(rows.select("label", "row", "v").mapInArrow(enter, "label string, d int, grp int, cell long, row long"), "embdedup-entries")
    blocks = materialise(entries.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "embdedup-cells")
    dealt = (
        entries.join(blocks, key)  # rows alone in a cell meet nobody there
        .withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row")
    )
    met = dealt.join(rows.select("row", "weight", "v"), "row").select(*key, "i", "j", "own", "row", "weight", "v")

    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        blocks, ids, weight = (t.column(c).to_numpy() for c in ("own", "row", "weight"))
        i, j, group, cell = (t.column(c)[0].as_py() for c in ("i", "j", "grp", "cell"))
        x = rows_of(t.column("v").combine_chunks())
        unit = projected(x)
        left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        links, edges = np.zeros(len(ids), np.int64), []
        for s in range(0, len(left), STRIP):
            p = left[s : s + STRIP]
            for e in range(s if i == j else 0, len(right), STRIP):
                q = right[e : e + STRIP]
                link = linked(x[p], x[q], unit[p], unit[q], cosine)
                own = i == j and s == e
                if own:
                    np.fill_diagonal(link, False)
                a, b = np.nonzero(link)
                if not len(a):
                    continue
                if axes:
                    for k in range(0, len(a), 1 << 16):
                        f, g = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                        link[f, g] = counted_here(unit[p[f]], unit[q[g]], cosine, axes, group, cell)
                links[p] += link @ weight[q]
                if not own:
                    links[q] += weight[p] @ link
                edges.append(_forest(link, ids[p], ids[q]))
        some = links > 0
        ea, eb = (np.concatenate([x[k] for x in edges]) if edges else np.empty(0, np.int64) for k in (0, 1))
        kind = np.r_[np.zeros(int(some.sum()), np.int32), np.ones(len(ea), np.int32)]
        return pa.Table.from_arrays([pa.array(kind), pa.array(np.r_[ids[some], ea]), pa.array(np.r_[links[some], eb])], schema=schema)

    pair = [*key, "i", "j"]
    got = materialise(met.repartition(max(partitions(spark), 12), *pair).groupBy(*pair).applyInArrow(compare, "kind int, a long, b long"), "embdedup-links")
    links = got.where("kind = 0").groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("links"))
    comp = connected_components(got.where("kind = 1").select("a", "b")).select(F.col("node").alias("row"), "component")
    of = rows.join(links, "row", "left").join(comp, "row", "left").select("label", "v", "low", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "row").alias("root"))
    of = materialise(of, "embdedup-of")
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = materialise(of.join(least, "root").select("label", "v", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "embdedup-answer")
    drop(entries, blocks, got, of)
    fit = plain.where(able).join(answer, ["label", "v"]).select("vec_id", "n_links", "component_id")
    unfit = plain.where(~F.coalesce(able, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fit.unionByName(unfit).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle(cosine: float = 0.98) -> str:
    """DuckDB SQL for the same rows, from all pairs; for small tables."""
    return f"""
WITH RECURSIVE
v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {cosine}),
c AS (SELECT r AS a, r AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT v.vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = v.r), 0)::BIGINT AS n_links, m.component_id, coalesce(v.vec_id = m.component_id, false) AS kept
FROM v JOIN (SELECT c.a, min(w.vec_id) AS component_id FROM c JOIN v w ON w.r = c.b GROUP BY c.a) m ON m.a = v.r
"""
