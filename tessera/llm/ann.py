"""Nearest neighbours by inner product with an adaptive dimension scan.

Inner product becomes distance by one more coordinate: with M the largest norm,
(x, sqrt(M^2 - |x|^2)) and (q, 0) lie |q|^2 + M^2 - 2 q.x apart. The space is
turned by a random rotation, so any leading block of coordinates samples the
whole distance: of a squared distance in D dimensions the first t coordinates
hold a share that follows Beta(t/2, (D - t)/2). Rows fall into lists by the
nearest of a few centres. Within a probed list the distance is summed in column
blocks, and after each block a test abandons candidates: a partial distance
above the k-th best distance so far times the share's (1 - alpha) quantile
refutes that the candidate is near enough. What survives all blocks is scored
exactly (double precision, on the original vectors).

The k-th best distance is known early: a query scans its nearest list first,
carries the k-th best of it to its other lists, and lowers it further after
every slab of rows. As it is always that of k rows found, no query ends with
fewer than k where its lists hold as many.

The centres are fitted on at most ``sample_rows`` rows; the number of lists a
query probes is calibrated on that sample for the recall asked for. Every row
is indexed. Lists are cut into chunks of about ``CHUNK`` rows and their queries
likewise, as the sample's shares foretell, so a task's group is bounded on both
sides. Of equal vectors only the k + 1 least ids can be among the k nearest of
any query, so no more are compared; equal query vectors are searched once.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; vectors of each length are a space of their own, in
which a length that the sample lacks is searched without an index; equal scores
go by smaller id; repeated candidate rows count each; every query row is a
query of its own and finds all rows but itself, also others with its id; fewer
candidates than k give all of them; an empty table gives an empty result; extra
columns are ignored; rows without an id take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, partitions

SLAB, TILE, BLOCKS, CHUNK = 128, 128, 12, 8192
RESULT = "query_id long, rank int, vec_id long, score double, n_candidates long, n_abandoned long"


def usable(vectors: DataFrame, vector_col: str) -> Column:
    """Whether a vector is there, finite and not zero."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def by_length(column: pa.Array):
    """(places, matrix) of the vectors of each length in a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, rows_of(column.take(pa.array(at)))


def shares(edges: np.ndarray, d: int, alpha: float) -> np.ndarray:
    """For each edge t the (1 - alpha) quantile of Beta(t/2, (d - t)/2); a hair above 1 for t = d."""
    x = (np.arange(1 << 14) + 0.5) / (1 << 14)
    out = []
    for t in edges.tolist():
        if t >= d:
            out.append(1 + 1e-9)
            continue
        log = (t / 2 - 1) * np.log(x) + ((d - t) / 2 - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(log - log.max()))
        out.append(min(1.0, x[np.searchsorted(mass, (1 - alpha) * mass[-1])]))
    return np.array(out)


class Index:
    """Rotation, centres and probes of the vectors of one length; as large for any number of rows.

    ``sample``: some rows; ``asked``: some queries; ``rows``, ``queries``: how
    many there are of either in all; ``norm``: the largest norm of a row.
    """

    def __init__(self, sample: np.ndarray, asked: np.ndarray, norm: float, rows: int, queries: int, k: int, recall: float, alpha: float, seed: int):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.norm, self.dim, self.k = norm, d, k
        self.edges = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
        self.shares = shares(self.edges[1:], d, alpha)
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        self.turn = q * np.sign(np.diag(r))
        turned_rows = self.rotate(sample)
        lists = max(1, min(len(sample), 4096, max(4, int(np.sqrt(rows) / 3))))
        c = turned_rows[rng.choice(len(sample), lists, replace=False)]
        for _ in range(12):
            own = self._nearest(turned_rows, c)
            total = np.zeros_like(c)
            np.add.at(total, own, turned_rows)
            n = np.bincount(own, minlength=len(c))
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        self.centres = np.unique(c, axis=0)
        turned = self.rotate(asked, True)
        self.probes = self._calibrate(turned, turned_rows, recall)
        self.row_parts = self._parts(self.lists_of(turned_rows), rows / len(sample))
        self.query_parts = self._parts(self.probed(turned)[1], queries / max(1, len(asked)))

    def _parts(self, lists: np.ndarray, times: float) -> np.ndarray:
        """Into how many chunks each list is cut, from the sample's share of it (and a margin for chance)."""
        n = np.bincount(lists, minlength=len(self.centres))
        return np.maximum(1, np.ceil((n + 3 * np.sqrt(n) * (times > 1) + 3 * (times > 1)) * times / CHUNK)).astype(np.int64)

    def rotate(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, extra[:, None]], 1) @ self.turn

    @staticmethod
    def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", c, c)[None, :] - 2 * x @ c.T

    def _nearest(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([self._gaps(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])

    def lists_of(self, rotated: np.ndarray) -> np.ndarray:
        return self._nearest(rotated, self.centres)

    def probed(self, rotated: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, list, place) of the lists that queries probe, each query's nearest first.

        A query probes ``probes`` lists, and on until its lists hold k rows;
        ``held``: how many rows each list holds.
        """
        who, lists, places = [], [], []
        for s in range(0, len(rotated), 1024):
            order = np.argsort(self._gaps(rotated[s : s + 1024], self.centres), axis=1, kind="stable")
            n = np.full(len(order), min(self.probes, order.shape[1]))
            if held is not None:
                n = np.maximum(n, np.minimum((held[order].cumsum(1) < self.k).sum(1) + 1, order.shape[1]))
            q = np.repeat(np.arange(len(order)), n)
            place = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            who.append(q + s)
            places.append(place)
            lists.append(order[q, place])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, lists, places))

    def _calibrate(self, asked: np.ndarray, rows: np.ndarray, recall: float) -> int:
        """The fewest probes with which the sample's queries find ``recall`` of their neighbours in the sample."""
        if len(rows) <= self.k or not len(asked):
            return len(self.centres)
        some = asked[:256]
        near = np.argpartition(self._gaps(some, rows), self.k - 1, axis=1)[:, : self.k]
        order = np.argsort(self._gaps(some, self.centres), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        at = np.sort(np.take_along_axis(place, self.lists_of(rows)[near], 1).ravel())
        return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1


def adaptive_scan(queries: np.ndarray, rows: np.ndarray, k: int, edges: np.ndarray, share: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) places of the pairs that survive, how many candidates each query abandoned, and its k-th best distance.

    Queries and rows are rotated; ``worst``: the k-th best squared distance each query knows beforehand.
    """
    kept_q, kept_x, kept_d = [], [], []
    abandoned = np.zeros(len(queries), np.int64)
    limits = np.array(worst, float)
    for t in range(0, len(queries), TILE):
        q = queries[t : t + TILE]
        m = len(q)
        best = np.full((m, k), np.inf)
        limit = limits[t : t + TILE].copy()
        for s in range(0, len(rows), SLAB):
            x = rows[s : s + SLAB]
            part, live, who = np.zeros((m, len(x))), np.ones((m, len(x)), bool), None
            for a, b, f in zip(edges[:-1], edges[1:], share):
                bound = limit * f + 1e-12
                if who is None:  # most are alive: one matrix product for the block
                    xb, qb = x[:, a:b], q[:, a:b]
                    part += np.einsum("ij,ij->i", qb, qb)[:, None] + np.einsum("ij,ij->i", xb, xb)[None, :] - 2 * qb @ xb.T
                    live &= part <= bound[:, None]
                    if np.count_nonzero(live) < 0.15 * live.size:
                        who, which = np.nonzero(live)
                        left = part[who, which]
                else:  # few are alive: only those
                    gap = q[who, a:b] - x[which, a:b]
                    left = left + np.einsum("ij,ij->i", gap, gap)
                    on = left <= bound[who]
                    who, which, left = who[on], which[on], left[on]
            if who is None:
                who, which = np.nonzero(live)
                left = part[who, which]
            abandoned[t : t + m] += len(x) - np.bincount(who, minlength=m)
            if not len(who):
                continue
            kept_q.append(who + t)
            kept_x.append(which + s)
            kept_d.append(left)
            seen = np.full((m, len(x)), np.inf)
            seen[who, which] = left
            best = np.partition(np.concatenate([best, seen], 1), k - 1, axis=1)[:, :k]
            limit = np.minimum(limit, best[:, k - 1] * (1 + 1e-9) + 1e-12)
        limits[t : t + m] = limit
    a, b, d = (np.concatenate(v) if v else np.empty(0, kind) for v, kind in ((kept_q, np.int64), (kept_x, np.int64), (kept_d, float)))
    on = d <= limits[a]
    return a[on], b[on], abandoned, limits


def _best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, who))
    first = np.searchsorted(who[order], who[order])
    return order[np.arange(len(order)) - first < k]


def build(rows: DataFrame, asked: DataFrame, k: int, recall: float, alpha: float, sample_rows: int, seed: int) -> dict[int, Index]:
    """An index for each length that at most ``sample_rows`` sampled rows have."""
    near = F.xxhash64(F.lit(seed), "v")
    picked = rows.orderBy(near, "id", "row").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
    wanted = asked.orderBy(near).limit(max(1, sample_rows // 8)).select("v").toArrow().column("v").combine_chunks()
    queries = {x.shape[1]: x for _, x in by_length(wanted)}
    found = {x.shape[1]: x for _, x in by_length(picked)}
    if not found:
        return {}
    size = F.size("v").alias("d")
    norm = F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)).alias("m")
    sizes = {r["d"]: r for r in rows.groupBy(size).agg(F.count("*").alias("n"), norm).where(F.col("d").isin(*found)).collect()}  # one row for each length in the sample
    many = dict(asked.groupBy(size).count().where(F.col("d").isin(*found)).collect())
    return {d: Index(x, queries.get(d, x[:256]), float(np.sqrt(sizes[d]["m"])) * (1 + 1e-9), sizes[d]["n"], many.get(d, 0), k, recall, alpha, seed) for d, x in found.items()}


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.98, alpha: float = 0.002, sample_rows: int = 8192, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score, n_candidates, n_abandoned): the k nearest rows found for every row that ``is_query`` picks.

    ``n_candidates`` and ``n_abandoned`` count the rows a query's lists held and those the scan gave up before their last block.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    good = vectors.where(usable(vectors, vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = materialise(good.withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    copies = Window.partitionBy("v").orderBy("id", "row")
    rows = materialise(good.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("row", "id", "v"), "ann-distinct")
    asked = materialise(good.where("q").groupBy("v").agg(F.min("row").alias("query")), "ann-queries")
    indexes = build(rows, asked, k + 1, recall, alpha, sample_rows, seed)
    if not indexes or not asked.limit(1).count():
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast(indexes)  # bounded by sample_rows
    parts = max(1, -(-rows.count() // sample_rows))  # chunks of a length without an index; such lengths are rare

    vector = pa.list_(pa.float32() if kind == "float" else pa.float64())
    placed = pa.schema([("d", pa.int32()), ("list", pa.int32()), ("chunk", pa.int32()), ("others", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("worst", pa.float64()), ("v", vector)])
    shape = f"d int, list int, chunk int, others int, id long, row long, worst double, v array<{kind}>"

    def deal(d, lists, own, others, ids, rows, worst, v):
        """Rows or queries by list, each in one of the chunks of its own side."""
        chunk = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % own
        columns = (np.full(len(ids), d), lists, chunk, others, ids, rows, worst)
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, placed)), v], schema=placed)

    def place(batches):
        for b in batches:
            for at, x in by_length(b.column(2)):
                index, v = shared.value.get(x.shape[1]), b.column(2).take(pa.array(at))
                row, ids = (b.column(i).to_numpy()[at] for i in (0, 1))
                lists = index.lists_of(index.rotate(x)) if index else np.zeros(len(x), np.int64)
                own, others = (index.row_parts[lists], index.query_parts[lists]) if index else (np.full(len(x), parts), np.full(len(x), parts))
                yield deal(x.shape[1], lists, own, others, ids, row, np.zeros(len(x)), v)

    def probe(first: bool):
        def run(batches):
            for b in batches:
                for at, x in by_length(b.column(1)):
                    index, query = shared.value.get(x.shape[1]), b.column(0).to_numpy()[at]
                    if index:
                        who, lists, nth = index.probed(index.rotate(x, True), held.value[x.shape[1]])
                        own = nth == 0 if first else nth > 0
                        who, lists = who[own], lists[own]
                        worst = np.full(len(x), np.inf) if first else b.column(2).to_numpy(zero_copy_only=False)[at]
                    else:
                        who = np.arange(len(x) if first else 0)
                        lists, worst = np.zeros(len(who), np.int64), np.full(len(x), np.inf)
                    own, others = (index.query_parts[lists], index.row_parts[lists]) if index else (np.full(len(who), parts), np.full(len(who), parts))
                    yield deal(x.shape[1], lists, own, others, query[who], query[who], worst[who], b.column(1).take(pa.array(at[who])))

        return run

    schema = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("kth", pa.float64()), ("seen", pa.int64()), ("gone", pa.int64())])
    out = "query long, row long, id long, score double, kth double, seen long, gone long"

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, q = rows_of(left.column("v").combine_chunks()), rows_of(right.column("v").combine_chunks())
        row, ids, query = (t.column(c).to_numpy() for t, c in ((left, "row"), (left, "id"), (right, "row")))
        index = shared.value.get(x.shape[1])
        if index:
            who, which, gone, kth = adaptive_scan(index.rotate(q, True), index.rotate(x), k + 1, index.edges, index.shares, right.column("worst").to_numpy())
        else:
            who, which = (a.ravel() for a in np.indices((len(q), len(x))))
            gone, kth = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
        score = np.concatenate([np.einsum("ij,ij->i", q[who[i : i + 65536]], x[which[i : i + 65536]]) for i in range(0, len(who), 65536)] or [np.empty(0)])
        top = _best(who, score, ids[which], k + 1)
        who, which, score = who[top], which[top], score[top]
        n, m = len(who), len(q)
        # hits, then a row of counts for every query
        columns = (np.r_[query[who], query], np.r_[row[which], np.zeros(m, np.int64)], np.r_[ids[which], np.zeros(m, np.int64)], np.r_[score, np.zeros(m)], np.r_[kth[who], kth], np.r_[np.zeros(n, np.int64), np.full(m, len(x))], np.r_[np.zeros(n, np.int64), gone])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    tasks = max(partitions(spark), 12)
    keys = ["d", "list", "chunk", "others"]

    def met(where: DataFrame) -> DataFrame:
        # a row meets every chunk of queries of its list, a query every chunk of rows
        each = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
        x = indexed.withColumn("others", each).repartition(tasks, *keys)
        turned = [F.col("chunk").alias("others") if c == "others" else F.col("others").alias("chunk") if c == "chunk" else F.col(c) for c in where.columns]
        y = where.withColumn("others", each).select(*turned).repartition(tasks, *keys)
        return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(scan, out)

    indexed = materialise(rows.select("row", "id", "v").mapInArrow(place, shape), "ann-index")
    filled = {d: np.zeros(len(index.centres), np.int64) for d, index in indexes.items()}
    for r in indexed.where(F.col("d").isin(*indexes)).groupBy("d", "list").count().collect():  # one row for each list
        filled[r["d"]][r["list"]] = r["count"]
    held = spark.sparkContext.broadcast(filled)
    near = materialise(met(asked.select("query", "v").mapInArrow(probe(True), shape)), "ann-nearest")
    known = asked.join(near.groupBy("query").agg(F.min("kth").alias("worst")), "query", "left").select("query", "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    rest = materialise(met(known.mapInArrow(probe(False), shape)), "ann-rest")
    found = near.unionByName(rest)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    top = found.where("seen = 0").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    counts = found.where("seen > 0").groupBy("query").agg(F.sum("seen").alias("n_candidates"), F.sum("gone").alias("n_abandoned"))
    top = materialise(top.join(counts, "query").select("query", "row", "id", "score", "n_candidates", "n_abandoned"), "ann-top")
    drop(indexed, near, rest)
    # every query row gets the hits of its vector but for itself
    own = good.where("q").select(F.col("row").alias("own"), F.col("id").alias("query_id"), "v").join(asked, "v").select("own", "query_id", "query")
    order = Window.partitionBy("own").orderBy(F.desc("score"), "id", "row")
    ranked = own.join(top, "query").where("row <> own").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score", "n_candidates", "n_abandoned")
