"""Removal of byte strings that an earlier document already has.

Every byte covered by a ``length``-byte string that also starts in a document
with a smaller id is removed (overlaps count, strings are judged on the input).

1. Texts are kept as *chunks*: about ``CHUNK`` bytes of whole documents in one
   compressed row of a shared table. It is bucketed by chunk, so the joins that
   bring hashes and answers to the texts move those alone, never the texts.
2. Every window of ``length`` bytes has a minimiser: the least hash among its
   ``GRAM``-byte grams, leftmost on ties. Equal windows have equal minimisers.
   Their 32-bit hashes, each at most twice from a chunk, meet by hash range;
   only hashes that occur at least twice go on (false ones cost work only).
3. Consecutive windows with one minimiser form a fragment. A chunk sends each
   distinct fragment once, with the least id that has it, so a passage that a
   third of all rows share is one entry from each chunk. Fragments meet by
   minimiser hash; there the distinct ones are concatenated, and the bounded
   Burrows-Wheeler expansion (``bwt.py``) groups their windows into equal
   strings and finds the least id of each.
4. The answers return to the chunks, which mark their documents' bytes.

A hash range gets an entry from each chunk that has a part of it, so a passage
that a third of a very large corpus shares would put millions of entries into
one range. Beyond ``ENTRIES`` chunks the entries of a range first meet in parts
of that many; a part goes on as one entry without what its chunks repeat, and
the answer to it is dealt back to them. That takes the entries twice, so the
fragments of so many chunks are sent a share of the hash ranges at a time
(``ROUNDS`` shares at most).

All stages are keyed by chunk or hash range, tables between them lie in the
shared folder, and nothing is collected to the driver but counts.

Defined cases: a null text is empty; a text under ``length`` bytes loses
nothing; repeated rows with one id are one document (they don't remove each
other's bytes); a null id counts as larger than any other; equal strings in
one document only are kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import common_prefix_groups
from .common import CLEANUP, _setting, drop, materialise, new_folder, partitions

GRAM = 20
CHUNK = 4 << 20
BLOCK = 1 << 16
GROUP = 128 << 10
RANGE = 6 << 20
#: entries of one hash range that a task takes at once
ENTRIES = 4096
#: beyond them, shares of the hash ranges that are sent one after the other, at most
ROUNDS = 4
NO_ID = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15 | 1


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed block; the bytes of a number lie apart, which compresses better."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes)


def _unzip(block: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2)
    at, out = 8 + 16 * n, []
    for (item, count), kind in zip(sizes.tolist(), types):
        part = np.frombuffer(raw, np.uint8, item * count, at)
        out.append(np.ascontiguousarray(part.reshape(item, count).T).reshape(-1).view(kind))
        at += item * count
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """(chunk_id, ids, nulls, sizes, body): whole documents, in rows of about ``chunk`` bytes."""
    schema = pa.schema([("chunk_id", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary())])

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        ids, sizes, parts, total = [], [], [], 0

        def row():
            known = np.array([i is not None for i in ids], np.uint8)
            data = _zip(np.array([i or 0 for i in ids], np.int64), known, np.array(sizes, np.int64), np.frombuffer(b"".join(parts), np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                t = t or b""
                if total and total + len(t) > chunk:
                    yield row()
                    number += 1
                    ids, sizes, parts, total = [], [], [], 0
                ids.append(i)
                sizes.append(len(t))
                parts.append(t)
                total += len(t)
        if ids:
            yield row()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "chunk_id long, n_bytes long, data binary")


def by_chunk(table: DataFrame, tasks: int) -> DataFrame:
    """``table`` in the shared folder, bucketed by chunk_id: a join on it leaves the rows where they are."""
    spark = table.sparkSession
    name = f"suffix_chunks_{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        table.repartition(tasks, "chunk_id").write.format("parquet").option("compression", "zstd").option("path", new_folder(spark, "suffix-chunks")).bucketBy(tasks, "chunk_id").saveAsTable(name)
    return spark.table(name)


def _least_grams(body: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes its least gram: hash in the upper, place in the lower 32 bits."""
    gram = min(GRAM, length)
    h = body.astype(np.uint64) + np.uint64(1)
    grams, width, power = None, 1, BASE  # hashes of doubling widths; those whose sum is ``gram`` are joined
    done = 0
    while True:
        if gram & width:
            grams = h if grams is None else grams[: len(h) - done] * np.uint64(power) + h[done:]
            done += width
        if 2 * width > gram:
            break
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    grams = grams[: len(body) - gram + 1]
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams &= np.uint64(0xFFFFFFFF00000000)
    grams |= np.arange(len(grams), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        grams = np.minimum(grams[:-width], grams[width:])
        width *= 2
    if width < span:
        grams = np.minimum(grams[: len(grams) - (span - width)], grams[span - width :])
    return grams


class Chunk:
    """Texts of a chunk, and the fragments their windows fall into."""

    def __init__(self, data: bytes, length: int):
        self.ids, known, self.sizes, self.body = _unzip(data, np.int64, np.uint8, np.int64, np.uint8)
        self.known = known.astype(bool)
        self.rank = np.where(self.known, self.ids, NO_ID)
        self.length = length

    def fragments(self) -> None:
        """Set hash, first window, last window and document of each fragment.

        Windows are taken a block at a time, so the memory is that of a block
        however long a text is; a fragment that crosses blocks becomes two.
        """
        n, length = len(self.body), self.length
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        windows = np.maximum(0, self.sizes - length + 1)
        some = windows > 0
        edge = np.zeros(n + 1, np.int8)
        edge[starts[some]] += 1
        edge[starts[some] + windows[some]] -= 1
        valid = np.cumsum(edge[:n], dtype=np.int8) > 0
        hashes, first, last = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, n - length + 1, BLOCK):
            b = min(a + BLOCK, n - length + 1)
            at = np.flatnonzero(valid[a:b])
            if not len(at):
                continue
            best = _least_grams(self.body[a : b + length - 1], length)[at]
            new = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
            hashes.append((best[new] >> np.uint64(32)).astype(np.uint32))
            first.append(a + at[new])
            last.append(a + at[np.r_[new[1:], len(at)] - 1])
        self.hash, self.first, self.last = map(np.concatenate, (hashes, first, last))
        self.hash = self.hash * np.uint32(0x9E3779B1)  # least hashes crowd the low range; this spreads them one to one
        self.doc = np.searchsorted(ends, self.first, "right")

    def hashes(self) -> np.ndarray:
        """Sorted hashes of the fragments, twice where at least two documents have them."""
        self.fragments()
        pair = np.unique((self.hash.astype(np.uint64) << np.uint64(32)) | self.doc.astype(np.uint64))
        value, count = np.unique((pair >> np.uint64(32)).astype(np.uint32), return_counts=True)
        return np.repeat(value, np.minimum(count, 2))

    def select(self, wanted: np.ndarray) -> None:
        """Keep fragments with these (sorted) hashes; number the distinct ones in order of hash."""
        self.fragments()
        if not len(wanted) or not len(self.hash):
            keep = np.zeros(len(self.hash), bool)
        else:
            keep = wanted[np.minimum(np.searchsorted(wanted, self.hash), len(wanted) - 1)] == self.hash
        self.hash, self.first, self.last, self.doc = (x[keep] for x in (self.hash, self.first, self.last, self.doc))
        by = np.argsort(self.hash, kind="stable")
        self.hash, self.first, self.last, self.doc = (x[by] for x in (self.hash, self.first, self.last, self.doc))
        raw, seen = self.body.tobytes(), {}
        number = [seen.setdefault(raw[s:e], len(seen)) for s, e in zip(self.first.tolist(), (self.last + self.length).tolist())]
        self.number = np.array(number, np.int64)
        self.texts = list(seen)
        lead = np.unique(self.number, return_index=True)[1]
        self.text_hash = self.hash[lead]
        self.least = np.full(len(seen), NO_ID, np.int64)
        np.minimum.at(self.least, self.number, self.rank[self.doc])


def _bucket(hash32: np.ndarray, buckets: int) -> np.ndarray:
    return (hash32.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray):
    """(bucket, first, end) of each run."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, int)
    return zip(bucket[at].tolist(), at.tolist(), np.r_[at[1:], len(bucket)].tolist())


PACKED = pa.schema([("bucket", pa.int64()), ("chunk_id", pa.int64()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED)], schema=PACKED)


def window_owners(texts: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """The least id that has each window of each text, one text's windows after the other's; ids of whole texts in ``least``."""
    sizes = np.fromiter(map(len, texts), np.int32, len(texts))
    order, groups = common_prefix_groups(np.frombuffer(b"".join(texts), np.uint8), length)
    place = np.arange(len(order), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
    inside = place <= np.repeat(sizes - length, sizes)  # other windows would run into the next text
    owner = np.where(inside, np.repeat(least, sizes), NO_ID)
    low = np.minimum.reduceat(owner[order], groups)
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(low, np.diff(np.r_[groups, len(order)]))
    return of[inside]


def _runs(owners: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal owners: their number in each text, and of each run its end (in windows of its text) and owner."""
    ends = np.cumsum(windows)
    last = np.ones(len(owners), bool)
    last[:-1] = owners[1:] != owners[:-1]
    last[ends - 1] = True
    at = np.flatnonzero(last)
    text = np.searchsorted(ends, at, "right")
    return np.bincount(text, minlength=len(windows)), at + 1 - (ends - windows)[text], owners[at]


def _distinct(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct fragments of entries (hash, size, least id, bytes), their hashes and least ids, and which each entry has."""
    seen: dict[bytes, int] = {}
    numbers = []
    for _, size, _, body in entries:
        raw, end = body.tobytes(), np.cumsum(size.astype(np.int64)).tolist()
        numbers.append(np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip([0, *end[:-1]], end)], np.int64))
    texts = list(seen)
    del seen
    hashes, least = np.empty(len(texts), np.uint32), np.full(len(texts), NO_ID, np.int64)
    for own, (h, _, low, _) in zip(numbers, entries):
        hashes[own] = h
        np.minimum.at(least, own, low)
    return texts, hashes, least, numbers


def _dealt(count: np.ndarray, ends: np.ndarray, lows: np.ndarray, own: np.ndarray) -> bytes:
    """The answer to an entry: the runs of its fragments."""
    start, n = np.cumsum(count) - count, count[own]
    at = np.arange(int(n.sum())) + np.repeat(start[own] - (np.cumsum(n) - n), n)
    return _zip(n.astype(np.uint16), ends[at].astype(np.uint16), lows[at])


def _solve(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[bytes]:
    """Answers to each chunk's entries of one hash range."""
    texts, hashes, least, numbers = _distinct(entries)
    by = np.argsort(hashes, kind="stable")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))[by]
    total, ordered = np.cumsum(sizes), hashes[by]
    edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]).tolist() + [len(by)]
    count, ends, lows, i = [], [], [], 0
    for j, e in enumerate(edges[1:], 1):  # whole minimisers, about GROUP bytes at a time
        if e == len(by) or total[edges[j + 1] - 1] - (total[i - 1] if i else 0) > GROUP:
            owners = window_owners([texts[k] for k in by[i:e].tolist()], least[by[i:e]], length)
            for x, y in zip((count, ends, lows), _runs(owners, sizes[i:e] - length + 1)):
                x.append(y)
            i = e
    count, ends, lows = map(np.concatenate, (count, ends, lows))
    where = np.empty(len(by), np.int64)
    where[by] = np.arange(len(by))
    return [_dealt(count, ends, lows, where[own]) for own in numbers]


def _hashes(block: bytes) -> np.ndarray:
    return np.cumsum(_unzip(block, np.uint32)[0], dtype=np.uint32)


def _in_parts(entries: DataFrame, splits: int, tasks: int, merge, solve, deal) -> DataFrame:
    """What ``solve`` answers to the entries (bucket, chunk_id, data) of each bucket, by way of ``splits`` parts.

    ``merge`` turns the entries of a part into one, ``solve`` answers the merged
    entries of a bucket, ``deal`` (entries, merged answer) answers the entries.
    """
    shape = "bucket long, chunk_id long, data binary"
    if splits == 1:
        return entries.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(solve, shape)
    part = ["bucket", "part"]
    dealt = materialise(entries.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(splits))), "suffix-entries")
    merged = dealt.repartition(tasks, *part).groupBy(*part).applyInArrow(merge, shape)  # a part's number in the place of a chunk's
    answers = materialise(merged.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(solve, shape).withColumnRenamed("chunk_id", "part"), "suffix-parts")
    out = materialise(dealt.repartition(tasks, *part).groupBy(*part).cogroup(answers.repartition(tasks, *part).groupBy(*part)).applyInArrow(deal, shape), "suffix-dealt")
    drop(dealt, answers)
    return out


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept, spans): the remaining bytes of each row's text and the byte spans that were removed."""
    if not 8 <= length < 4096:
        raise ValueError("length must be between 8 and 4095 bytes")
    spark = docs.sparkSession
    tasks = max(partitions(spark), 12)
    table = by_chunk(chunks(docs, id_col, text_col), tasks)
    total, chunks_ = table.agg(F.sum("n_bytes"), F.count("*")).first()
    total = total or 0
    splits = max(1, -(-chunks_ // ENTRIES))
    buckets = max(partitions(spark), total // RANGE, 1)  # hash ranges: groups of a few MB, many of them in a task

    def minimisers(batches):
        for b in batches:
            for c, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = Chunk(d, length).hashes()
                rows = [(k, c, _zip(np.diff(h[s:e], prepend=np.uint32(0)))) for k, s, e in _cuts(_bucket(h, buckets))]
                yield _rows(rows)

    def repeated(t: pa.Table) -> pa.Table:
        got = [_hashes(d) for d in t.column("data").to_pylist()]
        value, count = np.unique(np.concatenate(got), return_counts=True)
        value = value[count > 1]
        rows = []
        for k, c, h in zip(t.column("bucket").to_pylist(), t.column("chunk_id").to_pylist(), got):
            h = np.intersect1d(np.unique(h), value, assume_unique=True)
            if len(h):
                rows.append((k, c, _zip(np.diff(h, prepend=np.uint32(0)))))
        return pa.Table.from_batches([_rows(rows)])

    shape = "bucket long, chunk_id long, data binary"
    def merge_hashes(t: pa.Table) -> pa.Table:
        value, count = np.unique(np.concatenate([_hashes(d) for d in t.column("data").to_pylist()]), return_counts=True)
        both = np.repeat(value, np.minimum(count, 2))
        return pa.Table.from_batches([_rows([(t.column("bucket")[0].as_py(), t.column("part")[0].as_py(), _zip(np.diff(both, prepend=np.uint32(0))))])])

    def deal_hashes(t: pa.Table, answer: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows and answer.num_rows:
            value = _hashes(answer.column("data")[0].as_py())
            for k, c, d in zip(*(t.column(n).to_pylist() for n in ("bucket", "chunk_id", "data"))):
                h = np.intersect1d(np.unique(_hashes(d)), value, assume_unique=True)
                if len(h):
                    rows.append((k, c, _zip(np.diff(h, prepend=np.uint32(0)))))
        return pa.Table.from_batches([_rows(rows)])

    met = _in_parts(table.select("chunk_id", "data").mapInArrow(minimisers, shape), splits, tasks, merge_hashes, repeated, deal_hashes)
    wanted = materialise(met.groupBy("chunk_id").agg(F.collect_list("data").alias("wanted")), "suffix-wanted")

    def chosen(d: bytes, w: list[bytes], first: int = 0, end: int = buckets) -> Chunk:
        c, hashes = Chunk(d, length), np.sort(np.concatenate([_hashes(x) for x in w]))
        place = _bucket(hashes, buckets)
        c.select(hashes[(place >= first) & (place < end)])
        return c

    def send(first, end, batches):
        for b in batches:
            for c, d, w in zip(*(b.column(i).to_pylist() for i in range(3))):
                x = chosen(d, w, first, end)
                rows = []
                for k, s, e in _cuts(_bucket(x.text_hash, buckets)):
                    part = x.texts[s:e]
                    rows.append((k, c, _zip(x.text_hash[s:e], np.fromiter(map(len, part), np.uint16, e - s), x.least[s:e], np.frombuffer(b"".join(part), np.uint8))))
                yield _rows(rows)

    def opened(t: pa.Table) -> list[tuple]:
        return [tuple(_unzip(d, np.uint32, np.uint16, np.int64, np.uint8)) for d in t.column("data").to_pylist()]

    def merge_fragments(t: pa.Table) -> pa.Table:
        texts, hashes, least, _ = _distinct(opened(t.sort_by("chunk_id")))
        data = _zip(hashes, np.fromiter(map(len, texts), np.uint16, len(texts)), least, np.frombuffer(b"".join(texts), np.uint8))
        return pa.Table.from_batches([_rows([(t.column("bucket")[0].as_py(), t.column("part")[0].as_py(), data)])])

    def deal_answers(t: pa.Table, answer: pa.Table) -> pa.Table:
        if not t.num_rows or not answer.num_rows:
            return pa.Table.from_batches([_rows([])])
        t = t.sort_by("chunk_id")
        count, ends, lows = _unzip(answer.column("data")[0].as_py(), np.uint16, np.uint16, np.int64)
        out = [_dealt(count.astype(np.int64), ends, lows, own) for own in _distinct(opened(t))[3]]
        return pa.Table.from_batches([_rows(list(zip(t.column("bucket").to_pylist(), t.column("chunk_id").to_pylist(), out)))])

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk_id")
        entries = opened(t)
        return pa.Table.from_batches([_rows(list(zip(t.column("bucket").to_pylist(), t.column("chunk_id").to_pylist(), _solve(entries, length))))])

    chunked, rounds = table.join(wanted, "chunk_id").select("chunk_id", "data", "wanted"), []
    shares = min(splits, ROUNDS)
    for r in range(shares):
        sent = chunked.mapInArrow(partial(send, buckets * r // shares, buckets * (r + 1) // shares), shape)
        rounds.append(_in_parts(sent, splits, tasks, merge_fragments, solve, deal_answers))
    solved = reduce(DataFrame.unionByName, rounds)
    answers = materialise(solved.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias("answers")), "suffix-answers")

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(span))])

    def mark(batches):
        for b in batches:
            for d, w, a in zip(*(b.column(i).to_pylist() for i in range(3))):
                gone = None
                if a:
                    c = chosen(d, w)
                    got = [_unzip(x["data"], np.uint16, np.uint16, np.int64) for x in a]
                    count, ends, lows = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(3))
                    last = np.cumsum(count)
                    begin = np.r_[0, ends[:-1]]
                    begin[last - count] = 0
                    size = count[c.number]
                    of = np.repeat(np.arange(len(c.number)), size)
                    run = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat((last - count)[c.number], size)
                    hit = lows[run] < c.rank[c.doc[of]]
                    of, run = of[hit], run[hit]
                    diff = np.zeros(len(c.body) + 1, np.int32)
                    np.add.at(diff, c.first[of] + begin[run], 1)
                    np.add.at(diff, c.first[of] + ends[run] - 1 + length, -1)
                    gone = np.cumsum(diff[:-1]) > 0
                else:
                    c = Chunk(d, length)
                kept, spans, at = [], [], 0
                for n in c.sizes.tolist():
                    body = c.body[at : at + n]
                    if gone is None or not (g := gone[at : at + n]).any():
                        kept.append(body.tobytes())
                        spans.append([])
                    else:
                        edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
                        kept.append(body[~g].tobytes())
                        spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                    at += n
                ids = pa.array(c.ids, mask=~c.known)
                yield pa.RecordBatch.from_arrays([ids, pa.array(c.sizes), pa.array(kept, pa.binary()), pa.array(spans, schema.field("spans").type)], schema=schema)

    joined = table.join(wanted, "chunk_id", "left").join(answers, "chunk_id", "left").select("data", "wanted", "answers")
    return joined.mapInArrow(mark, f"`{id_col}` long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")


def kept_sha256(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
