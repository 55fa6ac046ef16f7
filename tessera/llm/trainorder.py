"""Training-order materialisation of token-id sequences.

Documents are tokenised, each followed by a closing id, and dealt by a hash of
(id, text) into groups of about ``group_docs``; a group's documents, in order of
id and text hash, are one stream, cut into sequences of ``stride`` ids (the
last one padded). Groups, order and cuts follow from the data alone, so the
bytes are the same on any cluster and for any split into files. Tasks hold
ranges of groups, so a sequence's dense number is its task's base plus its
place. A keyed Feistel network with cycle-walking maps the number to a global
slot, a permutation that needs no table and can be inverted. Range partitions
by slot then write shards: ``per_shard`` records of exactly ``stride``
little-endian ids, so slot s starts at byte (s % per_shard) * stride * width of
shard s // per_shard, and a reader resumes anywhere by arithmetic.

Shards are written in ``waves`` of equal ranges, so that only a part of the
corpus is in flight besides the shards; each wave's manifest is stored, and a
file is written under a name of its own and then moved, so a repeated task or a
repeated wave leaves the same whole file.

Defined cases: a null or empty text is just the closing id; repeated rows are
written as rows of their own (rows equal in id and text are interchangeable); a
null id comes first; an empty table gives no shards; ids beyond 65,535 need
``width=4``; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise, new_folder, partitions
from .tokens import encode

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(key: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), key & ((1 << 64) - 1))]


def _walk(x: np.ndarray, n: int, key: int, forward: bool) -> np.ndarray:
    x = np.asarray(x, np.uint64).copy()
    if n <= 1:
        return x.astype(np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _keys(key)
    todo = np.arange(len(x))
    while len(todo):  # the domain is at most four times n: a walk takes less than four steps on average
        left, right = x[todo] >> half, x[todo] & mask
        for k in keys if forward else reversed(keys):
            if forward:
                left, right = right, left ^ (_mix(right, k) & mask)
            else:
                left, right = right ^ (_mix(left, k) & mask), left
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def slot_of(number, n: int, key: int) -> np.ndarray:
    """Slots of sequence numbers: a permutation of range(n)."""
    return _walk(number, n, key, True)


def number_of(slot, n: int, key: int) -> np.ndarray:
    """The inverse of :func:`slot_of`."""
    return _walk(slot, n, key, False)


def sequences(docs: DataFrame, stride: int, closing_id: int, width: int, id_col: str, text_col: str, group_docs: int) -> DataFrame:
    """(part, place, length, ids): the sequences; ``part`` numbers ranges of groups, ``place`` a range's sequences."""
    kind = np.dtype(f"<u{width}")
    tokens = pa.schema([("grp", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])
    schema = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def tokenise(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = []
                for t in part.column(3).to_pylist():
                    ids = encode(t)
                    if len(ids) and int(ids.max()) >> (8 * width):
                        raise ValueError("an id does not fit; use width=4")
                    rows.append(np.append(ids.astype(kind), kind.type(closing_id)).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rows, pa.binary())], schema=tokens)

    def cut(batches):
        part, place, size = TaskContext.get().partitionId(), 0, stride * width
        group, rest = None, b""

        def rows(raw: bytes, short: int = 0):
            n = len(raw) // size
            lengths = np.full(n, stride)
            if short:
                lengths[-1] = short
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(place, place + n)), pa.array(lengths), pa.array([raw[i * size : (i + 1) * size] for i in range(n)], pa.binary())], schema=schema)

        def last():
            return rows(rest + np.full((size - len(rest)) // width, closing_id, kind).tobytes(), len(rest) // width)

        for b in batches:
            groups = b.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]).tolist() + [len(groups)] if len(groups) else []
            for s, e in zip(edges, edges[1:]):
                if groups[s] != group:
                    if rest:
                        yield last()
                        place += 1
                    group, rest = groups[s], b""
                raw = b"".join([rest, *b.column(3).slice(s, e - s).to_pylist()])
                full = len(raw) // size * size
                if full:
                    yield rows(raw[:full])
                    place += full // size
                rest = raw[full:]
        if rest:
            yield last()

    total = docs.count()
    groups = max(1, -(-total // group_docs))
    tasks = max(1, min(groups, max(partitions(docs.sparkSession), 12)))
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    plain = plain.select(F.pmod(F.xxhash64(F.lit(11), "id", "key"), F.lit(groups)).alias("grp"), "id", "key", "text")
    # hashed groups are even, so equal ranges of them are known beforehand; no sampling pass
    dealt = plain.mapInArrow(tokenise, "grp long, id long, key long, ids binary").repartitionById(tasks, F.floor(F.col("grp") * tasks / groups).cast("int"))
    return dealt.sortWithinPartitions("grp", F.asc_nulls_first("id"), "key").mapInArrow(cut, "part long, place long, length long, ids binary")


def training_order(docs: DataFrame, folder: str | None = None, stride: int = 1024, per_shard: int = 4096, key: int = 7, closing_id: int = 50256, width: int = 2, id_col: str = "doc_id", text_col: str = "text", group_docs: int = 512, waves: int = 2) -> DataFrame:
    """Write the shards and return their manifest: (shard, path, first_slot, n_sequences, n_ids, stride_bytes, n_bytes, crc32).

    ``folder`` is a URI of a file system that all executors share; by default a
    new folder below the checkpoint folder. The shards there are the result.
    Executors write through Arrow's file systems: local and mounted folders, S3
    (also as s3a), GCS, Azure, and HDFS where libhdfs is installed; a view of
    file systems (viewfs) is resolved to what it links to.
    """
    if stride < 1 or per_shard < 1 or group_docs < 1 or waves < 1 or width not in (2, 4):
        raise ValueError("stride, per_shard, group_docs and waves must be positive, width 2 or 4")
    spark = docs.sparkSession
    folder = _resolved(spark, folder or new_folder(spark, "shards"))
    cut = materialise(sequences(docs, stride, closing_id, width, id_col, text_col, group_docs), "order-sequences")
    counts = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number for each shuffle partition
    base = np.cumsum([0] + [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)])
    n = int(base[-1])
    starts = spark.sparkContext.broadcast(base)
    slotted = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    shards = -(-n // per_shard)

    def number(low: int, high: int):
        def run(batches):
            for b in batches:
                slot = slot_of(starts.value[b.column(0).to_numpy()] + b.column(1).to_numpy(), n, key)
                shard = slot // per_shard
                own = pa.array((shard >= low) & (shard < high))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot), b.column(2), b.column(3)], schema=slotted).filter(own)

        return run

    out = pa.schema([("shard", pa.int64()), ("path", pa.string()), *((c, pa.int64()) for c in ("first_slot", "n_sequences", "n_ids", "stride_bytes", "n_bytes", "crc32"))])

    def write(batches):
        shard, first, sizes, ids = None, 0, 0, []

        def row():
            raw = b"".join(ids)
            path = write_shard(folder, shard, raw)
            values = (shard, path, first, len(ids), sizes, stride * width, len(raw), zlib.crc32(raw))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, out)], schema=out)

        for b in batches:
            for s, k, m, i in zip(*(b.column(c).to_pylist() for c in range(4))):
                if s != shard:
                    if ids:
                        yield row()
                    shard, first, sizes, ids = s, k, 0, []
                sizes += m
                ids.append(i)
        if ids:
            yield row()

    manifests = []
    each = max(1, -(-shards // waves))
    for low in range(0, shards, each):
        high = min(shards, low + each)
        tasks = max(1, min(high - low, max(partitions(spark), 12)))
        # slots are dense, so equal ranges of shards are known beforehand
        dealt = cut.mapInArrow(number(low, high), "shard long, slot long, length long, ids binary").repartitionById(tasks, F.floor((F.col("shard") - low) * tasks / (high - low)).cast("int"))
        written = dealt.sortWithinPartitions("slot").mapInArrow(write, "shard long, path string, first_slot long, n_sequences long, n_ids long, stride_bytes long, n_bytes long, crc32 long")
        manifests.append(materialise(written, "order-manifest"))
    drop(cut)
    _sweep(spark, folder)
    if not manifests:
        return spark.createDataFrame([], "shard long, path string, first_slot long, n_sequences long, n_ids long, stride_bytes long, n_bytes long, crc32 long")
    return reduce(DataFrame.unionByName, manifests)


#: how executors reach the stores that Hadoop names otherwise
ALIASES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def _uri(folder: str) -> str:
    """A folder as Arrow's file systems name it."""
    scheme, colon, rest = folder.partition("://")
    if folder.startswith("dbfs:/"):
        return f"file:///dbfs/{folder.removeprefix('dbfs:').lstrip('/')}"  # mounted on every worker
    if folder.startswith("file:/"):
        return f"file:///{folder.removeprefix('file:').lstrip('/')}"
    return f"{ALIASES.get(scheme, scheme)}://{rest}" if colon else folder


def _file(folder: str, shard: int):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(_uri(folder))
    return system, f"{path.rstrip('/')}/shard-{shard:08d}.bin"


def _resolved(spark, folder: str) -> str:
    """``folder`` as executors can name it: links of a view of file systems are followed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    return system.resolvePath(path).toString()


def _sweep(spark, folder: str) -> None:
    """Delete what attempts that were lost have left beside the shards."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard-*.bin.*")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(at) or []:
        system.delete(found.getPath(), False)


def write_shard(folder: str, shard: int, raw: bytes) -> str:
    """Write one shard as ``folder``/shard-NNNNNNNN.bin, whole or not at all; return its path.

    A repeated attempt finds the file of the one before it: equal bytes stay, others are replaced.
    """
    from pyarrow import fs

    system, path = _file(folder, shard)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(part) as f:
        f.write(raw)
    there = system.get_file_info(path)
    if there.type != fs.FileType.NotFound:  # not every store moves onto a file that exists
        with system.open_input_stream(path) as f:
            same = there.size == len(raw) and f.read() == raw
        if same:
            system.delete_file(part)
            return path
        system.delete_file(path)
    system.move(part, path)
    return path


def read_slots(folder: str, first: int, count: int, stride: int = 1024, per_shard: int = 4096, width: int = 2):
    """Sequences of the slots from ``first`` on, by sequential reads that may start anywhere."""
    size = stride * width
    end = first + count
    while first < end:
        system, path = _file(folder, first // per_shard)
        upto = min(end, (first // per_shard + 1) * per_shard)
        with system.open_input_file(path) as f:
            f.seek(first % per_shard * size)
            for _ in range(first, upto):
                raw = f.read(size)
                if len(raw) < size:
                    return
                yield np.frombuffer(raw, f"<u{width}")
        first = upto
