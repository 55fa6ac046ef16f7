"""Changes of folders as a stream, and the state that says when to act on them.

``folder_changes`` is a streaming source whose offsets are polls and whose rows
are the files that are new, changed or deleted since the poll before. Each of
its partitions owns a share of every tree (by a hash of the first two parts of a
path), lists it on an executor, compares it with the share's stored snapshot
and stores the new one; a poll that is run again, after a lost task or a restart
from a checkpoint, finds its snapshot and gives the same rows. A folder that
cannot be listed is a row, and the files known below it stay.

``settled`` keeps a few numbers for each root in Spark's state store: how many
files it has, and whether a change waits. A timer for each root, set anew by every poll
with changes, fires when none has come for a while, so a folder being copied is
taken up once, after the copying, also if the query was restarted in between. A
root of some files that suddenly has none is reported and left alone.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from ..sources import walk
from ..sources.files import EXCLUDES, SUFFIXES, normalize_excludes

NEW, CHANGED, DELETED, UNREADABLE = "new", "changed", "deleted", "unreadable"
ROWS = "root string, path string, change string, size long, mtime_ns long, poll long"
VANISH_MIN = 5
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SNAPSHOT = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64())])


@dataclass
class Share(InputPartition):
    """One bucket of one root between two polls."""

    root: str
    exclude: tuple
    bucket: int
    start: int
    end: int


def bucket_of(path: str, buckets: int) -> int:
    """The share that owns a file, or everything below a folder two levels down."""
    return zlib.crc32("/".join(path.split("/")[:2]).encode("utf-8", "surrogatepass")) % buckets


def list_share(root: str, patterns: list[str], bucket: int, buckets: int, listing=walk.list_local):
    """(files by path, unreadable folders) of one share: the first level is listed by all, what lies deeper by its owner."""
    outside = walk.excluder(patterns)

    def skip(path: str) -> bool:
        return outside(path) or "/" in path and bucket_of(path, buckets) != bucket

    files, closed = {}, []
    for path, kind, size, mtime, _ in walk._rows([""], root, skip, listing, float("inf")):
        if kind == walk.UNREADABLE:
            closed.append(path)
        elif path.lower().endswith(SUFFIXES) and bucket_of(path, buckets) == bucket:
            files[path] = (size, mtime)
    return files, closed


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes")``; options: ``state`` (a folder that executors share) and ``buckets``.

    ``state`` holds ``roots.json``, folders and the patterns left out of each,
    which every poll reads anew, and the snapshots.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> "FolderReader":
        return FolderReader(self.options)


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.state, self.buckets = options["state"], int(options.get("buckets", 16))
        self.listing = walk.list_local

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": time.time_ns() // 1_000_000}  # later than any poll before a restart

    def partitions(self, start: dict, end: dict) -> list[Share]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.state)
        with system.open_input_stream(f"{at}/roots.json") as f:
            roots = json.loads(f.read())
        return [Share(r, tuple(p), b, start["poll"], end["poll"]) for r, p in roots.items() for b in range(self.buckets)]

    def _file(self, share: Share, poll: int):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.state)
        return system, f"{at}/{zlib.crc32(share.root.encode()):08x}-{share.bucket}-{poll}.parquet"

    def _load(self, share: Share, poll: int) -> dict | None:
        import pyarrow.parquet as pq

        system, path = self._file(share, poll)
        try:
            rows = pq.read_table(path, filesystem=system).to_pydict()
        except FileNotFoundError:
            return None
        return dict(zip(rows["path"], zip(rows["size"], rows["mtime_ns"])))

    def _store(self, share: Share, files: dict) -> None:
        import pyarrow.parquet as pq

        system, path = self._file(share, share.end)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{os.getpid()}-{time.time_ns()}"
        rows = [(p, *v) for p, v in sorted(files.items())]
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _SNAPSHOT)], schema=_SNAPSHOT), part, filesystem=system)
        system.move(part, path)

    def read(self, share: Share):
        before = (self._load(share, share.start) if share.start else None) or {}
        after, closed = self._load(share, share.end), []
        if after is None:
            patterns = [*EXCLUDES, *normalize_excludes(share.exclude)]
            after, closed = list_share(share.root, patterns, share.bucket, self.buckets, self.listing)
            for folder in closed:
                after |= {p: v for p, v in before.items() if p not in after and (not folder or p.startswith(folder + "/"))}
            self._store(share, after)
        for folder in closed:
            yield share.root, folder, UNREADABLE, None, None, share.end
        for path in before.keys() | after.keys():
            old, new = before.get(path), after.get(path)
            if old != new:
                yield share.root, path, NEW if old is None else DELETED if new is None else CHANGED, *(new or old), share.end

    def commit(self, end: dict) -> None:
        """Snapshots of polls before the committed one go."""
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.state)
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            poll = f.base_name.removesuffix(".parquet").rpartition("-")[2]
            if f.base_name.endswith(".parquet") and poll.isdigit() and int(poll) < end["poll"]:
                system.delete_file(f.path)

    def stop(self) -> None:
        pass


def watch_roots(state: str, roots: dict[str, tuple]) -> None:
    """Say which local folders the polls from now on look at, and which patterns are left out of each."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(state)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/roots.json.part") as f:
        f.write(json.dumps({r: list(p) for r, p in roots.items()}).encode())
    system.move(f"{at}/roots.json.part", f"{at}/roots.json")


def folder_changes(spark: SparkSession, state: str, buckets: int = 16) -> DataFrame:
    """A stream of ROWS for the folders that :func:`watch_roots` has named in ``state``, a folder that executors share."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("state", state).option("buckets", buckets).load()


class Settle(StatefulProcessor):
    """Per root: the number of files, and whether a change waits for its timer."""

    def __init__(self, hold_ms: int, vanish_min: int):
        self.hold_ms, self.vanish_min = hold_ms, vanish_min

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "files long, waiting boolean, poll long")

    def _set(self, now: int) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(now + self.hold_ms)

    def handleInputRows(self, key, rows, timerValues):
        files, _, _ = self.held.get() if self.held.exists() else (0, False, 0)
        more = less = other = poll = 0
        for part in rows:  # counted as they come, never held together
            n = part["change"].value_counts()
            more, less, other = more + int(n.get(NEW, 0)), less + int(n.get(DELETED, 0)), other + int(n.get(CHANGED, 0))
            poll = max(poll, int(part["poll"].max()))
        now, gone = files + more - less, files >= self.vanish_min and files + more == less
        if more or less or other:
            self.held.update((int(now), not gone, poll))
            if not gone:
                self._set(timerValues.getCurrentProcessingTimeInMs())
            yield pd.DataFrame({"root": [key[0]], "action": ["vanished" if gone else "changing"], "files": [int(now)], "poll": [poll]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        files, waiting, poll = self.held.get() if self.held.exists() else (0, False, 0)
        if waiting:
            self.held.update((files, False, poll))
            yield pd.DataFrame({"root": [key[0]], "action": ["sync"], "files": [files], "poll": [poll]})

    def close(self) -> None:
        pass


def settled(changes: DataFrame, hold_seconds: float, vanish_min: int = VANISH_MIN) -> DataFrame:
    """(root, action, files, poll): ``changing`` for a poll with changes, ``sync`` when none followed for ``hold_seconds``, ``vanished`` for a root that lost all its files."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = "root string, action string, files long, poll long"
    rows = changes.where(F.col("change") != UNREADABLE).select("root", "change", "poll")
    return rows.groupBy("root").transformWithStateInPandas(Settle(int(hold_seconds * 1000), vanish_min), out, "Update", "ProcessingTime")
