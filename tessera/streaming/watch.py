"""Keeping a collection in step with its folders by Structured Streaming.

A file source would deliver new files only, so the stream is that of
``source.py``: every trigger is a poll, whose changes are kept as state until
they have held for two polls; then the root is ingested. A root that suddenly
lost all its files is left alone, and failures back off. :meth:`AutoSync.tick`
does the same for callers without a stream, with the state in memory.
"""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..plans.ingest import ingest_folder
from ..plans.store import Collection
from ..sources.files import listed
from .source import VANISH_MIN, folder_changes, settled, watch_roots

STABLE_POLLS = 2
MAX_BACKOFF, MAX_INTERVAL = 300.0, 120.0


@dataclass
class RootState:
    """What the polls of a root have seen: (number of files, fingerprint) of listings, never the listings themselves."""

    synced: tuple = (0, None)
    last: tuple | None = None
    stable: int = 0
    failures: int = 0
    due: float = 0.0


def poll_interval(base: float, walk_seconds: float) -> float:
    """Large folders are polled less often: a walk takes at most a fortieth of the time."""
    return min(MAX_INTERVAL, max(base, 40 * walk_seconds))


def backoff(interval: float, failures: int) -> float:
    return min(MAX_BACKOFF, interval * 2**failures)


def vanished(before: int, after: int) -> bool:
    """A root of five files or more that has none left is more likely unmounted than emptied."""
    return before >= VANISH_MIN and after == 0


def fingerprint(listing: DataFrame) -> tuple:
    """(n, two sums): equal for equal listings, whatever their order; one row, however many files there are."""
    h = F.xxhash64("path", "mtime_ns", "size")
    return tuple(listing.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")).cast("string")).first())


class AutoSync:
    """Polls the roots of a collection; a manual job can hold it off."""

    def __init__(self, col: Collection, interval: float = 5.0, sync=ingest_folder, clock=time.monotonic):
        self.col, self.interval, self.sync, self.clock = col, interval, sync, clock
        self.states: dict[str, RootState] = {}
        self.log: list[tuple[str, str]] = []
        self.query = None
        self._busy = threading.RLock()

    def poll(self, root: str, exclude=()) -> str:
        """One poll of one root: unchanged, changing, synced, vanished or failed. Failures, also of the sync, back off."""
        state = self.states.setdefault(root, RootState())
        began = self.clock()
        try:
            with listed(self.col.spark, root, exclude) as found:
                now = fingerprint(found.where("kind = 'file'"))
            wait = poll_interval(self.interval, self.clock() - began)
            if vanished(state.synced[0], now[0]):
                return self._say(root, "vanished", wait)
            state.stable = state.stable + 1 if now == state.last else 1
            state.last = now
            if now == state.synced or (not now[0] and state.synced[1] is None):
                return self._say(root, "unchanged", wait)
            if state.stable < STABLE_POLLS:
                return self._say(root, "changing", self.interval)
            self.sync(self.col, root, exclude)
        except Exception:
            state.failures += 1
            return self._say(root, "failed", backoff(self.interval, state.failures))
        state.synced, state.failures = now, 0
        return self._say(root, "synced", wait)

    def _say(self, root: str, what: str, wait: float) -> str:
        self.states[root].due = self.clock() + wait
        self.log.append((root, what))
        return what

    def tick(self) -> list[str]:
        """Poll the roots that are due, unless a manual job holds the collection."""
        if not self._busy.acquire(blocking=False):
            return []
        try:
            due = [r for r in self.col.table("roots").where("not coalesce(files_only, false)").collect() if self.states.setdefault(r.path, RootState()).due <= self.clock()]
            return [self.poll(r.path, r.exclude or ()) for r in due]
        finally:
            self._busy.release()

    @contextmanager
    def preempt(self):
        """Hold polling off while a manual job runs; waits for a running poll to end."""
        with self._busy:
            yield self

    def _roots(self) -> dict[str, tuple]:
        return {r.path: tuple(r.exclude or ()) for r in self.col.table("roots").where("not coalesce(files_only, false)").collect()}

    def _act(self, events: DataFrame, _: int) -> None:
        """One poll's events, a few for each root: act on what has settled, and again on what failed when that is due."""
        with self._busy:  # a manual job goes first
            settled = {r.root: r.action for r in events.select("root", "action").collect()}
            self.log += [(r, what) for r, what in settled.items() if what != "sync"]
            failed = {x["root"]: x for x in self.col.preference("sync_failed", [])}
            roots, now = self._roots(), time.time()
            for root in sorted(roots.keys() & ({r for r, what in settled.items() if what == "sync"} | {r for r, x in failed.items() if x["due"] <= now})):
                try:
                    self.sync(self.col, root, roots[root])
                    failed.pop(root, None)
                    self.log.append((root, "synced"))
                except Exception:
                    times = failed.get(root, {}).get("times", 0) + 1
                    failed[root] = {"root": root, "times": times, "due": now + backoff(self.interval, times)}
                    self.log.append((root, "failed"))
            if list(failed.values()) != self.col.preference("sync_failed", []):
                self.col.set_preference("sync_failed", list(failed.values()))
            watch_roots(self.state, self._roots())

    def start(self) -> "AutoSync":
        """Poll at every trigger until stopped; the collection remembers that it is kept in step.

        Polls, snapshots and what waits live in the collection's folder, so a
        restart goes on where the last run ended.
        """
        if self.query is not None and self.query.isActive:
            return self
        if not self.col.preference("auto_sync", False):
            self.col.set_preference("auto_sync", True)
        where = self.col.path if "://" in self.col.path else f"file://{self.col.path}"
        self.state = f"{where}/sync/snapshots"
        watch_roots(self.state, self._roots())
        events = settled(folder_changes(self.col.spark, self.state), self.interval * (STABLE_POLLS - 1))
        stream = events.writeStream.outputMode("update").option("checkpointLocation", f"{where}/sync/checkpoint").foreachBatch(self._act)
        self.query = stream.trigger(processingTime=f"{self.interval} seconds").start()
        return self

    def stop(self, forget: bool = False) -> None:
        """Stop polling; with ``forget`` also the remembered preference."""
        if self.query is not None:
            self.query.stop()
            self.query = None
        if forget:
            self.col.set_preference("auto_sync", False)


def session_windows(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of users over a stream or a table of events (an extension; not part of the search engine proper)."""
    return events.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def tumbling(events: DataFrame, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def diff(spark: SparkSession, before: list, after: list) -> dict:
    """Numbers of new, changed and deleted paths between two collected snapshots of one folder."""
    schema = "path string, mtime_ns long, size long"
    return changes.diff_snapshots(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).first().asDict()
