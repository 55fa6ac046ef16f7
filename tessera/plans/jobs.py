"""Background jobs: one writer for each collection, cancellable by Spark job tags."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from ..errors import ConflictError, UsageError
from .ingest import ingest
from .store import Collection

KEPT = 100


class JobManager:
    """Runs ingest and rebuild jobs in threads; their states are plain dicts."""

    def __init__(self):
        self._jobs: dict[str, dict] = {}
        self._threads: dict[str, threading.Thread] = {}
        self._lock = threading.Lock()

    def start(self, col: Collection, kind: str, work: Callable[[], dict]) -> dict:
        with self._lock:
            if self.active_for(col.path):
                raise ConflictError(f"a job is running on {col.path}")
            job = {"id": uuid.uuid4().hex[:12], "kind": kind, "collection": col.path, "status": "running", "started_at": time.time(), "finished_at": None, "result": None, "error": None}
            self._jobs[job["id"]] = job
            for old in [j for j in self._jobs.values() if j["status"] != "running"][:-KEPT]:
                self._jobs.pop(old["id"])
        sc = col.spark.sparkContext

        def run() -> None:
            sc.addJobTag(job["id"])
            try:
                job["result"] = work()
                done = "finished"
            except Exception as e:
                done, job["error"] = ("cancelled" if job["status"] == "cancelling" else "failed"), str(e)[:500]
            job["finished_at"], job["status"] = time.time(), done

        self._threads[job["id"]] = threading.Thread(target=run, daemon=True)
        self._threads[job["id"]].start()
        return job

    def start_index(self, col: Collection, path: str, exclude=(), prune: bool = True) -> dict:
        return self.start(col, "index", lambda: ingest(col, path, exclude, prune))

    def start_rebuild(self, col: Collection, chunking) -> dict:
        return self.start(col, "rebuild", lambda: {"version": col.rebuild_passages(chunking)["version"]})

    def get(self, job_id: str) -> dict:
        if job_id not in self._jobs:
            raise UsageError(f"no job {job_id!r}")
        return self._jobs[job_id]

    def list(self) -> list[dict]:
        return sorted(self._jobs.values(), key=lambda j: -j["started_at"])

    def active_for(self, path: str) -> dict | None:
        return next((j for j in self._jobs.values() if j["collection"] == path and j["status"] in ("running", "cancelling")), None)

    def cancel(self, job_id: str, col: Collection) -> dict:
        """Stop the job's Spark jobs; the collection stays at the version it had."""
        job = self.get(job_id)
        if job["status"] == "running":
            job["status"] = "cancelling"
            col.spark.sparkContext.cancelJobsWithTag(job_id)
        return job

    def wait(self, job_id: str, timeout: float | None = None) -> dict:
        self.get(job_id)
        self._threads[job_id].join(timeout)
        return self._jobs[job_id]

    def shutdown(self, col: Collection) -> None:
        for j in self.list():
            self.cancel(j["id"], col)
            self.wait(j["id"], 30)
