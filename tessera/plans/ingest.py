"""Incremental ingest of folders, single files and JSON-lines files into a collection.

A run compares what it reads with what is stored, puts all tables that change
together and publishes them as one version: a run that fails or is cancelled
leaves the collection, its roots and its log as they were.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..errors import ConflictError
from ..operators import analytics, changes
from ..sources import files
from ..sources.tables import keep
from .store import Collection, Delta

RUNS_KEPT = 200
#: a run says that it lives every so many seconds; one that has not for longer than ``LEASE`` was lost
HEARTBEAT, LEASE = 20.0, 120.0


@contextmanager
def running(col: Collection, root_path: str):
    """Hold the collection's lease for a run; yields the row of a run that was lost before, or None.

    The lease is a file that says which run it is and is written again while
    the run lives, so another writer is refused while it does and closes its
    record when it no longer does.
    """
    lease, stop = f"{col.path}/run.json", threading.Event()
    mine = {"root_path": root_path, "started_at": time.time(), "token": uuid.uuid4().hex}
    lost = None
    if col.files.exists(lease):
        if col.files.age(lease) < LEASE:
            raise ConflictError(f"another run is writing {col.path}")
        lost = json.loads(col.files.read(lease))
        col.files.delete(lease)
    try:
        col.files.create(lease, json.dumps(mine))
    except Exception as e:
        raise ConflictError(f"another run is writing {col.path}") from e

    def beat():
        while not stop.wait(HEARTBEAT):
            col.files.write(lease, json.dumps(mine))

    beats = threading.Thread(target=beat, daemon=True)
    beats.start()
    try:
        yield lost
    finally:
        stop.set()
        beats.join()
        if col.files.exists(lease) and json.loads(col.files.read(lease))["token"] == mine["token"]:
            col.files.delete(lease)


def _runs(col: Collection, run: dict, lost: dict | None) -> DataFrame:
    """The log with a run, and with the one that was lost before it."""
    first = (col.table("runs").agg(F.max("id")).first()[0] or 0) + 1
    rows = []
    if lost:
        rows.append({"id": first, "root_path": lost["root_path"], "started_at": dt.datetime.fromtimestamp(lost["started_at"]), "status": "interrupted", "error": "the run ended without a word"})
    rows.append({**run, "id": first + len(rows)})
    schema = schemas.TABLES["runs"]
    new = col.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    return analytics.keep_newest(col.table("runs").unionByName(new), RUNS_KEPT)


def _qualified(docs: DataFrame, col: Collection, root_ids: list[int]) -> DataFrame:
    """An id that another root's document has gets this root's number before it; ``root_ids`` are this root and those it takes over."""
    others = col.table("documents").where(~F.col("root_id").isin(root_ids)).select("doc_id", F.lit(True).alias("__taken"))
    named = docs.join(others, "doc_id", "left")
    return named.withColumn("doc_id", F.when(F.col("__taken"), F.concat(F.lit(f"~{root_ids[0]}/"), "doc_id")).otherwise(F.col("doc_id"))).drop("__taken")


def _apply(col: Collection, current: DataFrame, stored: DataFrame, compare: tuple[str, ...], prune: bool, root_path: str, roots: DataFrame | None = None, adopted: DataFrame | None = None) -> dict:
    """Compare, gather what differs, what is gone and the user's rows under new names, log the run; publish once.

    ``roots``: the roots, if this run changes them; ``adopted``: documents taken
    over from nested roots, as they are to be. ``current`` and the differences
    are written once beside the tables, as each is read several times.
    """
    with running(col, root_path) as lost:
        return _run(col, current, stored, compare, prune, root_path, roots, adopted, lost)


def _run(col: Collection, current: DataFrame, stored: DataFrame, compare: tuple[str, ...], prune: bool, root_path: str, roots: DataFrame | None, adopted: DataFrame | None, lost: dict | None) -> dict:
    started = dt.datetime.now()
    current = col.stage(current)
    diff = col.stage(changes.classify(current.where("skip is null"), stored, compare, changes.META))
    good, skipped = current.where("skip is null").drop("skip"), current.where("skip is not null")
    try:
        counts = dict(diff.groupBy("change").count().collect())
        which = lambda *kinds: diff.where(F.col("change").isin(*kinds)).select("doc_id")
        skips = dict(skipped.groupBy("skip").count().collect())  # one row for each reason
        # what cannot be read now, or lies below a folder that cannot, is unknown and not gone
        gone = which("stale").join(skipped.select("doc_id"), "doc_id", "left_anti")
        if "unreadable folder" in skips or "truncated" in skips:
            closed = skipped.where("skip in ('unreadable folder', 'truncated')").select("doc_id")
            gone = gone.join(changes.below(stored.join(gone, "doc_id", "left_semi"), "source", closed), "doc_id", "left_anti")
        removed = gone.count() if prune and counts.get("stale") else 0
        fresh = good.join(which("added", "updated"), "doc_id", "left_semi")
        tables: dict[str, DataFrame | Delta] = {} if roots is None else {"roots": roots}
        rows, buried = [], []
        if counts.get("added") or counts.get("updated"):
            tables |= col.with_documents(fresh)
            rows.append(tables["documents"].rows)
            buried.append(which("updated"))
        if counts.get("touched"):
            touched = good.join(which("touched"), "doc_id", "left_semi")
            rows.append(changes.update_metadata(stored.join(touched.select("doc_id"), "doc_id", "left_semi"), touched))
            buried.append(which("touched"))
        if adopted is not None:
            rows.append(adopted.join(which("added", "updated", "touched"), "doc_id", "left_anti"))
            buried.append(adopted.select("doc_id"))
        if rows:
            tables["documents"] = Delta(reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, buried))
        if removed:
            added = fresh.join(which("added"), "doc_id", "left_semi")
            moved = changes.renames(added, stored.join(gone, "doc_id", "left_semi"))
            tables |= {t: changes.carry_rows(col.table(t), moved) for t in ("bookmarks", "activity") if t in col.manifest["tables"]}
            tables = col.without_documents(gone, tables)
        out = {k: counts.get(k, 0) for k in ("added", "updated", "touched", "unchanged")} | {"removed": removed, "skipped": sum(n for what, n in skips.items() if what != "truncated")}
        out |= {"unreadable": skips["unreadable folder"]} if "unreadable folder" in skips else {}
        out |= {"truncated": True} if "truncated" in skips else {}
        run = {"root_path": root_path, "started_at": started, "finished_at": dt.datetime.now(), "status": "ok", "added": out["added"], "updated": out["updated"]}
        run |= {"unchanged": out["unchanged"] + out["touched"], "removed": removed, "skipped": out["skipped"]}
        tables["runs"] = _runs(col, run, lost)
        col.publish(tables)
    finally:
        col.unstage(current, diff)
    col.settle()
    return out


def _below(path: str, folder: str) -> str | None:
    """The way from a folder to a path below it; None if it isn't."""
    folder = folder.rstrip("/") + "/"
    return path[len(folder) :] if path.startswith(folder) else None


def place(col: Collection, path: str) -> tuple[str, str]:
    """(root, way below it) of a folder: the nearest registered root that holds it, else itself."""
    path = path.rstrip("/")
    above = [r.path for r in col.table("roots").where("not coalesce(files_only, false)").collect() if _below(path, r.path) is not None]
    root = max(above, key=len, default=path)
    return root, _below(path, root) or ""


def ingest_folder(col: Collection, folder: str, exclude=(), prune: bool = True, limit: int | None = None) -> dict:
    """Bring a folder's documents up to date; returns the numbers of each change.

    A folder inside a registered root is a part of that root, and only that part
    is compared. A root inside a new folder is taken over by it. A listing cut
    at ``limit`` files (the result says ``truncated``) removes nothing.
    """
    root_path, way = place(col, folder)
    known = {r.path: r for r in col.table("roots").collect()}
    root, roots = col.with_root(root_path, exclude)
    excludes = [*exclude, *((known[root_path].exclude or ()) if root_path in known else ())]
    nested = [] if way or root_path in known else [(r.root_id, inside) for r in known.values() if (inside := _below(r.path, root_path)) is not None]
    adopted = reduce(DataFrame.unionByName, [col.adopted(child, root, inside) for child, inside in nested]) if nested else None
    roots = col.table("roots") if roots is None else roots
    done = F.when(F.col("root_id") == root, F.current_timestamp()).otherwise(F.col("last_indexed_at"))
    roots = roots.where(~F.col("root_id").isin([c for c, _ in nested])).withColumn("last_indexed_at", done)
    stored = col.table("documents").where(F.col("root_id") == root)
    stored = stored if adopted is None else stored.unionByName(adopted)
    if way:
        stored = stored.where((F.col("source") == way) | F.startswith("source", F.lit(way + "/")))
    with files.listed(col.spark, folder, excludes) as listing:
        found = files.read_listed(listing, folder, root, limit, way)
        current = _qualified(files.tagged(found), col, [root, *(c for c, _ in nested)]).withColumn("root_id", F.lit(root).cast("long"))
        return _apply(col, current, stored, ("content_hash",), prune, folder, roots, adopted)


def ingest_file(col: Collection, path: str) -> dict:
    """Add or update the document of one file; it belongs to the root that holds it, else to its folder as a root of single files."""
    folder, _, name = path.rstrip("/").rpartition("/")
    root_path, way = place(col, folder)
    covered = root_path in {r.path for r in col.table("roots").collect()}
    root, roots = col.with_root(root_path, (), files_only=not covered)
    current = _qualified(files.tagged(files.read_listed(files.one_file(col.spark, path), folder, root, None, way)), col, [root]).withColumn("root_id", F.lit(root).cast("long"))
    stored = col.table("documents").where((F.col("root_id") == root) & (F.col("source") == (f"{way}/{name}" if way else name)))
    return _apply(col, current, stored, ("content_hash",), False, path, roots)


def ingest_jsonl(col: Collection, path: str) -> dict:
    """Add or update the documents of a JSON-lines file; never removes any."""
    current = files.refuse_repeats(files.read_jsonl(col.spark, path))
    stored = col.table("documents").join(current.select("doc_id"), "doc_id", "left_semi")
    return _apply(col, current, stored, ("content_hash", "title", "source", "meta"), False, path)


def ingest(col: Collection, path: str, exclude=(), prune: bool = True) -> dict:
    """A JSON-lines file, a single file or a folder."""
    if path.endswith(".jsonl"):
        return ingest_jsonl(col, path)
    return ingest_file(col, path) if files.is_file(col.spark, path) else ingest_folder(col, path, exclude, prune)


def scan_changes(col: Collection, root_id: int) -> DataFrame:
    """(path, change) between a root's folder and the collection: a listing first; only files whose size or time differ are read and hashed.

    Files below a folder that could not be listed are unknown: they have no row.
    """
    root = col.table("roots").where(F.col("root_id") == root_id).first()
    stored = col.table("documents").where(F.col("root_id") == root_id).select(F.col("source").alias("path"), "mtime", F.col("size_bytes").alias("size"), "content_hash")
    with files.listed(col.spark, root.path, root.exclude or ()) as listing:
        listed = listing.where("kind = 'file'").select("path", (F.col("mtime_ns") / 1e9).alias("mtime"), "size")
        near = (F.abs(F.col("mtime") - F.col("s.mtime")) < 1e-6) & (F.col("size") == F.col("s.size"))
        met = listed.join(stored.select("path", F.struct("mtime", "size").alias("s")), "path", "left")
        hashes = files.hashes(met.where(F.col("s").isNotNull() & ~F.coalesce(near, F.lit(False))), root.path)
        disk = met.join(hashes, "path", "left").select("path", F.when(near, F.col("s.mtime")).otherwise(F.col("mtime")).alias("mtime"), "size", "content_hash")
        found = changes.scan_changes(disk, stored)
        hidden = changes.below(found.where("change = 'deleted'"), "path", listing.where("kind = 'unreadable'").select("path"))
        return keep(found.join(hidden.select("path"), "path", "left_anti"))


def scan_all(col: Collection) -> DataFrame:
    """(root_id, root, path, change) of every registered folder; a folder that is not there has one row, ``missing``, and no changes."""
    out = col.spark.createDataFrame([], "root_id long, root string, path string, change string")
    for r in col.table("roots").where("not coalesce(files_only, false)").orderBy("root_id").collect():  # one row for each registered folder
        if files.is_folder(col.spark, r.path):
            found = scan_changes(col, r.root_id)
        else:
            found = col.spark.createDataFrame([(None, "missing")], "path string, change string")
        out = out.unionByName(found.select(F.lit(r.root_id).cast("long").alias("root_id"), F.lit(r.path).alias("root"), "path", "change"))
    return out


def empty_documents(col: Collection) -> DataFrame:
    return col.spark.createDataFrame([], schemas.DOCUMENTS)
