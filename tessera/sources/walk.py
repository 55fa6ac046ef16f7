"""Listing a folder tree on the executors, level by level.

The folders still to be listed are a table. Every task lists its share and goes
on down by itself until it has met ``BUDGET`` entries; what it has not come to is
the next level's table, so a small tree is one job, a wide or deep one as many as
its depth asks for, and no listing passes through the driver. Folders that are
excluded are not entered. A folder that cannot be listed is a row of its own
(kind ``unreadable``, with the reason), so what lies below it counts as unknown
and not as gone. Links to folders are not followed.

Stores that Arrow's file systems don't reach are listed by Spark's own reader
(``files.py``), which tells nothing about folders it could not read.
"""

from __future__ import annotations

import fnmatch
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import delete, shared_folder

FILE, FOLDER, UNREADABLE = "file", "folder", "unreadable"
#: entries after which a task hands on the folders it has not come to
BUDGET = 5000
SCHEMA = "path string, kind string, size long, mtime_ns long, reason string"
_FIELDS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("reason", pa.string())])


def excluder(patterns: list[str]):
    """A test whether a glob fits a relative path or one of its parts, in any case; parents are tested when they are met."""
    if not patterns:
        return lambda path: False
    fits = re.compile("|".join(fnmatch.translate(p.lower()) for p in patterns)).match
    return lambda path: bool(fits(path.lower()) or fits(path.lower().rpartition("/")[2]))


def list_local(folder: str):
    """(name, is a folder, size, mtime_ns) of the entries of a folder on a local or mounted disk."""
    with os.scandir(folder) as entries:
        for e in sorted(entries, key=lambda e: e.name):
            try:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, None, None
                elif e.is_file():
                    s = e.stat()
                    yield e.name, False, s.st_size, s.st_mtime_ns
            except FileNotFoundError:  # gone since it was listed
                continue


def _rows(folders: list[str], root: str, skip, listing, budget: int):
    """Rows of some folders (relative) and of those below, as far as the budget goes."""
    met, waiting = 0, list(reversed(folders))
    while waiting:
        folder = waiting.pop()
        if met >= budget:
            yield folder, FOLDER, None, None, None  # for the next level
            continue
        try:
            for name, inner, size, mtime in listing(f"{root}/{folder}" if folder else root):
                met += 1
                path = f"{folder}/{name}" if folder else name
                if skip(path):
                    continue
                if inner:
                    waiting.append(path)
                else:
                    yield path, FILE, size, mtime, None
        except OSError as e:
            yield folder, UNREADABLE, None, None, f"{type(e).__name__}: {e.strerror or e}"


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that lies on a disk every executor mounts (scheme ``file``); None for other stores."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return (uri.getPath().rstrip("/") or "/") if uri.getScheme() == "file" else None


def walk(spark: SparkSession, root: str, patterns: list[str], listing=list_local, budget: int = BUDGET) -> DataFrame:
    """(path, kind, size, mtime_ns, reason): the files below ``root``, a local path, and the folders that could not be listed.

    The table is stored below the shared folder; :func:`forget` deletes it.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    store = f"{shared_folder(spark)}/tessera/walk-{uuid.uuid4().hex}"
    skip = excluder(patterns)
    tasks = spark.sparkContext.defaultParallelism

    def run(batches):
        # a task's share comes as one list, so the budget is the task's
        found = list(_rows([p for b in batches for p in b.column(0).to_pylist()], root, skip, listing, budget))
        for i in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[i : i + 10_000]), _FIELDS)], schema=_FIELDS)

    level, frontier = 0, spark.createDataFrame([("",)], "path string")
    while True:
        frontier.select("path").mapInArrow(run, SCHEMA).write.parquet(f"{store}/level={level}")
        met = spark.read.schema(SCHEMA).parquet(f"{store}/level={level}")
        left = met.where(F.col("kind") == FOLDER)
        if not left.limit(1).count():
            break
        level, frontier = level + 1, left.repartition(tasks, "path")
    out = spark.read.schema(SCHEMA).parquet(*[f"{store}/level={n}" for n in range(level + 1)]).where(F.col("kind") != FOLDER)
    out.walk_path = store
    return out


def forget(listing: DataFrame) -> None:
    delete(listing.sparkSession, listing.walk_path)


def read(rows: DataFrame, root: str, most: int, path_col: str = "path") -> DataFrame:
    """``rows`` with ``content``, the bytes of the file at a relative path below a local ``root``, and ``problem`` where there are none.

    A file of more than ``most`` bytes is not opened; one that cannot be read has a problem and counts as unknown.
    """
    names = rows.columns
    at = names.index(path_col)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):  # contents of few files are held at once
                part = b.slice(lo, 64)
                contents, problems = [], []
                for path in part.column(at).to_pylist():
                    try:
                        with open(f"{root}/{path}", "rb") as f:
                            raw = f.read(most + 1)
                        contents.append(raw if len(raw) <= most else None)
                        problems.append(None if len(raw) <= most else "too large")
                    except OSError as e:
                        contents.append(None)
                        problems.append(f"unreadable: {e.strerror or e}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary()), pa.array(problems, pa.string())], names=[*names, "content", "problem"])

    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("content", BinaryType()), StructField("problem", StringType())]))
