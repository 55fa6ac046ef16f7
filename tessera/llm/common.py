"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import shared_folder

#: Spark then deletes the shuffle files of an action when the action ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | None):
    """A session setting for the actions in here; none changes nothing."""
    if value is None:
        yield
        return
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation. The
    shuffle files of the writing go when it is done. ``batch_rows``: how many
    rows of the plan, where they are large, go to a Python worker at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with _setting(spark, CLEANUP, "true"), _setting(spark, BATCH_ROWS, batch_rows and str(batch_rows)):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "tessera_path", None)
        if path:
            jvm = table.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (nulls as 0) and the mask of nulls of an integer column."""
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), nulls


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def masked(values: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.array(values, mask=nulls)


def cell_runs(batches, limit: int):
    """(columns, whole): arrays of rows sorted by the first column, cut between its values (cells).

    ``whole`` says that no cell goes on elsewhere. A cell that goes over a
    batch's end is held until its end or ``limit`` rows; beyond, its rows come
    in pieces of their own as they are read, so no cell is ever held together.
    """
    held: list[list[np.ndarray]] = []  # the open cell, column by column in pieces
    n, open_cell, large = 0, None, False
    for b in batches:
        got = [b.column(k).to_numpy() for k in range(b.num_columns)]
        c = got[0]
        if not len(c):
            continue
        if (c[1:] < c[:-1]).any() or open_cell is not None and c[0] < open_cell:
            raise ValueError("the rows are not sorted by cell")
        if open_cell is not None and large:
            same = int(np.searchsorted(c, open_cell, "right"))
            if same:
                yield [x[:same] for x in got], False
            got, c = [x[same:] for x in got], c[same:]
            if not len(c):
                continue
            open_cell, large = None, False
        cut = int(np.searchsorted(c, c[-1])) if open_cell is None or c[-1] != open_cell else 0
        if cut or (held and c[0] != open_cell):
            whole = [np.concatenate([*(h[k] for h in held), x[:cut]]) for k, x in enumerate(got)]
            if len(whole[0]):
                yield whole, True
            held, n = [], 0
        held.append([x[cut:] for x in got])
        n, open_cell = n + len(c) - cut, c[-1]
        if n > limit:
            yield [np.concatenate([h[k] for h in held]) for k in range(len(got))], False
            held, n, large = [], 0, True
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))], True
