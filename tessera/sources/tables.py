"""Physical layout of stored tables, and the folder for those a session makes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: bytes up to which a table may be dealt anew; beyond it has row groups enough to be split as it is
SMALL = 256 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that a job makes for itself.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset
    a temporary folder is made and set, but only under a local master (tests, a
    laptop): executors of a cluster would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def file_stamp(spark: SparkSession, path: str) -> str:
    """Paths, sizes and times of a table's files, as text; it changes whenever a file does. One listing, however many files there are."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    return re.sub(r"access_time=\d+", "", found)


def spread(table: DataFrame) -> DataFrame:
    """Deal a small table of fewer files than the cluster has cores over all of them.

    A file of one row group is one task however small the splits are, so text
    work on it would keep one core busy. Tables of many files, and large ones,
    stay as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL or len(table._jdf.inputFiles()) >= cores:
        return table
    return table.repartition(cores)


#: rows of ids up to which they are broadcast
FEW_IDS = 1 << 20


def small(ids: DataFrame, rows: int) -> DataFrame:
    """``ids``, of which there are ``rows``, to be broadcast if those are few."""
    return F.broadcast(ids) if rows <= FEW_IDS else ids


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for results whose sources are about to go."""
    path = f"{shared_folder(df.sparkSession)}/tessera/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on any file system Spark can reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
