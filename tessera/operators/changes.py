"""Differences between what a source has and what a collection holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ("mtime", "size_bytes", "root_id", "folder", "ext")


def classify(current: DataFrame, stored: DataFrame, compare: tuple[str, ...] = ("content_hash",), touch: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, change): added, updated, touched (only file data differ), unchanged or stale."""
    a = current.select("doc_id", F.struct(*compare).alias("new"), F.struct(*(touch or compare)).alias("new_meta"))
    b = stored.select("doc_id", F.struct(*compare).alias("old"), F.struct(*(touch or compare)).alias("old_meta"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "stale")
        .when(~F.col("new").eqNullSafe(F.col("old")), "updated")
        .when(~F.col("new_meta").eqNullSafe(F.col("old_meta")), "touched")
        .otherwise("unchanged")
    )
    return a.join(b, "doc_id", "full_outer").select("doc_id", change.alias("change"))


def renames(added: DataFrame, stale: DataFrame) -> DataFrame:
    """(old_id, new_id): a stale document whose content reappears; the least new id is taken."""
    new = added.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("doc_id").alias("new_id"))
    return stale.join(new, "content_hash").select(F.col("doc_id").alias("old_id"), "new_id")


def carry_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows keyed by doc_id under their new ids; a row that the new id has already stays."""
    moved = rows.join(mapping.withColumnRenamed("old_id", "doc_id"), "doc_id", "left")
    moved = moved.withColumns({"own": F.col("new_id").isNull(), "from": F.col("doc_id"), "doc_id": F.coalesce("new_id", "doc_id")})
    order = Window.partitionBy("doc_id").orderBy(F.desc("own"), "from")
    return moved.withColumn("n", F.row_number().over(order)).where("n = 1").select(*rows.columns)


def upsert(base: DataFrame, new: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with rows replaced or added by key; columns in ``keep`` retain their first value."""
    for c in keep:
        old = base.select(key, F.col(c).alias("__old"))
        new = new.join(old, key, "left").withColumn(c, F.coalesce("__old", c)).drop("__old")
    return base.join(new.select(key), key, "left_anti").unionByName(new.select(*base.columns))


def update_metadata(documents: DataFrame, touched: DataFrame) -> DataFrame:
    """Take the file data of the touched documents, nulls included."""
    new = touched.select("doc_id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in META])
    joined = documents.join(new, "doc_id", "left")
    return joined.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in META}).select(*documents.columns)


def remove(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def below(rows: DataFrame, path: str, folders: DataFrame) -> DataFrame:
    """Those of ``rows`` whose path lies in or below one of ``folders`` (one column; the empty path is above all)."""
    parts = F.split(path, "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    at = folders.select(F.col(folders.columns[0]).alias("__above")).distinct()
    return rows.withColumn("__above", F.explode(above)).join(at, "__above", "left_semi").drop("__above").distinct()


def scan_changes(disk: DataFrame, stored: DataFrame, truncated: bool = False) -> DataFrame:
    """(path, change) from (path, mtime, size, content_hash): sizes and times first, hashes only where those differ.

    The hash of a file is compared only if its stat differs; a column that is
    not asked for is not read. Nothing counts as deleted in a truncated scan.
    """
    a, b = (d.select("path", *[F.col(c).alias(f"{p}_{c}") for c in ("mtime", "size", "content_hash")], F.lit(True).alias(p)) for d, p in ((disk, "d"), (stored, "s")))
    same_stat = F.col("d_mtime").eqNullSafe(F.col("s_mtime")) & F.col("d_size").eqNullSafe(F.col("s_size"))
    change = (
        F.when(F.col("s").isNull(), "new")
        .when(F.col("d").isNull(), F.lit(None if truncated else "deleted"))
        .when(same_stat | F.col("d_content_hash").eqNullSafe(F.col("s_content_hash")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (new, changed, deleted) from two snapshots (path, mtime_ns, size)."""
    a = before.select("path", F.struct("mtime_ns", "size").alias("b"))
    b = after.select("path", F.struct("mtime_ns", "size").alias("a"))
    both = a.join(b, "path", "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(count(F.col("b").isNull()).alias("new"), count(F.col("a") != F.col("b")).alias("changed"), count(F.col("a").isNull()).alias("deleted"))


def stable_polls(polls: DataFrame, key: str, poll: str, state: Column, needed: int = 2) -> DataFrame:
    """Debounce: polls (numbered) at which the state of a key changed earlier and has held for ``needed`` polls in a row."""
    w = Window.partitionBy(key).orderBy(poll)
    marked = polls.withColumn("__changed", (~state.eqNullSafe(F.lag(state).over(w))) & F.lag(F.lit(1)).over(w).isNotNull())
    marked = marked.withColumn("__run", F.sum(F.col("__changed").cast("int")).over(w))
    held = Window.partitionBy(key, "__run").orderBy(poll)
    return marked.withColumn("__held", F.row_number().over(held)).where((F.col("__run") > 0) & (F.col("__held") == needed)).drop("__changed", "__run", "__held")
