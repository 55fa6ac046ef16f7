"""Versioned collections: immutable segments of tables behind one manifest.

A table is a list of segments and a list of burials. A change to n documents
writes a segment of their new rows and one of the ids whose earlier rows are
buried by them, so it writes in proportion to n, whatever the collection holds.
Every row bears the version that wrote it; a burial of version v hides rows of
its ids from before v. Segments of like size are merged as they pile up, and
all of a table when burials are many, so a reader never meets more than a few.

Every change then swaps the manifest, so readers see one consistent version, a
failed run leaves the old one in place, and a backup is a copy of what a
manifest names. The swap is short: under a lock file it compares the version it
started from and renames a new manifest over the old one, so there is a whole
manifest at any moment. A lock left by a killed writer expires.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import schemas
from ..errors import ConflictError, DataError, UsageError
from ..functions.passages import chunking_of, chunking_text, normalize_chunking, with_passages
from ..functions.vectors import compose_embed_text, embed
from ..operators import analytics, changes, lexical, postings
from ..sources.tables import small
from .search import Corpus

SCHEMA_VERSION = 2
KEYED = ("passages", "postings", "doc_stats", "vectors", "bookmarks", "activity")
#: segments of like size (within this factor) that are merged into one
FAN = 8
#: shares in which documents are split anew
REBUILD_BUCKETS = 8
#: share of the documents that may be buried before a table is written anew
BURIED_SHARE = 0.25
#: seconds after which a lock is taken to be left by a writer that died; a swap takes far less
LOCK_SECONDS = 300
#: bytes a file of a compacted table should have
FILE_BYTES = 128 << 20


class Files:
    """The few file operations a manifest needs, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file; an error if there is one."""
        fs, p = self._at(path)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def write(self, path: str, text: str) -> None:
        """Put a whole file in the place of the old one, by one rename."""
        part = f"{path}.{uuid.uuid4().hex}"
        self.create(part, text)
        fs_package = self.spark._jvm.org.apache.hadoop.fs
        kind = getattr(fs_package, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        _, old = self._at(part)
        _, new = self._at(path)
        fs_package.FileContext.getFileContext(new.toUri(), self.conf).rename(old, new, options)

    def rename(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        if not fs.rename(p, self._at(target)[1]):
            raise DataError(f"could not rename {source} to {target}")

    def age(self, path: str) -> float:
        """Seconds since a file was written."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        other, q = self._at(target)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, True, self.conf)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


@dataclass
class Delta:
    """A change to a table: rows that come, and ids (doc_id) whose earlier rows go."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Collection:
    """One corpus: its documents, index, vectors and the user's rows."""

    def __init__(self, spark: SparkSession, path: str, embedder=None):
        self.spark, self.path, self.files, self.embedder = spark, path.rstrip("/"), Files(spark), embedder
        self._manifest = f"{self.path}/manifest.json"

    # -- manifest ----------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str = "", chunking=None, tokenizer: str = "porter", embedder=None) -> "Collection":
        self = cls(spark, path, embedder)
        if self.files.exists(self._manifest):
            raise UsageError(f"a collection exists at {path}")
        state = {"schema_version": SCHEMA_VERSION, "version": 0, "name": name, "tokenizer": tokenizer, "chunking": chunking_text(normalize_chunking(chunking)), "created_at": time.time(), "tables": {}}
        if embedder is not None:
            state["model"] = self._model(embedder)
        self.files.write(self._manifest, json.dumps(state))
        return self

    def preference(self, name: str, default=None):
        """A setting kept with the collection, such as whether it keeps itself in step with its folders."""
        return self.manifest.get("preferences", {}).get(name, default)

    def set_preference(self, name: str, value) -> dict:
        return self.publish({}, preferences={**self.manifest.get("preferences", {}), name: value})

    @staticmethod
    def _model(e) -> dict:
        return {"name": e.name, "revision": e.revision, "dimension": e.dimension}

    @property
    def manifest(self) -> dict:
        if not self.files.exists(self._manifest):
            raise DataError(f"no collection at {self.path}")
        state = json.loads(self.files.read(self._manifest))
        if state.get("schema_version") != SCHEMA_VERSION:
            raise DataError(f"schema version {state.get('schema_version')!r} is not supported")
        return state

    @contextmanager
    def _swapping(self):
        """Hold the lock; yields a check that it is still ours."""
        lock, mine = f"{self.path}/.lock", uuid.uuid4().hex
        for last in (False, True):
            try:
                self.files.create(lock, mine)
                break
            except Exception as e:
                if last or not self.files.exists(lock) or self.files.age(lock) < LOCK_SECONDS:
                    raise ConflictError(f"another writer holds {self.path}") from e
                self.files.delete(lock)
        ours = lambda: self.files.exists(lock) and self.files.read(lock) == mine
        try:
            yield ours
        finally:
            if ours():
                self.files.delete(lock)

    def table(self, name: str) -> DataFrame:
        """The live rows of a table."""
        return self._live(name, self.manifest["tables"].get(name))

    def _live(self, name: str, entry: dict | None, only: list[dict] | None = None) -> DataFrame:
        schema = schemas.TABLES[name]
        segments = entry["segments"] if entry and only is None else only
        if not segments:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{s['path']}" for s in segments]
        if name == "postings":
            return postings.Postings(self.spark, paths, buried=self._buried(entry)).postings()
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("segment", LongType())])).parquet(*paths)
        buried = self._buried(entry, min(s["version"] for s in segments))
        if buried is None:
            return rows.drop("segment")
        return rows.join(buried, "doc_id", "left").where("since is null or segment >= since").drop("since", "segment")

    def _buried(self, entry: dict | None, oldest: int = 0) -> DataFrame | None:
        """(doc_id, since): ids and the last version that buried them, as far as it hides rows from ``oldest`` on; None if there is none."""
        burials = [b for b in entry["buried"] if b["version"] > oldest] if entry else []
        if not burials:
            return None
        ids = self.spark.read.schema("doc_id string, since long").parquet(*[f"{self.path}/{b['path']}" for b in burials])
        return small(ids.groupBy("doc_id").agg(F.max("since").alias("since")), sum(b["rows"] for b in burials))

    def _write_segment(self, name: str, df: DataFrame, version: int) -> dict:
        where = f"tables/{name}/v{version}-{uuid.uuid4().hex[:8]}"
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]])
        if name == "postings":
            postings.write(df, f"{self.path}/{where}", version)
        else:
            df.withColumn("segment", F.lit(version).cast("long")).write.parquet(f"{self.path}/{where}")
        return {"path": where, "version": version, "bytes": self.files.size(f"{self.path}/{where}")}

    def _write_burial(self, ids: DataFrame, version: int) -> dict:
        where = f"tables/buried/v{version}-{uuid.uuid4().hex[:8]}"
        ids.select("doc_id").distinct().select("doc_id", F.lit(version).cast("long").alias("since")).write.parquet(f"{self.path}/{where}")
        return {"path": where, "version": version, "rows": self.spark.read.parquet(f"{self.path}/{where}").count()}

    def publish(self, tables: dict[str, DataFrame | Delta], merged: dict[str, list[dict]] | None = None, **keys) -> dict:
        """Write what is new and, once all of it is whole, swap the manifest.

        A table is replaced by a DataFrame and changed by a :class:`Delta`.
        ``merged``: segments of tables to be written as one.
        """
        before = self.manifest
        version = before["version"] + 1
        state = {**before, **keys, "version": version, "tables": {t: {k: list(v) for k, v in e.items()} for t, e in before["tables"].items()}}
        written: list[str] = []
        burials: dict[int, dict] = {}  # several tables bury the same ids: one file

        def note(made: dict) -> dict:
            written.append(made["path"])
            return made

        try:
            for name, change in tables.items():
                if isinstance(change, DataFrame):
                    state["tables"][name] = {"segments": [note(self._write_segment(name, change, version))], "buried": []}
                    continue
                entry = state["tables"].setdefault(name, {"segments": [], "buried": []})
                if change.gone is not None and entry["segments"]:
                    made = burials.get(id(change.gone)) or note(self._write_burial(change.gone, version))
                    burials[id(change.gone)] = made
                    if made["rows"]:
                        entry["buried"].append(made)
                if change.rows is not None:
                    entry["segments"].append(note(self._write_segment(name, change.rows, version)))
            for name, segments in (merged or {}).items():
                entry = state["tables"][name]
                kept = [s for s in entry["segments"] if s not in segments]
                made = note(self._write_segment(name, self._live(name, entry, segments), version))
                state["tables"][name] = {"segments": [*kept, made], "buried": entry["buried"] if kept else []}
            if "doc_stats" in tables:
                n, total = self._live("doc_stats", state["tables"]["doc_stats"]).agg(F.count("*"), F.sum("len")).first()
                state["stats"] = {"n_docs": n, "total_len": total or 0}
            with self._swapping() as ours:
                if self.manifest["version"] != before["version"] or not ours():
                    raise ConflictError("another writer has published meanwhile")
                self.files.write(self._manifest, json.dumps(state))
        except BaseException:
            for where in written:
                self.files.delete(f"{self.path}/{where}")
            raise
        return state

    def stage(self, df: DataFrame) -> DataFrame:
        """``df`` written beside the tables, to be read several times; :meth:`unstage` deletes it."""
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_path = path
        return out

    def unstage(self, *staged: DataFrame) -> None:
        for df in staged:
            self.files.delete(df.staged_path)

    def settle(self) -> list[str]:
        """Merge what many small changes have left: a table's segments of like size, or all of them where burials are many; their names."""
        state, merged = self.manifest, {}
        for name, entry in state["tables"].items():
            tiers: dict[int, list[dict]] = {}
            for s in entry["segments"]:
                tiers.setdefault(int(math.log(max(s["bytes"], 1), FAN)), []).append(s)
            like = max(tiers.values(), key=len, default=[])
            many = sum(b["rows"] for b in entry["buried"]) > max(1000, BURIED_SHARE * state.get("stats", {}).get("n_docs", 0))
            if many or len(entry["buried"]) >= FAN * FAN:
                merged[name] = entry["segments"]
            elif len(like) >= FAN:
                merged[name] = like
        if merged:
            self.publish({}, merged)
        return sorted(merged)

    # -- documents -----------------------------------------------------------------

    def derived(self, docs: DataFrame) -> dict[str, DataFrame]:
        """Passages, postings, lengths and vectors of some documents; vectors of unchanged texts are reused."""
        state = self.manifest
        passages = with_passages(docs, chunking_of((state.get("rebuild") or state)["chunking"]))
        index = lexical.build_index(docs, "doc_id", "title", "body", state["tokenizer"])
        out = {"passages": passages, "postings": index.postings, "doc_stats": index.lengths}
        if "model" in state:
            out["vectors"] = self._vectors(passages, docs, state["model"])
        return out

    def _vectors(self, passages: DataFrame, docs: DataFrame, model: dict) -> DataFrame:
        if self.embedder is None or self._model(self.embedder) != model:
            raise UsageError("this collection needs the model it was built with")
        text = passages.join(docs.select("doc_id", "title"), "doc_id").select("doc_id", "seq", compose_embed_text(F.col("title"), F.col("text")).alias("t"))
        own = docs.select("doc_id").distinct()  # what a document says again keeps its vector
        old = self.table("passages").join(own, "doc_id", "left_semi").join(self.table("documents").select("doc_id", "title"), "doc_id").join(self.table("vectors"), ["doc_id", "seq"])
        known = old.select(F.sha2(compose_embed_text(F.col("title"), F.col("text")), 256).alias("h"), F.col("embedding").alias("known")).dropDuplicates(["h"])
        met = text.withColumn("h", F.sha2("t", 256)).join(known, "h", "left")
        fresh = embed(met.where("known is null"), self.embedder, "t").select("doc_id", "seq", "embedding")
        return met.where("known is not null").select("doc_id", "seq", F.col("known").alias("embedding")).unionByName(fresh)

    def with_documents(self, docs: DataFrame) -> dict[str, Delta]:
        """The changes that insert or replace some documents; creation times of known ones stay."""
        now = F.current_timestamp()
        full = docs
        for f in schemas.DOCUMENTS:
            if f.name not in full.columns:
                full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
        full = full.withColumns({"created_at": F.coalesce("created_at", now), "updated_at": now, "title": F.coalesce("title", F.lit(""))}).select(*[f.name for f in schemas.DOCUMENTS])
        known = self.table("documents").select("doc_id", F.col("created_at").alias("__old")).join(full.select("doc_id").distinct(), "doc_id", "left_semi")
        # few ids are broadcast, so that the texts stay where they are
        kept = full if not (n := known.count()) else full.join(small(known, n), "doc_id", "left").withColumn("created_at", F.coalesce("__old", "created_at")).drop("__old")
        gone = known.select("doc_id")
        return {name: Delta(rows, gone) for name, rows in {"documents": kept, **self.derived(full)}.items()}

    def add_documents(self, docs: DataFrame) -> dict:
        """Insert or replace documents; what is written grows with them alone."""
        staged = self.stage(docs)
        try:
            self.publish(self.with_documents(staged))
        finally:
            self.unstage(staged)
        self.settle()
        return self.manifest

    def without_documents(self, ids: DataFrame, tables: dict[str, DataFrame | Delta] | None = None) -> dict[str, DataFrame | Delta]:
        """``tables`` with the changes that remove some documents and every row that hangs on them."""
        given = dict(tables or {})
        for t in ("documents", *KEYED):
            change = given.get(t)
            if isinstance(change, DataFrame):
                given[t] = changes.remove(change, ids)
            elif change is not None:
                gone = ids if change.gone is None else change.gone.select("doc_id").unionByName(ids.select("doc_id"))
                given[t] = Delta(None if change.rows is None else changes.remove(change.rows, ids), gone)
            elif t in self.manifest["tables"]:
                given[t] = Delta(gone=ids)
        return given

    def remove_documents(self, ids: DataFrame) -> dict:
        """Bury some documents' rows; nothing else is written."""
        self.publish(self.without_documents(ids))
        self.settle()
        return self.manifest

    def clear(self) -> dict:
        """Empty the collection; its name, model and settings stay."""
        return self.publish({t: self.spark.createDataFrame([], schemas.TABLES[t]) for t in self.manifest["tables"]})

    def attach_embedder(self, embedder) -> dict:
        """Bind a model, or check that it is the bound one, and embed what has no vectors."""
        state = self.manifest
        if state.get("model") not in (None, self._model(embedder)):
            raise UsageError("the collection was built with another model")
        self.embedder = embedder
        missing = self.table("passages").join(self.table("vectors"), ["doc_id", "seq"], "left_anti")
        return self.publish({"vectors": Delta(self._vectors(missing, self.table("documents"), self._model(embedder)))}, model=self._model(embedder))

    def vectors_need_rebuild(self, chunking) -> bool:
        """Whether passages were cut, or vectors made, under another setting or model than asked for."""
        state = self.manifest
        other = self.embedder is not None and state.get("model") != self._model(self.embedder)
        return other or state["chunking"] != chunking_text(normalize_chunking(chunking))

    def rebuild_passages(self, chunking, buckets: int = REBUILD_BUCKETS) -> dict:
        """Re-split under another setting, a share of the documents at a time; only those whose passages differ are written and embedded anew.

        Every share is published with how far the rebuild has come, so one that
        was cut off goes on where it stopped; documents that come in meanwhile
        are split under the new setting.
        """
        setting = normalize_chunking(chunking)
        target = chunking_text(setting)
        progress = self.manifest.get("rebuild") or {}
        if progress.get("chunking") != target:
            progress = {"chunking": target, "done": 0, "buckets": buckets}
        own = F.pmod(F.xxhash64("doc_id"), F.lit(progress["buckets"]))
        for share in range(progress["done"], progress["buckets"]):
            docs = self.table("documents").where(own == share)
            new, old = with_passages(docs, setting).select("doc_id", "seq", "text"), self.table("passages").where(own == share)
            differ = self.stage(new.exceptAll(old).unionByName(old.exceptAll(new)).select("doc_id").distinct())
            try:
                progress = {**progress, "done": share + 1}
                if not differ.limit(1).count():
                    self.publish({}, rebuild=progress)
                    continue
                cut = new.join(differ, "doc_id", "left_semi")
                tables = {"passages": Delta(cut, differ)}
                if "model" in self.manifest:
                    tables["vectors"] = Delta(self._vectors(cut, docs.join(differ, "doc_id", "left_semi"), self.manifest["model"]), differ)
                self.publish(tables, rebuild=progress)
            finally:
                self.unstage(differ)
        self.publish({}, chunking=target, rebuild=None)
        self.settle()
        return self.manifest

    def repair(self) -> dict:
        """Recompute all derived tables from the documents and drop rows of documents that are gone."""
        docs = self.table("documents")
        tables = self.derived(docs)
        for t in ("bookmarks", "activity"):
            if t in self.manifest["tables"]:
                tables[t] = self.table(t).join(docs.select("doc_id"), "doc_id", "left_semi")
        return self.publish(tables)

    # -- reading ----------------------------------------------------------------

    def postings(self) -> postings.Postings:
        """The stored postings of all segments."""
        entry = self.manifest["tables"].get("postings") or {"segments": [], "buried": []}
        return postings.Postings(self.spark, [f"{self.path}/{s['path']}" for s in entry["segments"]], buried=self._buried(entry))

    def corpus(self) -> Corpus:
        """What searches read: the stored index with the statistics of its version, and the tables."""
        known = self.manifest.get("stats") or {"n_docs": 0, "total_len": 0}
        stats = self.spark.createDataFrame([(known["n_docs"], known["total_len"] / known["n_docs"] if known["n_docs"] else None)], "n_docs long, avgdl double")
        index = lexical.stored_index(self.postings(), self.table("doc_stats"), stats, self.manifest["tokenizer"])
        return Corpus(self.table("documents"), index, self.table("passages"), self.table("vectors") if "model" in self.manifest else None, self.embedder)

    def health(self) -> DataFrame:
        return analytics.health(self.table("documents"), self.table("passages"), self.table("doc_stats"), self.table("vectors") if "model" in self.manifest else None)

    def integrity(self) -> DataFrame:
        """Health, and how many postings differ from those of the documents as they are."""
        docs = self.table("documents")
        fresh = lexical.build_index(docs, "doc_id", "title", "body", self.manifest["tokenizer"]).postings.select("term", "doc_id", "positions", "len")
        stored = self.table("postings")
        wrong = fresh.exceptAll(stored).unionByName(stored.exceptAll(fresh)).agg(F.count("*").alias("wrong_postings"))
        return self.health().crossJoin(F.broadcast(wrong)).withColumn("ok", F.col("ok") & (F.col("wrong_postings") == 0))  # one row each

    # -- user rows --------------------------------------------------------------

    def _append(self, name: str, row: dict, keep: int | None = None) -> int:
        old = self.table(name)
        new_id = (old.agg(F.max("id")).first()[0] or 0) + 1
        schema = schemas.TABLES[name]
        df = old.unionByName(self.spark.createDataFrame([tuple({**row, "id": new_id}.get(f.name) for f in schema)], schema))
        self.publish({name: analytics.keep_newest(df, keep) if keep else df})
        return new_id

    def record_search(self, query: str, mode: str, precision: str | None, result_count: int, filters: dict | None = None) -> int:
        import datetime as dt

        return self._append("history", {"query": query, "mode": mode, "precision": precision, "filters": json.dumps(filters or {}, sort_keys=True), "result_count": result_count, "searched_at": dt.datetime.now()}, analytics.HISTORY_KEPT)

    def clear_history(self) -> dict:
        return self.publish({"history": self.spark.createDataFrame([], schemas.HISTORY)})

    def save_query(self, name: str, query: str, mode: str, precision: str | None = None, filters: dict | None = None) -> int:
        import datetime as dt

        new_id = self._append("saved", {"name": name, "query": query, "mode": mode, "precision": precision, "filters": json.dumps(filters or {}, sort_keys=True), "created_at": dt.datetime.now()})
        self.publish({"saved": analytics.latest_by_name(self.table("saved"))})
        return new_id

    def delete_saved_query(self, saved_id: int) -> dict:
        return self.publish({"saved": self.table("saved").where(F.col("id") != saved_id)})

    def add_bookmark(self, doc_id: str, note: str | None = None) -> dict:
        new = self.spark.createDataFrame([(doc_id, note)], "doc_id string, note string").withColumn("created_at", F.current_timestamp())
        known = new.join(self.table("documents").select("doc_id"), "doc_id", "left_semi")
        return self.publish({"bookmarks": changes.upsert(self.table("bookmarks"), known, keep=("created_at",))})

    def remove_bookmark(self, doc_id: str) -> dict:
        return self.publish({"bookmarks": self.table("bookmarks").where(F.col("doc_id") != doc_id)})

    def record_open(self, doc_id: str) -> dict:
        new = self.spark.createDataFrame([(doc_id, 1)], "doc_id string, open_count long").withColumn("last_opened_at", F.current_timestamp())
        both = self.table("activity").unionByName(new)
        return self.publish({"activity": both.groupBy("doc_id").agg(F.max("last_opened_at").alias("last_opened_at"), F.sum("open_count").alias("open_count"))})

    # -- roots ---------------------------------------------------------------------

    def with_root(self, path: str, exclude=(), files_only: bool = False) -> tuple[int, DataFrame | None]:
        """(number of the root at ``path``, the roots with it, or None if it is there)."""
        found = self.table("roots").where(F.col("path") == path).select("root_id").first()
        if found:
            return found[0], None
        new_id = (self.table("roots").agg(F.max("root_id")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(new_id, path, list(exclude), None, None, files_only)], schemas.ROOTS).withColumn("added_at", F.current_timestamp())
        return new_id, self.table("roots").unionByName(row)

    def ensure_root(self, path: str, exclude=(), files_only: bool = False) -> int:
        root_id, roots = self.with_root(path, exclude, files_only)
        if roots is not None:
            self.publish({"roots": roots})
        return root_id

    def roots(self) -> DataFrame:
        """Registered folders and their numbers of documents."""
        n = self.table("documents").groupBy("root_id").agg(F.count("*").alias("documents"))
        return self.table("roots").join(n, "root_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))

    def remove_root(self, root_id: int) -> dict:
        """Forget a root and its documents, at once."""
        tables = self.without_documents(self.table("documents").where(F.col("root_id") == root_id).select("doc_id"))
        return self.publish({**tables, "roots": self.table("roots").where(F.col("root_id") != root_id)})

    def forget_root(self, root_id: int) -> dict:
        return self.publish({"roots": self.table("roots").where(F.col("root_id") != root_id)})

    def relocate_root(self, root_id: int, path: str) -> dict:
        return self.publish({"roots": self.table("roots").withColumn("path", F.when(F.col("root_id") == root_id, path).otherwise(F.col("path")))})

    def adopted(self, child: int, parent: int, prefix: str) -> DataFrame:
        """The documents of a nested root as the root above it has them; their sources and folders get the prefix."""
        docs = self.table("documents").where(F.col("root_id") == child)
        folder = F.when(F.coalesce("folder", F.lit("")) == "", prefix).otherwise(F.concat_ws("/", F.lit(prefix), "folder"))
        return docs.withColumns({"source": F.concat_ws("/", F.lit(prefix), "source"), "folder": folder, "root_id": F.lit(parent).cast("long")})

    def adopt_root(self, child: int, parent: int, prefix: str) -> dict:
        docs = self.adopted(child, parent, prefix)
        return self.publish({"documents": Delta(docs, docs.select("doc_id")), "roots": self.table("roots").where(F.col("root_id") != child)})

    # -- copies ----------------------------------------------------------------

    @staticmethod
    def _paths(state: dict) -> list[str]:
        """The folders a manifest names."""
        return sorted({part["path"] for entry in state["tables"].values() for part in (*entry["segments"], *entry["buried"])})

    def backup(self, target: str) -> str:
        """A whole copy of the current version; the manifest comes last."""
        state = self.manifest
        if self.files.exists(f"{target}/manifest.json"):
            raise UsageError(f"{target} exists")
        for where in self._paths(state):
            self.files.copy(f"{self.path}/{where}", f"{target}/{where}")
        self.files.write(f"{target}/manifest.json", json.dumps(state))
        return target

    @classmethod
    def restore(cls, spark: SparkSession, source: str, target: str, embedder=None, replace: bool = False) -> "Collection":
        """A collection from a backup; with ``replace`` the old one is copied beside it first.

        What the backup names is copied to the target and checked; then one
        swap of the manifest takes the target from its old state to the new
        one, so there is a whole collection at any moment.
        """
        target = target.rstrip("/")
        got, new = cls(spark, source, embedder), cls(spark, target, embedder)
        there = new.files.exists(new._manifest)
        if there and not replace:
            raise UsageError(f"a collection exists at {target}")
        state = got.manifest
        before = new.manifest if there else {"version": 0}
        if there:
            new.backup(f"{target}-before-restore-{time.time_ns()}")
        copied = []
        try:
            for where in cls._paths(state):
                size = got.files.size(f"{source}/{where}")
                if new.files.exists(f"{target}/{where}") and new.files.size(f"{target}/{where}") == size:
                    continue  # segments never change: the same name is the same segment
                copied.append(where)
                got.files.copy(f"{source}/{where}", f"{target}/{where}")
                if new.files.size(f"{target}/{where}") != size:
                    raise DataError(f"the copy of {where} is not whole")
            state = {**state, "version": max(state["version"], before["version"]) + there}
            with new._swapping() as ours:
                if there and new.manifest["version"] != before["version"] or not ours():
                    raise ConflictError("another writer has published meanwhile")
                new.files.write(new._manifest, json.dumps(state))
        except BaseException:
            for where in copied:
                new.files.delete(f"{target}/{where}")
            raise
        return new

    def compact(self, file_bytes: int = FILE_BYTES) -> tuple[int, int]:
        """Write every table as one segment with files of about ``file_bytes`` and delete folders no manifest names; bytes before and after."""
        before, state = self.files.size(self.path), self.manifest
        few = lambda t, entry: self.table(t).coalesce(max(1, sum(s["bytes"] for s in entry["segments"]) // file_bytes))
        self.publish({t: few(t, e) for t, e in state["tables"].items() if t != "postings"}, {"postings": state["tables"]["postings"]["segments"]} if "postings" in state["tables"] else None)
        live = set(self._paths(self.manifest))
        for t in self.files.children(f"{self.path}/tables"):
            for v in self.files.children(f"{self.path}/tables/{t}"):
                if f"tables/{t}/{v}" not in live:
                    self.files.delete(f"{self.path}/tables/{t}/{v}")
        return before, self.files.size(self.path)
