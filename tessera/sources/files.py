"""Text files and JSON lines as DataFrames of documents."""

from __future__ import annotations

import fnmatch
import re
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, UsageError
from ..functions.text import normalize_tags
from . import walk

# Which files are text, what is left out, limits, and the lines of a front matter.
SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".org", ".text")
EXCLUDES = (".*", "node_modules", "__pycache__", ".venv", "venv")
MAX_BYTES, SNIFF_BYTES = 5 * 1024 * 1024, 8192
MAX_TAGS, TAG_CHARS, FRONT_LINES = 50, 64, 200

#: files that are opened by name, on stores that only Spark's reader reaches
MAX_PATHS = 4096

_KEY = re.compile(r"([A-Za-z0-9_-]+)\s*:\s*(.*)")
_ITEM = re.compile(r"\s*-\s*(.*)")


def normalize_excludes(patterns) -> list[str]:
    patterns = [] if patterns is None else [patterns] if isinstance(patterns, str) else list(patterns)
    if not all(isinstance(p, str) for p in patterns):
        raise UsageError("exclude patterns must be strings")
    return list(dict.fromkeys(p for p in (re.sub(r"^(\./)+", "", p.strip().replace("\\", "/")).strip("/") for p in patterns) if p))


def excluded(relative: F.Column, patterns) -> F.Column:
    """Whether a glob fits the relative path, one of its parts or a folder above it, in any case."""
    tests = [fnmatch.translate(p.lower()).replace(r"\Z", "").replace(r"\z", "") for p in normalize_excludes(patterns)]
    if not tests:
        return F.lit(False)
    whole = "^(?:" + "|".join(tests) + ")$"
    parts = F.split(F.lower(relative), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.exists(F.concat(parts, above), lambda c: c.rlike(whole))


def decode(raw: bytes) -> str | None:
    """The text of a file with line ends unified; None if it is binary."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order = ["utf-16"]
    elif b"\0" in raw[:SNIFF_BYTES]:
        return None
    else:
        order = ["utf-8-sig", "cp1252", "latin-1"]
    for name in order:
        try:
            return re.sub(r"\r\n?", "\n", raw.decode(name))
        except UnicodeDecodeError:
            continue
    return None


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1].strip() if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def front_matter(text: str) -> tuple[str | None, list[str], str]:
    """(title, tags, body): a leading block between --- lines of keys and items; anything else stays in the body."""
    lines = text.split("\n")
    stop = next((i for i, x in enumerate(lines[1 : FRONT_LINES + 1], 1) if x.strip() in ("---", "...")), None)
    if lines[0].strip() != "---" or stop is None:
        return None, [], text
    values: dict[str, list[str]] = {}
    key = None
    for line in lines[1:stop]:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        found = None if line[0].isspace() else _KEY.match(line)
        if found:
            key = found.group(1).lower()
            values[key] = [found.group(2).strip()]
        elif key is not None and (item := _ITEM.match(line)):
            values[key].append(item.group(1))
        elif key is None or not line[0].isspace():
            return None, [], text
    name = next((k for k in ("tags", "tag", "keywords") if k in values), None)
    tags: list[str] = []
    if name:
        first, *items = values[name]
        first = first[1:-1] if first.startswith("[") and first.endswith("]") else first
        cleaned = [_unquoted(v).lstrip("#").strip() for v in [*(first.split(",") if first else []), *items]]
        tags = list(dict.fromkeys(t.lower() for t in cleaned if t and len(t) <= TAG_CHARS))[:MAX_TAGS]
    return _unquoted(values["title"][0]) or None if "title" in values else None, tags, "\n".join(lines[stop + 1 :])


def split_title(text: str, stem: str) -> tuple[str, str]:
    """A first line ``# Title`` names the document; else its file does."""
    head, _, rest = text.lstrip().partition("\n")
    if head.startswith("# "):
        return head[2:].strip(), rest.strip()
    return stem, text.strip()


PARSED = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("skip", T.StringType())])


def _parse(content: pd.Series, stem: pd.Series) -> pd.DataFrame:
    rows = []
    for raw, name in zip(content, stem):
        text = decode(bytes(raw)) if raw is not None else None
        if text is None:
            rows.append((None, None, None, "binary"))
            continue
        title, tags, body = front_matter(text)
        if title is None:
            title, body = split_title(body, name)
        else:
            body = body.strip()
        rows.append((title, body, tags, None if body else "empty"))
    return pd.DataFrame(rows, columns=["title", "body", "tags", "skip"])


@contextmanager
def listed(spark: SparkSession, folder: str, exclude=()):
    """(path, kind, size, mtime_ns, reason) of a folder's text files, and of folders below it that could not be listed.

    Contents are not read and excluded folders not entered. The table lives as long as the block.
    """
    listing = listing_of(spark, folder, exclude)
    try:
        yield listing
    finally:
        if hasattr(listing, "walk_path"):
            walk.forget(listing)


def listing_of(spark: SparkSession, folder: str, exclude=()) -> DataFrame:
    """The table of :func:`listed`, to be deleted by who asked for it."""
    patterns, root = [*EXCLUDES, *normalize_excludes(exclude)], walk.local_path(spark, folder)
    text = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES)
    if root is None:
        found = _spark_files(spark, folder).where(~excluded(F.col("relative"), patterns))
        none = F.lit(None).cast("string")
        return found.select(F.col("relative").alias("path"), F.lit(walk.FILE).alias("kind"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), none.alias("reason")).where(text)
    found = walk.walk(spark, root, patterns)
    out = found.where((F.col("kind") == walk.UNREADABLE) | text)
    out.walk_path = found.walk_path
    return out


def snapshot(spark: SparkSession, folder: str, exclude=()) -> DataFrame:
    """(path, mtime_ns, size): a stat-only listing; file contents are not read."""
    return listing_of(spark, folder, exclude).where(F.col("kind") == walk.FILE).select("path", "mtime_ns", "size")


def is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def list_directory(spark: SparkSession, path: str, most: int = 500) -> list[dict]:
    """Up to ``most`` entries of a folder for a picker, folders first; hidden ones are left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [{"name": s.getPath().getName(), "folder": s.isDirectory(), "size": s.getLen()} for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted((x for x in found if not x["name"].startswith(".")), key=lambda x: (not x["folder"], x["name"].lower()))[:most]


def hashes(paths: DataFrame, folder: str) -> DataFrame:
    """(path, content_hash) of the files of a folder at the ways in ``paths`` (path); no other file is opened, and the ways stay a table."""
    return _contents(paths.select("path"), folder).select("path", F.sha2("content", 256).alias("content_hash"))


def _contents(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (path ...) with content and problem; files that are too large or can't be read have a problem."""
    spark = rows.sparkSession
    root = walk.local_path(spark, folder)
    if root is not None:
        return walk.read(rows.repartition(spark.sparkContext.defaultParallelism), root, MAX_BYTES)
    named = [r.path for r in rows.select("path").limit(MAX_PATHS + 1).collect()]
    # few files are opened by name; of more, all of the folder's are read and met with the rows
    files = _spark_files(spark, folder, named if len(named) <= MAX_PATHS else None).select(F.col("relative").alias("path"), "length", "content")
    big = F.col("length") > MAX_BYTES
    return rows.join(files, "path", "left").withColumns({"content": F.when(~big, F.col("content")), "problem": F.when(big, "too large").when(F.col("length").isNull(), "unreadable")}).drop("length")


def _spark_files(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """All files below a folder of any store Spark can reach, or those at some ways below it, by Spark's reader."""
    reader = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if only == []:
        return spark.createDataFrame([], reader.option("recursiveFileLookup", True).load(folder).schema).withColumn("relative", F.col("path"))
    # a path to load is a pattern, so what would be one in a name is escaped
    files = reader.load([f"{folder.rstrip('/')}/{re.sub(r'([\\*?{}\[\]])', r'\\\1', p)}" for p in only]) if only else reader.option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    at = F.instr(F.col("path"), base)
    return files.withColumn("relative", F.substr("path", at + F.lit(len(base))))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """The listing of a single file, as that of its folder has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    name = p.getName()
    row = (name, walk.FILE, s.getLen(), s.getModificationTime() * 1_000_000, None)
    return spark.createDataFrame([row] if f".{name.rpartition('.')[2].lower()}" in SUFFIXES else [], walk.SCHEMA)


def read_folder(spark: SparkSession, folder: str, exclude=(), root_id: int | None = None, limit: int | None = None, way: str = "") -> DataFrame:
    """Documents of a folder, and the files and folders that were skipped (column ``skip`` says why)."""
    return read_listed(listing_of(spark, folder, exclude), folder, root_id, limit, way)


def read_listed(listing: DataFrame, folder: str, root_id: int | None = None, limit: int | None = None, way: str = "") -> DataFrame:
    """Documents of the files of a listing of ``folder``; what has no document has a row that says why (``skip``).

    ``way``: how the folder lies below its root; ids and folders start with it.
    A listing cut at ``limit`` files has a row ``truncated``, a folder that
    could not be listed a row ``unreadable folder``.
    """
    files = listing.where(F.col("kind") == walk.FILE)
    marks = listing.where(F.col("kind") == walk.UNREADABLE).select("path", F.lit("unreadable folder").alias("mark"))
    if limit:
        over = listing.where(F.col("kind") == walk.FILE).agg(F.count("*").alias("n")).where(F.col("n") > limit)
        marks = marks.unionByName(over.select(F.lit("").alias("path"), F.lit("truncated").alias("mark")))
        files = files.orderBy("path").limit(limit)
    parse = F.pandas_udf(_parse, PARSED)
    below = lambda c: F.concat(F.lit(way + "/"), c) if way else F.col(c)
    found = _contents(files.select("path", "size", "mtime_ns"), folder)
    found = found.withColumns({"p": F.when(F.col("content").isNotNull(), parse("content", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))), "relative": below("path")})
    none = lambda kind: F.lit(None).cast(kind)
    docs = found.select(
        F.col("relative").alias("doc_id"), F.col("p.title").alias("title"), F.col("p.body").alias("body"), F.col("relative").alias("source"), none("string").alias("meta"),
        F.sha2("content", 256).alias("content_hash"), (F.col("mtime_ns") / 1e9).alias("mtime"), F.col("size").alias("size_bytes"), F.lower(F.regexp_extract("relative", r"(\.[^./]+)$", 1)).alias("ext"),
        F.regexp_extract("relative", r"^(.*)/[^/]*$", 1).alias("folder"), F.col("p.tags").alias("tags"), F.lit(root_id).cast("long").alias("root_id"), F.coalesce("problem", "p.skip").alias("skip"),
    )
    at = F.rtrim(below("path"), F.lit("/")) if way else F.col("path")
    others = marks.select(at.alias("doc_id"), F.col("mark").alias("skip")).withColumns({f.name: none(f.dataType) for f in docs.schema if f.name not in ("doc_id", "skip")})
    return docs.unionByName(others.withColumn("folder", F.col("doc_id")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON-lines file: id from _id, id or the line's number; text or body; no file metadata.

    Line numbers count all lines of a file from 1, however it is split for
    reading; of several files at ``path`` the number follows the file's name.
    """
    schema = "_id string, id string, title string, text string, body string, source string, metadata string"
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    several = len(spark.read.text(path).inputFiles()) > 1
    lines = raw.where(F.trim("value") != "").join(starts, ["file", "block"])
    rows = lines.select(F.from_json("value", schema).alias("j"), "value", "file", (F.col("at") + F.col("shift") + 1).alias("line"))
    name = F.concat(F.url_decode(F.regexp_extract("file", r"([^/]*)$", 1)), F.lit(":")) if several else F.lit("")
    number = F.concat(name, F.lit("line-"), F.col("line").cast("string"))
    body = F.coalesce("j.text", "j.body")
    none = {"mtime": "double", "size_bytes": "long", "ext": "string", "folder": "string", "tags": "array<string>", "root_id": "long"}
    return rows.select(
        F.coalesce("j._id", "j.id", number).alias("doc_id"), F.coalesce("j.title", F.lit("")).alias("title"), body.alias("body"), F.col("j.source").alias("source"),
        F.col("j.metadata").alias("meta"), F.sha2("value", 256).alias("content_hash"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()],
        F.when(~F.startswith(F.trim("value"), F.lit("{")) | F.get_json_object("value", "$").isNull(), "invalid").when(F.coalesce(F.trim(body), F.lit("")) == "", "empty").alias("skip"),
    )


def refuse_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs``, or an error if an id occurs twice."""
    twice = docs.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise DataError(f"id {twice[0][0]!r} occurs more than once")
    return docs


def tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tags", normalize_tags(F.col("tags")))
