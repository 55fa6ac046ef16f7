"""Command line: ``python -m tessera.cli <library folder> <command> ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .errors import TesseraError
from .functions.vectors import HashingEmbedder
from .operators.analytics import capabilities, status
from .plans.evaluate import load_gold, report, run_alpha_sweep, run_eval, run_smoke
from .plans.ingest import ingest, scan_all, scan_changes
from .plans.library import Library
from .plans.search import results, search
from .plans.store import Collection
from .streaming.watch import AutoSync


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("library", help="folder of the registry")
    top.add_argument("--collection")
    sub = top.add_subparsers(dest="command", required=True)
    add = sub.add_parser
    for name in ("collections", "status", "doctor", "repair", "check"):
        add(name)
    p = add("create")
    p.add_argument("name")
    p.add_argument("--chunking", default="default")
    p.add_argument("--no-vectors", action="store_true")
    for name in ("use", "drop", "remove", "forget-folder", "remove-folder"):
        add(name).add_argument("name")
    p = add("rename")
    p.add_argument("name")
    p.add_argument("new")
    p = add("index")
    p.add_argument("path")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--keep-deleted", action="store_true")
    p = add("search")
    p.add_argument("query")
    p.add_argument("--mode", default="hybrid")
    p.add_argument("--match", default="auto")
    p.add_argument("--precision", default="float")
    p.add_argument("--filters", type=json.loads)
    p.add_argument("-k", type=int, default=10)
    for name in ("--explain", "--rerank", "--json"):
        p.add_argument(name, action="store_true")
    for name in ("folders", "compact", "watch", "rebuild-passages"):
        p = add(name)
        p.add_argument("value", nargs="?", default=None)
    add("changes").add_argument("root_id", type=int, nargs="?", help="one folder; all of them if left out")
    add("backup").add_argument("target", nargs="?")
    p = add("restore")
    p.add_argument("source")
    p.add_argument("name")
    for name in ("eval", "sweep-alpha"):
        p = add(name)
        p.add_argument("folder")
        p.add_argument("qrels")
        p.add_argument("-k", type=int, default=10)
        p.add_argument("--publish", help="folder for the manifest and the report")
    p = add("smoke")
    p.add_argument("gold")
    p.add_argument("-k", type=int, default=5)
    p = add("relocate-folder")
    p.add_argument("root_id", type=int)
    p.add_argument("path")
    return top


def run(spark: SparkSession, argv: list[str], out=print) -> None:
    a = parser().parse_args(argv)
    lib, model = Library(spark, a.library), HashingEmbedder()
    show = lambda df, n=50: [out(json.dumps(r.asDict(True), default=str, ensure_ascii=False)) for r in df.limit(n).collect()]
    if a.command == "collections":
        return [out(json.dumps(c)) for c in lib.list()] and None
    if a.command == "create":
        return out(json.dumps(lib.create(a.name, chunking=a.chunking, embedder=None if a.no_vectors else model)))
    if a.command == "use":
        return lib.set_active(a.name)
    if a.command == "drop":
        return lib.remove(a.name, delete=True)
    if a.command == "rename":
        return out(json.dumps(lib.rename(a.name, a.new)))
    if a.command == "restore":
        Collection.restore(spark, a.source, f"{lib.root}/{a.name}")
        return out(json.dumps(lib.register(a.name, f"{lib.root}/{a.name}")))
    if a.command == "eval":
        return out(report(run_eval(spark, a.folder, a.qrels, model, a.k, a.publish), "Evaluation"))
    if a.command == "sweep-alpha":
        return out(report(run_alpha_sweep(spark, a.folder, a.qrels, model, a.k, a.publish), "Sweep of alpha"))
    col = lib.open(a.collection, model)
    if a.command == "index":
        out(json.dumps(ingest(col, a.path, a.exclude, not a.keep_deleted)))
    elif a.command == "search":
        hits = search(spark, col.corpus(), a.query, mode=a.mode, k=a.k, precision=a.precision, match=a.match, filters=a.filters, rerank=a.rerank, explain=a.explain).cache()
        col.record_search(a.query, a.mode, a.precision, hits.where("confidence <> 'weak'").count(), a.filters)
        show(results(hits, col.corpus(), a.query).orderBy("rank"), a.k)
    elif a.command in ("status", "check"):
        show(capabilities(status(col.health()), "model" in col.manifest))
    elif a.command == "doctor":
        show(col.integrity())
    elif a.command == "repair":
        out(str(col.repair()["version"]))
    elif a.command == "folders":
        show(col.roots())
    elif a.command == "remove-folder":
        col.remove_root(int(a.name))
    elif a.command == "forget-folder":
        col.forget_root(int(a.name))
    elif a.command == "remove":
        col.remove_documents(spark.createDataFrame([(a.name,)], "doc_id string"))
    elif a.command == "changes":
        show((scan_all(col) if a.root_id is None else scan_changes(col, a.root_id)).where("change <> 'unchanged'"))
    elif a.command == "backup":
        out(col.backup(a.target or lib.backup_path(a.collection or lib._load()["active"])))
    elif a.command == "compact":
        out(json.dumps(col.compact()))
    elif a.command == "rebuild-passages":
        col.rebuild_passages(a.value or "default")
    elif a.command == "smoke":
        out(json.dumps(run_smoke(spark, col.corpus(), load_gold(a.gold), a.k)))
    elif a.command == "relocate-folder":
        col.relocate_root(a.root_id, a.path)
    elif a.command == "watch":
        AutoSync(col, float(a.value or 5)).start().query.awaitTermination()


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, sys.argv[1:] if argv is None else argv)
    except KeyboardInterrupt:
        return 130
    except TesseraError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
