import json
import os
import threading

import pytest

from tessera.cli import run as cli
from tessera.errors import ConflictError, EmptyQueryError, UsageError
from tessera.functions.vectors import HashingEmbedder
from tessera.plans import evaluate
from tessera.operators import analytics
from tessera.plans.ingest import ingest, ingest_folder, ingest_jsonl, scan_changes
from tessera.plans.library import Library, slugify
from tessera.plans.search import results, search, search_with_outcome
from tessera.plans.store import Collection
from tessera.sources import beir, files
from tessera.streaming import watch


def Axis():
    class Axis:
        """Keywords of known cosines."""

        name, revision, dimension = "axis", "1", 3

        def encode_documents(self, texts):
            import numpy as np

            return np.array([[1, 0, 0] if "compost" in t else [0.4, 0.9165151, 0] if "half" in t else [0, 0, 1] for t in texts], "float32")

        def encode_query(self, text):
            return self.encode_documents([text])[0]

    return Axis()


@pytest.fixture()
def notes(tmp_path):
    root = tmp_path / "notes"
    (root / "deep").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.md").write_text("hidden")
    (root / "soil.md").write_text("# Soil\ncompost makes water drain")
    (root / "deep" / "bread.txt").write_text("wild yeast in bread")
    (root / "deep" / "copy.txt").write_text("wild yeast in bread")
    (root / "tagged.md").write_text("---\ntitle: Half\ntags: [Work, '#home']\n---\nhalf of the water")
    (root / "bin.txt").write_bytes(b"a\0b")
    (root / "empty.md").write_text("  ")
    (root / "other.pdf").write_text("no")
    return root


def test_parsing():
    assert files.decode("é".encode("utf-16")) == "é" and files.decode(b"\xef\xbb\xbfa\r\nb\rc") == "a\nb\nc"
    assert files.decode(b"caf\xe9") == "café" and files.decode(b"\x81") == "\x81" and files.decode(b"a\0") is None
    assert files.front_matter("---\ntitle: 'T'\ntags:\n  - A\n  - \"#b\"\n---\nx")[:3] == ("T", ["a", "b"], "x")
    for plain in ("--- no", "---\nprose here\n---\nx", "---\ntitle: T\nnever closed"):
        assert files.front_matter(plain) == (None, [], plain)
    assert files.split_title("\n# T \nbody\n", "s") == ("T", "body") and files.split_title("body", "s") == ("s", "body")


def test_folder_scan(spark, notes):
    got = {r.doc_id: r for r in files.read_folder(spark, str(notes), exclude=["*copy*"]).collect()}
    assert set(got) == {"soil.md", "deep/bread.txt", "tagged.md", "bin.txt", "empty.md"}
    assert got["soil.md"].title == "Soil" and got["soil.md"].folder == "" and got["deep/bread.txt"].folder == "deep"
    assert got["tagged.md"].title == "Half" and got["tagged.md"].tags == ["work", "home"]
    assert got["bin.txt"].skip == "binary" and got["empty.md"].skip == "empty" and got["soil.md"].skip is None


def test_collection_life(spark, notes, tmp_path):
    col = Collection.create(spark, str(tmp_path / "col"), "mine", chunking="off", embedder=Axis())
    col = Collection(spark, str(tmp_path / "col"), Axis())
    first = ingest_folder(col, str(notes))
    assert (first["added"], first["skipped"], first["removed"]) == (4, 2, 0) and col.manifest["version"] == 1
    assert ingest_folder(col, str(notes))["unchanged"] == 4
    assert col.integrity().first().ok
    corpus = col.corpus()
    hits = search(spark, corpus, [("1", "compost"), ("2", "yeast bread")], mode="hybrid", k=3, explain=True).orderBy("qid", "rank").collect()
    assert hits[0].doc_id == "soil.md" and hits[0].confidence == "strong"
    assert "Found by both keyword and meaning search" in hits[0].explain.reasons
    half = [h for h in hits if h.qid == "1" and h.doc_id == "tagged.md"][0]
    assert half.explain.semantic_score == pytest.approx(0.4, abs=1e-6) and half.confidence == "moderate"
    shown = results(search(spark, corpus, "yeast", mode="lexical"), corpus, "yeast").orderBy("rank").collect()
    assert shown[0].duplicates == ["deep/copy.txt"] and any(s.highlight for s in shown[0].snippet)
    only = search(spark, corpus, "water", mode="lexical", filters={"tags": ["work"]}).collect()
    assert [h.doc_id for h in only] == ["tagged.md"]
    binary = search(spark, corpus, "compost", mode="semantic", precision="binary", k=1).first()
    assert binary.doc_id == "soil.md" and binary.confidence == "strong"
    reranked = search(spark, corpus, "compost", rerank=True, k=2, depth=4).orderBy("rank").collect()
    assert reranked[0].doc_id == "soil.md" and reranked[0].score == pytest.approx(1.0)

    col.add_bookmark("deep/bread.txt", "keep")
    (notes / "deep" / "bread.txt").rename(notes / "deep" / "loaf.txt")
    (notes / "deep" / "copy.txt").unlink()
    (notes / "soil.md").write_text("# Soil\ncompost changed")
    changes = {r.path: r.change for r in scan_changes(col, 1).collect()}
    assert changes["deep/loaf.txt"] == "new" and changes["deep/copy.txt"] == "deleted" and changes["soil.md"] == "changed"
    second = ingest_folder(col, str(notes))
    assert (second["added"], second["updated"], second["removed"]) == (1, 1, 2)
    assert [r.doc_id for r in col.table("bookmarks").collect()] == ["deep/loaf.txt"]
    assert col.integrity().first().ok and col.table("runs").count() == 3

    col.backup(str(tmp_path / "backup"))
    col.clear()
    assert col.table("documents").count() == 0
    back = Collection.restore(spark, str(tmp_path / "backup"), str(tmp_path / "col"), Axis(), replace=True)
    assert back.table("documents").count() == 3
    before, after = back.compact()
    assert after <= before and back.integrity().first().ok
    back.rebuild_passages({"max_words": 16, "overlap_words": 0})
    assert back.integrity().first().ok
    with pytest.raises(UsageError):
        back.attach_embedder(HashingEmbedder())
    back.files.create(f"{back.path}/.lock", "x")
    with pytest.raises(ConflictError):
        back.remove_bookmark("x")
    version = back.manifest["version"]
    os.utime(f"{back.path}/.lock", (1, 1))  # its writer died long ago
    back.set_preference("sync", True)
    assert back.manifest["version"] == version + 1 and back.preference("sync") and not os.path.exists(f"{back.path}/.lock")


def test_user_rows(spark, tmp_path):
    col = Collection.create(spark, str(tmp_path / "c"), embedder=None)
    for i in range(3):
        col.record_search(f"q{i}", "lexical", None, i)
    assert [r.id for r in col.table("history").orderBy("id").collect()] == [1, 2, 3]
    col.save_query("Mine", "a", "lexical")
    col.save_query("mine", "b", "lexical")
    assert [(r.name, r.query) for r in col.table("saved").collect()] == [("mine", "b")]
    col.record_open("d")
    col.record_open("d")
    assert col.table("activity").first().open_count == 2


def test_jsonl_and_repeats(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text("\n".join(map(json.dumps, [{"_id": "a", "title": "T", "text": "x", "metadata": {"k": 1}}, {"id": "b", "body": "y"}, {"text": "z"}])))
    col = Collection.create(spark, str(tmp_path / "c"))
    assert ingest_jsonl(col, str(p))["added"] == 3
    got = {r.doc_id: r for r in col.table("documents").collect()}
    assert {"a", "b"} < set(got) and got["a"].folder is None and json.loads(got["a"].meta) == {"k": 1}
    with pytest.raises(Exception, match="more than once"):
        files.refuse_repeats(spark.createDataFrame([("a",), ("a",)], "doc_id string"))


def test_line_numbers_hold_for_any_split(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    for name, n in (("a.jsonl", 400), ("b.jsonl", 30)):
        (d / name).write_text("\n".join("" if i % 7 == 3 else json.dumps({"text": f"{name} line {i + 1}"}) for i in range(n)) + "\n[1]\nnot json\n")
    got = []
    for size in ("128m", "500b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got.append(sorted((r.doc_id, r.body, r.skip) for r in files.read_jsonl(spark, str(d)).collect()))
        one = files.read_jsonl(spark, str(d / "a.jsonl"))
        assert all(r.body == f"a.jsonl line {r.doc_id.removeprefix('line-')}" for r in one.where("skip is null").collect()) and one.where("skip = 'invalid'").count() == 2
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1] and all(b == f"{i.replace(':line-', ' line ')}" for i, b, s in got[0] if s is None)
    assert sum(s is None for _, _, s in got[0]) == 400 - 57 + 30 - 4


def test_nested_roots_and_single_files(spark, notes, tmp_path):
    col = Collection.create(spark, str(tmp_path / "c"))
    ingest_folder(col, str(notes / "deep"))
    col.add_bookmark("bread.txt", "keep")
    version = col.manifest["version"]
    whole = ingest_folder(col, str(notes))  # takes the root inside it over
    assert [r.path for r in col.table("roots").collect()] == [str(notes)] and col.manifest["version"] == version + 1
    assert {r.doc_id for r in col.table("documents").collect()} == {"soil.md", "tagged.md", "deep/bread.txt", "deep/copy.txt"} and whole["removed"] == 2
    assert [r.doc_id for r in col.table("bookmarks").collect()] == ["deep/bread.txt"]
    (notes / "deep" / "copy.txt").unlink()
    (notes / "soil.md").unlink()
    part = ingest_folder(col, str(notes / "deep"))  # a part of its root: what is gone elsewhere stays
    assert part["removed"] == 1 and {r.doc_id for r in col.table("documents").collect()} == {"soil.md", "tagged.md", "deep/bread.txt"}
    assert ingest_folder(col, str(notes), limit=1) == {"added": 0, "updated": 0, "touched": 0, "unchanged": 0, "removed": 0, "skipped": 1, "truncated": True}
    (notes / "deep" / "new.md").write_text("# New\nnew text")
    assert ingest(col, str(notes / "deep" / "new.md"))["added"] == 1
    lone = tmp_path / "lone"
    lone.mkdir()
    (lone / "x.md").write_text("alone")
    (lone / "y.md").write_text("other")
    assert ingest(col, str(lone / "x.md"))["added"] == 1 and ingest(col, str(lone / "x.md"))["unchanged"] == 1
    assert {r.doc_id for r in col.table("documents").collect()} == {"soil.md", "tagged.md", "deep/bread.txt", "deep/new.md", "x.md"}
    assert col.integrity().first().ok and files.list_directory(spark, str(notes))[0] == {"name": "deep", "folder": True, "size": files.list_directory(spark, str(notes))[0]["size"]}
    assert analytics.last_indexed(col.table("roots"), col.table("documents")).first().last_indexed_at is not None


def test_a_failed_run_changes_nothing(spark, notes, tmp_path, monkeypatch):
    col = Collection.create(spark, str(tmp_path / "c"))
    ingest_folder(col, str(notes))
    before, tables = col.manifest, sorted(os.listdir(tmp_path / "c" / "tables" / "documents"))
    (notes / "soil.md").write_text("changed")
    monkeypatch.setattr(col.files, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest_folder(col, str(notes))
    assert col.manifest == before and sorted(os.listdir(tmp_path / "c" / "tables" / "documents")) == tables and not os.path.exists(tmp_path / "c" / ".lock")


def test_outcome_and_bookmarked(spark, notes, tmp_path):
    col = Collection.create(spark, str(tmp_path / "c"), embedder=Axis())
    col.embedder = Axis()
    ingest_folder(col, str(notes))
    col.add_bookmark("soil.md")
    asked = [("1", "wild yeast"), ("2", "water yeast"), ("3", "zebra")]
    hits, outcome = search_with_outcome(spark, col.corpus(), asked, mode="lexical", match="auto", k=5)
    got = {r.qid: r for r in outcome.collect()}
    assert (got["1"].n_hits, got["1"].strict_count, got["1"].relaxed, got["1"].abstained) == (2, 2, False, False)
    assert (got["2"].strict_count, got["2"].relaxed) == (0, True) and got["2"].n_hits == 4
    assert tuple(got["3"])[1:] == (0, 0, False, 0, False)
    _, outcome = search_with_outcome(spark, col.corpus(), "half", mode="semantic", k=5)
    assert outcome.first().strict_count is None
    shown = results(search(spark, col.corpus(), "water", mode="lexical"), col.corpus(), "water", col.table("bookmarks")).collect()
    assert {r.doc_id: r.bookmarked for r in shown} == {"soil.md": True, "tagged.md": False}


def test_search_arguments(spark, tmp_path):
    col = Collection.create(spark, str(tmp_path / "c"))
    for kw in ({"mode": "x"}, {"mode": "semantic"}, {"mode": "lexical", "k": 0}, {"mode": "lexical", "match": "x"}):
        with pytest.raises(UsageError):
            search(spark, col.corpus(), "q", **kw)
    with pytest.raises(EmptyQueryError):
        search(spark, col.corpus(), "  ", mode="lexical")


def test_evaluation(spark, tmp_path):
    d = tmp_path / "set"
    d.mkdir()
    (d / "corpus.jsonl").write_text('{"_id":"d1","title":"Citrus","text":"oranges vitamin C"}\n{"_id":"d2","title":"Bread","text":"sourdough yeast"}\n')
    (d / "queries.jsonl").write_text('{"_id":"q1","text":"vitamin"}\n{"_id":"q2","text":"yeast"}\n{"_id":"q3","text":"unjudged"}\n')
    (d / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td2\t1.0\n")
    got = evaluate.run_eval(spark, str(d), str(d / "test.tsv"), HashingEmbedder(64))
    assert len(got) == 8 and all(r["queries"] == 2 for r in got) and got[0]["ndcg"] == 1.0 and got[4]["mrr"] == 1.0
    assert "| lexical |" in evaluate.report(got, "T")
    rows = evaluate.run_alpha_sweep(spark, str(d), str(d / "test.tsv"), HashingEmbedder(64), publish=f"{tmp_path}/sweep")
    evaluate.publish_report(spark, f"{tmp_path}/sweep", {"manifest.json": "{}"})
    assert len(rows) == 12 and rows[-1]["alpha"] == "rrf" and json.load(open(f"{tmp_path}/sweep/manifest.json")) == {}
    old = json.load(open(next(p for p in tmp_path.glob("sweep-before-*")) / "manifest.json"))
    assert old["results"] == rows and old["fingerprint"] == evaluate.dataset_fingerprint(spark, str(d), str(d / "test.tsv"))
    corpus = evaluate.build_corpus(beir.load_corpus(spark, str(d)), HashingEmbedder(64))
    sweep = evaluate.run_sweep(spark, corpus, [("q1", "vitamin"), ("q2", "yeast")], beir.load_qrels(spark, str(d / "test.tsv"))).collect()
    assert len(sweep) == 11 and all(0 <= r.ndcg <= 1 for r in sweep)
    smoke = evaluate.run_smoke(spark, corpus, [{"query": "vitamin", "relevant": ["d1"], "mode": "lexical"}, {"query": "zzz", "relevant": [], "mode": "lexical"}])
    assert smoke == {"hit": 1.0, "mrr": 1.0, "no_answer": 1.0}


def test_library_and_cli(spark, tmp_path, notes):
    said = []
    root = str(tmp_path / "lib")
    os.makedirs(root)
    go = lambda *a: cli(spark, [root, *a], said.append)
    go("create", "My Notes")
    go("index", str(notes))
    said.clear()
    go("search", "yeast", "-k", "2", "--mode", "lexical")
    assert json.loads(said[0])["doc_id"].startswith("deep/")
    said.clear()
    go("status")
    assert json.loads(said[0])["state"] == "ready"
    lib = Library(spark, root)
    assert lib.get("my notes")["id"] == slugify("My Notes") == "my-notes"
    lib.rename("my notes", "Other")
    go("backup")
    assert len(lib.backups("other")) == 1
    with pytest.raises(UsageError):
        lib.create("OTHER")
    lib.remove("other", delete=True)
    assert lib.list() == []


def test_sync(spark, tmp_path, notes):
    col = Collection.create(spark, str(tmp_path / "c"))
    col.ensure_root(str(notes))
    sync = watch.AutoSync(col)
    assert [sync.poll(str(notes)) for _ in range(3)] == ["changing", "synced", "unchanged"]
    (notes / "new.md").write_text("new text")
    assert [sync.poll(str(notes)) for _ in range(2)] == ["changing", "synced"]
    assert col.table("documents").where("doc_id = 'new.md'").count() == 1
    time_now = [0.0]
    failing = watch.AutoSync(col, 5.0, sync=lambda *a: 1 / 0, clock=lambda: time_now[0])
    (notes / "more.md").write_text("more")
    assert failing.tick() == ["changing"] and failing.tick() == []
    time_now[0] = 5.0
    assert failing.tick() == ["failed"] and failing.states[str(notes)].due == 15.0
    time_now[0] = 15.0
    with failing.preempt():
        other = threading.Thread(target=lambda: time_now.append(failing.tick()))
        other.start()
        other.join()
    assert time_now[1] == [] and failing.tick() == ["failed"] and failing.states[str(notes)].due == 35.0
    assert watch.backoff(5, 10) == 300 and watch.poll_interval(5, 2) == 80 and watch.vanished(5, 0) and not watch.vanished(4, 0)
    a, b = [("a", 1, 1)], [("a", 2, 1), ("b", 1, 1)]
    assert watch.diff(spark, a, b) == {"new": 1, "changed": 1, "deleted": 0}


def test_jobs(spark, tmp_path, notes):
    from tessera.plans.jobs import JobManager

    col, jobs = Collection.create(spark, str(tmp_path / "c")), JobManager()
    job = jobs.start_index(col, str(notes))
    with pytest.raises(ConflictError):
        jobs.start_index(col, str(notes))
    done = jobs.wait(job["id"], 120)
    assert done["status"] == "finished" and done["result"]["added"] == 4 and jobs.active_for(col.path) is None
    failed = jobs.wait(jobs.start_index(col, str(tmp_path / "missing.jsonl"))["id"], 60)
    assert failed["status"] == "failed" and failed["error"] and len(jobs.list()) == 2
    with pytest.raises(UsageError):
        jobs.get("x")


def test_export(spark, tmp_path, notes):
    import datetime as dt

    from tessera.plans import export

    col = Collection.create(spark, str(tmp_path / "c"))
    ingest_folder(col, str(notes))
    corpus = col.corpus()
    shown = results(search(spark, corpus, "yeast", mode="lexical"), corpus, "yeast").cache()
    assert "**yeast**" in export.to_markdown(shown, "yeast")
    assert json.loads(export.to_json(shown).first().json)["confidence"] == "strong"
    events = [json.loads(e) for e in export.search_events(spark, corpus, "yeast", mode="lexical")]
    assert [e["event"] for e in events] == ["stage", "stage", "result"] and len(events[-1]["hits"]) == 2
    assert json.loads(list(export.search_events(spark, corpus, " ", mode="lexical"))[-1])["event"] == "error"
    assert export.export_name("Wild Yeast!", "md", dt.date(2026, 1, 2)) == "search-wild-yeast-2026-01-02.md"
    assert export.date_preset("any") == {} and export.date_preset("day", dt.datetime.fromtimestamp(86400, dt.UTC)) == {"modified_after": 0.0}
