"""Segments of stored tables, blocks of stored postings, and the walk over folders."""

import os
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import HashingEmbedder
from tessera.operators import lexical, postings
from tessera.plans.ingest import ingest_folder, scan_changes
from tessera.plans.search import search
from tessera.plans.store import Collection, Delta
from tessera.sources import files, walk


def pages(spark, n, seed=1, rare=13):
    """Documents in which one word is everywhere, some are common and some rare."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["every"] * rng.randint(1, 4) + [w for w, p in (("common", 0.5), ("often", 0.2), ("seldom", 0.02)) if rng.random() < p for _ in range(rng.randint(1, 3))]
        words += ["rare"] * (i % (n // rare) == 0) + [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30))]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, body string").repartition(4)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    docs = pages(spark, 6000).cache()
    fresh = lexical.build_index(docs)
    store_postings = postings.write
    lexical.postings.write = partial(postings.write, file_postings=4000)
    try:
        lexical.save_index(fresh, folder)
    finally:
        lexical.postings.write = store_postings
    return fresh, lexical.load_index(spark, folder), folder


QUERIES = [("a", "rare every"), ("b", "seldom common often"), ("c", "every common"), ("d", "w1 w2 w3 seldom"), ("e", "every missing"), ("f", "every every"), ("g", "nothing"), ("h", "often")]


def test_blocks_and_files_are_bounded(spark, stored):
    fresh, index, folder = stored
    blocks = index.store.blocks()
    sizes = {(r.term, r.slot): r for r in blocks.select("term", "slots", "slot", "n", F.size("docs").alias("m"), "max_tf", "min_len", F.array_max("tfs").alias("tf"), F.array_min("lens").alias("len")).collect()}
    assert all(r.n == r.m <= 2 * postings.BLOCK and r.max_tf == r.tf and r.min_len == r.len for r in sizes.values())
    of = [r for (t, _), r in sizes.items() if t == "every"]
    assert sum(r.n for r in of) == 6000 and {r.slots for r in of} == {64} and len(of) == 64
    # the word of every document lies in several files, and a search opens the files of its own words only
    per = [r["n"] for r in blocks.groupBy(F.col("_metadata.file_name")).agg(F.sum("n").alias("n")).collect()]
    assert len(per) > 8 and max(per) < 3 * 4000
    paths = lambda *terms: {p for f in index.store.folders for p in index.store._files(f, list(terms))}
    assert len(paths("every")) >= 2 and len(paths("rare")) <= 2 and len(paths("rare", "every")) < len(per)
    assert sorted(map(tuple, index.store.postings().collect())) == sorted(map(tuple, fresh.postings.select("term", "doc_id", "positions", "len").collect()))
    kept = postings.KEPT_RANGES
    postings.KEPT_RANGES, held = 0, dict(postings._ranges)
    postings._ranges.clear()
    try:  # ranges that the driver doesn't keep give the same files
        assert paths("every", "rare") == {p for f in index.store.folders for p in index.store._files(f, ["every", "rare"])} and not postings._ranges
    finally:
        postings.KEPT_RANGES = kept
        postings._ranges.update(held)


@pytest.mark.parametrize("match", ["any", "auto", "all"])
def test_skipping_blocks_changes_no_result(spark, stored, match, monkeypatch):
    fresh, index, _ = stored
    monkeypatch.setattr(postings, "SKIP_FROM", 0)
    for k, digits in ((10, 6), (400, None)):
        plain = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
        want = plain(lexical.lexical_search(spark, fresh, QUERIES, k, match, digits=digits).collect())
        assert plain(lexical.lexical_search(spark, index, QUERIES, k, match, digits=digits).collect()) == want and want
    some = fresh.lengths.where("doc_id % 7 = 1").select("doc_id")
    got, want = (plain(lexical.lexical_search(spark, i, QUERIES, 5, match, allowed=some).collect()) for i in (index, fresh))
    assert got == want


def test_blocks_that_are_skipped(spark, stored):
    _, index, _ = stored
    n_docs, avgdl = index.stats.first()
    counts = index.store.document_counts(["every", "rare", "common"])
    assert counts["every"] == 6000 and counts["rare"] == 14
    import math

    weigh = lambda q, *terms: [(q, i, t, len(terms), max(1e-6, math.log((n_docs - counts[t] + 0.5) / (counts[t] + 0.5)))) for i, t in enumerate(terms)]
    share = lambda *terms, k=10, match="any": postings.needed(index.store, weigh("q", *terms), counts, k, match, avgdl).count() / index.store.blocks(list(terms)).count()
    assert share("rare", "every") < 0.35 and share("rare", "common") < 0.6  # only the cells of the rare word
    assert share("rare", "every", match="all") < 0.35 and share("rare", "every", k=5000) == 1


def doc_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, title string, body string, content_hash string")


def written(col, since):
    """Bytes of files below the collection that are not in ``since``, and all files."""
    now = {os.path.join(d, f) for d, _, names in os.walk(col.path) for f in names}
    return sum(os.path.getsize(f) for f in now - since if "manifest" not in f), now


def same_as_fresh(spark, col, rows, path):
    fresh = Collection.create(spark, path)
    fresh.publish({t: d.rows for t, d in fresh.with_documents(doc_rows(spark, rows)).items()})
    asked = [("1", "every"), ("2", "word3 common"), ("3", "new"), ("4", "\"word3 every\"")]
    show = lambda c, match: sorted((h.qid, h.rank, h.doc_id, round(h.score, 9)) for h in search(spark, c.corpus(), asked, mode="lexical", match=match, k=7).collect())
    assert show(col, "any") == show(fresh, "any")
    assert col.integrity().first().ok and col.manifest["stats"] == fresh.manifest["stats"]
    for t, key in (("documents", ["doc_id", "body"]), ("passages", ["doc_id", "seq", "text"]), ("postings", ["term", "doc_id", "positions", "len"]), ("doc_stats", ["doc_id", "len"])):
        assert sorted(map(str, col.table(t).select(*key).collect())) == sorted(map(str, fresh.table(t).select(*key).collect()))


def test_a_small_change_writes_little(spark, tmp_path):
    rng = random.Random(2)
    rows = {f"d{i}": (f"d{i}", f"Title {i}", " ".join(["every"] + [f"word{rng.randrange(9)}" for _ in range(rng.randint(5, 900))] + ["common"] * (i % 2)), str(i)) for i in range(120)}
    col = Collection.create(spark, str(tmp_path / "c"))
    col.add_documents(doc_rows(spark, list(rows.values())))
    first, seen = written(col, set())
    created = {r.doc_id: r.created_at for r in col.table("documents").collect()}
    rows["d7"] = ("d7", "Changed", "new word3 every every", "x")
    rows["new"] = ("new", "New", "new common every", "y")
    col.add_documents(doc_rows(spark, [rows["d7"], rows["new"]]))
    second, seen = written(col, seen)
    assert second < first / 4 and all(len(e["segments"]) == 2 for e in col.manifest["tables"].values())
    assert {r.doc_id: r.created_at for r in col.table("documents").collect()}["d7"] == created["d7"]
    for gone in ("d7", "d9"):
        del rows[gone]
    col.remove_documents(spark.createDataFrame([("d7",), ("d9",), ("never",)], "doc_id string"))
    third, seen = written(col, seen)
    assert third < first / 10
    rows["d7"] = ("d7", "Back", "every new", "z")  # comes back after its burial
    col.add_documents(doc_rows(spark, [rows["d7"]]))
    same_as_fresh(spark, col, list(rows.values()), str(tmp_path / "f2"))
    col.backup(str(tmp_path / "b"))
    back = Collection.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))
    back.compact()
    assert all(len(e["segments"]) == 1 and not e["buried"] for e in back.manifest["tables"].values())
    same_as_fresh(spark, back, list(rows.values()), str(tmp_path / "f3"))


def test_segments_are_merged_as_they_pile_up(spark, tmp_path, monkeypatch):
    from tessera.plans import store

    monkeypatch.setattr(store, "FAN", 3)
    col, rows = Collection.create(spark, str(tmp_path / "c")), {}
    for i in range(5):
        for k in (i, i // 2):
            rows[f"d{k}"] = (f"d{k}", "", f"every word3 version{i} new", str(i))
        col.add_documents(doc_rows(spark, [rows[f"d{k}"] for k in {i, i // 2}]))
    assert all(len(e["segments"]) <= 3 for e in col.manifest["tables"].values())
    same_as_fresh(spark, col, list(rows.values()), str(tmp_path / "f"))
    before = col.manifest
    with pytest.raises(Exception, match="lost"):
        monkeypatch.setattr(col.files, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        col.publish({"documents": Delta(gone=spark.createDataFrame([("d1",)], "doc_id string"))})
    assert col.manifest == before


def test_a_restore_that_fails_leaves_the_old_collection(spark, tmp_path, monkeypatch):
    rows = [("a", "", "every old", "1")]
    old, other = Collection.create(spark, str(tmp_path / "old")), Collection.create(spark, str(tmp_path / "other"))
    old.add_documents(doc_rows(spark, rows))
    other.add_documents(doc_rows(spark, [("b", "", "every new", "2"), ("c", "", "every new", "3")]))
    other.backup(str(tmp_path / "b"))
    before, copy = old.manifest, type(old.files).copy
    monkeypatch.setattr(type(old.files), "copy", lambda self, a, b: None if "/b/" in a and "postings" in a else copy(self, a, b))
    with pytest.raises(Exception, match="not whole"):
        Collection.restore(spark, str(tmp_path / "b"), old.path, replace=True)
    assert old.manifest == before and old.integrity().first().ok and old.table("documents").count() == 1
    monkeypatch.undo()
    new = Collection.restore(spark, str(tmp_path / "b"), old.path, replace=True)
    assert new.manifest["version"] == before["version"] + 1 and new.integrity().first().ok and new.table("documents").count() == 2
    kept = next(p for p in tmp_path.iterdir() if p.name.startswith("old-before-restore"))
    assert Collection(spark, str(kept)).table("documents").count() == 1
    new.add_documents(doc_rows(spark, [("b", "", "again", "4")]))
    assert sorted(r.body for r in new.table("documents").collect()) == ["again", "every new"]


def test_a_rebuild_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rows = [(f"d{i}", "T", " ".join(f"w{k}." for k in range(8 + 30 * (i % 3))), str(i)) for i in range(40)]
    col = Collection.create(spark, str(tmp_path / "c"), chunking={"max_words": 40, "overlap_words": 0}, embedder=HashingEmbedder(16))
    col.embedder = HashingEmbedder(16)
    col.add_documents(doc_rows(spark, rows))
    before = {r.doc_id: r.text for r in col.table("passages").where("seq = 0").collect()}
    publish, calls = col.publish, []

    def failing(*a, **k):
        calls.append(k)
        if len(calls) == 3:
            raise OSError("lost")
        return publish(*a, **k)

    monkeypatch.setattr(col, "publish", failing)
    with pytest.raises(OSError):
        col.rebuild_passages({"max_words": 20, "overlap_words": 0}, buckets=4)
    assert col.manifest["rebuild"]["done"] == 2 and "\"max_words\":40" in col.manifest["chunking"]
    calls.clear()
    monkeypatch.setattr(col, "publish", lambda *a, **k: calls.append(a[0]) or publish(*a, **k))
    col.rebuild_passages({"max_words": 20, "overlap_words": 0}, buckets=9)  # the shares are those it began with
    assert len(calls) == 3 and col.manifest["rebuild"] is None and "\"max_words\":20" in col.manifest["chunking"]
    assert all(set(c) <= {"passages", "vectors"} for c in calls)  # documents and postings are not written again
    fresh = Collection.create(spark, str(tmp_path / "f"), chunking={"max_words": 20, "overlap_words": 0}, embedder=HashingEmbedder(16))
    fresh.embedder = HashingEmbedder(16)
    fresh.publish({t: d.rows for t, d in fresh.with_documents(doc_rows(spark, rows)).items()})
    for t in ("passages", "vectors"):
        assert sorted(map(str, col.table(t).collect())) == sorted(map(str, fresh.table(t).collect()))
    same = {r.doc_id for r in col.table("passages").where("seq = 0").collect() if r.text == before[r.doc_id]}
    assert {f"d{i}" for i in range(0, 40, 3)} <= same and col.integrity().first().ok


def test_stages_say_how_long_they_took(spark, tmp_path):
    from tessera.plans.search import search_with_outcome

    col = Collection.create(spark, str(tmp_path / "c"), chunking="off", embedder=HashingEmbedder(16))
    col.embedder = HashingEmbedder(16)
    col.add_documents(doc_rows(spark, [(f"d{i}", "T", f"every word{i % 3}", str(i)) for i in range(9)]))
    told = []
    asked = [("1", "every word1"), ("2", "missing")]
    hits, _ = search_with_outcome(spark, col.corpus(), asked, k=3, depth=5, match="any", rerank=True, timings=told)
    plain, _ = search_with_outcome(spark, col.corpus(), asked, k=3, depth=5, match="any", rerank=True)
    assert [t["stage"] for t in told] == ["parse", "lexical", "embed", "semantic", "fuse", "rerank"] and all(t["ms"] >= 0 for t in told)
    rows = {t["stage"]: t["rows"] for t in told}
    assert rows["lexical"] == 5 and rows["semantic"] == 10 and rows["rerank"] == hits.count()
    assert sorted(map(str, hits.collect())) == sorted(map(str, plain.collect()))


def closed_folder(name, excluded="secret"):
    def listing(folder):
        if folder.endswith("/" + name):
            raise PermissionError(13, "Permission denied")
        assert not folder.endswith("/" + excluded)  # never entered
        yield from walk.list_local(folder)

    return listing


def test_walk_lists_in_levels(spark, tmp_path):
    want = set()
    for i in range(30):
        at = tmp_path / "/".join(f"f{(i >> b) & 1}{b}" for b in range(1 + i % 5))
        at.mkdir(parents=True, exist_ok=True)
        (at / f"n {i}+é%20.md").write_text("x" * i)
        want.add((str((at / f"n {i}+é%20.md").relative_to(tmp_path)), i))
    for name in ("secret", "f00/closed", ".git"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "hidden.md").write_text("no")
    os.symlink(tmp_path, tmp_path / "f00" / "loop")
    for budget in (5000, 3):
        got = walk.walk(spark, str(tmp_path), [".*", "SECRET"], closed_folder("closed"), budget)
        rows = got.collect()
        assert {(r.path, r.size) for r in rows if r.kind == "file"} == want and len(rows) == len(want) + 1
        assert [(r.path, r.reason) for r in rows if r.kind == "unreadable"] == [("f00/closed", "PermissionError: Permission denied")]
        assert all(r.mtime_ns == os.stat(tmp_path / r.path).st_mtime_ns for r in rows if r.kind == "file")
        where = got.walk_path.removeprefix("file://")
        assert len([d for d in os.listdir(where) if d.startswith("level=")]) > (budget < 10)
        walk.forget(got)
        assert not os.path.exists(where)
    with pytest.raises(FileNotFoundError):
        walk.walk(spark, str(tmp_path / "missing"), [])


def test_what_cannot_be_read_is_not_gone(spark, tmp_path, monkeypatch):
    root = tmp_path / "notes"
    for name in ("a.md", "deep/b.md", "deep/er/c.md", "other/d.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    col = Collection.create(spark, str(tmp_path / "c"))
    assert ingest_folder(col, str(root))["added"] == 4
    (root / "deep" / "b.md").unlink()
    (root / "other" / "d.md").unlink()
    plain = walk.walk
    monkeypatch.setattr(files.walk, "walk", partial(plain, listing=closed_folder("deep")))
    assert {r.path: r.change for r in scan_changes(col, 1).collect()} == {"a.md": "unchanged", "other/d.md": "deleted"}
    out = ingest_folder(col, str(root))
    assert (out["removed"], out["unreadable"], out["unchanged"]) == (1, 1, 1)
    assert {r.doc_id for r in col.table("documents").collect()} == {"a.md", "deep/b.md", "deep/er/c.md"}
    monkeypatch.setattr(files.walk, "walk", partial(plain, listing=closed_folder("notes")))  # the root itself
    assert ingest_folder(col, str(root))["removed"] == 0 and scan_changes(col, 1).count() == 0
    monkeypatch.setattr(files.walk, "walk", plain)
    out = ingest_folder(col, str(root))
    assert out["removed"] == 1 and "unreadable" not in out and col.table("documents").count() == 2
    assert not os.path.isdir(tmp_path / "c" / "staged") or not os.listdir(tmp_path / "c" / "staged")


@pytest.mark.parametrize("most", [4096, 1])
def test_stores_that_only_spark_reaches(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(files, "MAX_PATHS", most)
    for name in ("a.md", "deep/b 1+é%20[x].md", ".git/c.md"):
        (tmp_path / "notes" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "notes" / name).write_text(f"text of {name}")
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.far{most}.link./in", f"file://{tmp_path}/notes")
    where = f"viewfs://far{most}/in"
    assert walk.local_path(spark, where) is None
    col = Collection.create(spark, str(tmp_path / "c"))
    assert ingest_folder(col, where)["added"] == 2 and ingest_folder(col, where)["unchanged"] == 2
    assert {r.doc_id: r.body for r in col.table("documents").collect()} == {n: f"text of {n}" for n in ("a.md", "deep/b 1+é%20[x].md")}
    (tmp_path / "notes" / "a.md").write_text("changed")
    assert {r.path: r.change for r in scan_changes(col, 1).collect()} == {"a.md": "changed", "deep/b 1+é%20[x].md": "unchanged"}


def test_a_run_that_was_lost_is_closed_by_the_next(spark, tmp_path):
    from tessera.errors import ConflictError
    from tessera.plans import ingest

    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("text")
    col = Collection.create(spark, str(tmp_path / "c"))
    with ingest.running(col, str(root)) as lost:
        assert lost is None
        with pytest.raises(ConflictError):
            ingest_folder(col, str(root))
    assert not os.path.exists(tmp_path / "c" / "run.json") and col.table("documents").count() == 0
    col.files.create(f"{col.path}/run.json", '{"root_path": "/x", "started_at": 5, "token": "t"}')
    os.utime(tmp_path / "c" / "run.json", (1, 1))
    assert ingest_folder(col, str(root))["added"] == 1
    assert [(r.id, r.root_path, r.status, r.added) for r in col.table("runs").orderBy("id").collect()] == [(1, "/x", "interrupted", None), (2, str(root), "ok", 1)]
    assert not os.path.exists(tmp_path / "c" / "run.json")


def test_what_a_collection_says_of_itself(spark, tmp_path, monkeypatch):
    import time

    from tessera.operators import analytics
    from tessera.operators.filters import SearchFilters
    from tessera.plans.ingest import scan_all

    health = spark.createDataFrame([(3, 0), (3, 5), (0, 0)], "documents long, vectors long")
    assert [(r.modes, r.precisions) for r in analytics.capabilities(health, True).collect()] == [(["lexical"], []), (["lexical", "semantic", "hybrid"], ["float", "binary"]), ([], [])]
    assert analytics.capabilities(health.drop("vectors"), False, True).first().precisions == ["int8"]
    docs = spark.createDataFrame([(f"d{i:02}", "t" * (i % 3), "h" if i < 30 else str(i)) for i in range(34)], "doc_id string, title string, content_hash string")
    passages = docs.select("doc_id", F.lit("12345678").alias("text"))
    assert analytics.beyond_model(docs, passages, 2).first().long_documents == 22 and analytics.beyond_model(docs, passages, 3).first().long_documents == 0
    seen = {r.doc_id: r for r in analytics.document_view(docs.withColumn("body", F.lit("x")), ids=spark.createDataFrame([("d05",), ("d29",), ("d33",)], "doc_id string")).collect()}
    assert (seen["d05"].n_duplicates, len(seen["d05"].duplicates), "d05" in seen["d05"].duplicates) == (29, 20, False)
    assert seen["d29"].duplicates == [f"d{i:02}" for i in range(20)] and (seen["d33"].n_duplicates, seen["d33"].duplicates) == (0, None)
    monkeypatch.setenv("TZ", "Europe/Berlin")
    time.tzset()
    try:  # the day the clocks change has 23 hours
        day = SearchFilters(modified_after="2026-03-29", modified_before="2026-03-29")
        assert day.modified_after == 1774738800.0 and day.modified_before == pytest.approx(1774738800 + 23 * 3600 - 0.001)
        assert SearchFilters(modified_after="2026-01-10T12:00:00Z").modified_after == 1768046400.0 and SearchFilters(modified_before="9999-12-31").modified_before > 2e11
    finally:
        monkeypatch.delenv("TZ")
        time.tzset()
    col = Collection.create(spark, str(tmp_path / "c"))
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.md").write_text(name)
        ingest_folder(col, str(tmp_path / name))
    (tmp_path / "x" / "b.md").write_text("more")
    (tmp_path / "y").rename(tmp_path / "z")
    assert sorted((r.root_id, r.path or "", r.change) for r in scan_all(col).collect()) == [(1, "a.md", "unchanged"), (1, "b.md", "new"), (2, "", "missing")]
