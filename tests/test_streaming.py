"""Folders as a stream of changes, and the state that settles them."""

import os
import time

import pytest

from tessera.plans.ingest import ingest_folder
from tessera.plans.store import Collection
from tessera.sources import walk
from tessera.streaming import source, watch


def changes(reader, start, end):
    rows = [r for p in reader.partitions({"poll": start}, {"poll": end}) for r in reader.read(p)]
    return sorted((r[1], r[2]) for r in rows)


def test_polls_give_each_change_once(tmp_path):
    root = tmp_path / "r"
    for name in ("a.md", "one/b.md", "one/two/c.md", "one/two/three/d.md", "skip/e.md", "one/f.pdf"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    for buckets in (1, 5):
        state = f"file://{tmp_path}/s{buckets}"
        source.watch_roots(state, {str(root): ("SKIP",)})
        reader = source.FolderReader({"state": state, "buckets": str(buckets)})
        first = [("a.md", "new"), ("one/b.md", "new"), ("one/two/c.md", "new"), ("one/two/three/d.md", "new")]
        assert changes(reader, 0, 10) == first
        (root / "a.md").write_text("longer text")
        (root / "one" / "two" / "c.md").unlink()
        (root / "one" / "g.txt").write_text("g")
        assert changes(reader, 0, 10) == first  # the same poll again, after a lost task: the same rows
        second = [("a.md", "changed"), ("one/g.txt", "new"), ("one/two/c.md", "deleted")]
        assert changes(reader, 10, 20) == second == changes(reader, 10, 20) and changes(reader, 20, 30) == []
        assert reader.latestOffset()["poll"] > 30 and reader.initialOffset() == {"poll": 0}

        def closed(folder):
            if folder.endswith("/two"):
                raise PermissionError(13, "Permission denied")
            yield from walk.list_local(folder)

        reader.listing = closed
        assert changes(reader, 30, 40) == [("one/two", "unreadable")]
        reader.listing = walk.list_local
        assert changes(reader, 40, 50) == []
        reader.commit({"poll": 50})
        assert {f.split("-")[-1] for f in os.listdir(tmp_path / f"s{buckets}")} == {"50.parquet", "roots.json"}
        (root / "a.md").write_text("a.md")
        (root / "one" / "two" / "c.md").write_text("one/two/c.md")
        (root / "one" / "g.txt").unlink()


def until(query, rows, what, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        if any(r[1] == what for r in rows):
            return
        time.sleep(0.2)
    pytest.fail(f"{what} did not come: {rows}")


def test_a_change_settles_over_a_restart(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.md").write_text("x")
    rows = []
    source.watch_roots(f"file://{tmp_path}/state", {str(root): ()})

    def start(hold):
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        stream = source.settled(source.folder_changes(spark, f"file://{tmp_path}/state", 2), hold)
        return stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda df, n: rows.extend((r.root, r.action, r.files) for r in df.collect())).trigger(processingTime="500 milliseconds").start()

    before = spark.conf.get("spark.sql.shuffle.partitions")
    query = start(4)
    try:
        until(query, rows, "changing")
        assert not any(r[1] == "sync" for r in rows)
        query.stop()  # between the poll that saw the change and the one that settles it
        query = start(4)
        until(query, rows, "sync")
        assert [r[1:] for r in rows] == [("changing", 6), ("sync", 6)]
        for p in root.iterdir():
            p.unlink()
        until(query, rows, "vanished")
        time.sleep(6)
        assert [r[1:] for r in rows] == [("changing", 6), ("sync", 6), ("vanished", 0)]
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_collection_keeps_itself_in_step(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.md").write_text("first text")
    col = Collection.create(spark, str(tmp_path / "c"))
    ingest_folder(col, str(root))
    calls = []

    def sync(c, path, exclude):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("not now")
        return ingest_folder(c, path, exclude)

    keeper = watch.AutoSync(col, 1.0, sync=sync)
    keeper.start()
    try:
        assert keeper.start() is keeper and col.preference("auto_sync")
        (root / "b.md").write_text("second text")
        end = time.time() + 120
        while time.time() < end and not (("b.md",) in [tuple(r) for r in col.table("documents").select("doc_id").collect()] and col.preference("sync_failed") == []):
            if keeper.query.exception():
                raise keeper.query.exception()
            time.sleep(0.5)
        assert sorted(r.doc_id for r in col.table("documents").collect()) == ["a.md", "b.md"] and len(calls) >= 2 and set(calls) == {str(root)}
        assert [w for _, w in keeper.log if w in ("failed", "synced")][:2] == ["failed", "synced"]
    finally:
        keeper.stop(forget=True)
    assert not col.preference("auto_sync")
