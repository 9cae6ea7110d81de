"""Folder counts and states that follow each batch, against a recount of the catalogue."""

import os
import shutil

from pyspark.sql import functions as F
from test_ingest import embedder, put

from threadlake.operators import folders as FO
from threadlake.sources import tables
from threadlake.streaming import ingest


def folder_rows(spark, data):
    """(path, total, status) as folder rows."""
    names = tables.FOLDER_SCHEMA.names
    rows = [{"path": p, "name": os.path.basename(p), "total_files": n, "indexed_files": 0, "status": s, "needs_rescan": False, "updated_at": 0} for p, n, s in data]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], tables.FOLDER_SCHEMA)


def counts(spark, base):
    return {r.path: r.indexed_files for r in tables.read_folders(spark, base).collect()}


def recounted(spark, base, folders_base):
    found = FO.recount_folders(tables.read_folders(spark, folders_base), tables.read_catalog(spark, base), now=0)
    return {r.path: r.indexed_files for r in found.collect()}


def states(spark, base):
    return {os.path.basename(r.path): (r.status, r.needs_rescan) for r in tables.read_folders(spark, base).collect()}


def test_counts_follow_scans_events_moves_and_redelivery(spark, tmp_path):
    root, base, fbase = (str(tmp_path / p) for p in ("lib", "table", "folders"))
    tables.write_snapshot(folder_rows(spark, [(f"{root}/a", 3, "Pending"), (f"{root}/a/deep", 9, "Pending"), (f"{root}/b", 5, "Stopped"), (root, 50, "In Progress")]), fbase)
    for name in ("a/1.emb", "a/deep/2.emb", "a/deep/3.emb", "b/4.emb", "b/bad.emb"):
        put(f"{root}/{name}", ("bad" if "bad" in name else name).encode(), 1_700_000_000)
    ingest.scan_library(spark, [root], base, embedder, now=1, folders_base=fbase)
    assert counts(spark, fbase) == {f"{root}/a": 3, f"{root}/a/deep": 2, f"{root}/b": 1, root: 4} == recounted(spark, base, fbase)
    assert states(spark, fbase) == {"a": ("Completed", False), "deep": ("Pending", False), "b": ("Stopped", False), "lib": ("In Progress", False)}
    # a move between folders, a removed file and a new one, told by events
    shutil.move(f"{root}/a/1.emb", f"{root}/b/moved.emb")
    os.remove(f"{root}/a/deep/2.emb")
    put(f"{root}/b/new.emb", b"new")
    log = [(f"{root}/{n}", op) for n, op in (("a/1.emb", "rename"), ("b/moved.emb", "create"), ("a/deep/2.emb", "remove"), ("b/new.emb", "create"))]
    events = spark.createDataFrame(log, "path string, op string").withColumn("last_ts", F.current_timestamp())
    ingest.apply_events(spark, base, events, 0, embedder, 2, "watch", folders_base=fbase)
    want = {f"{root}/a": 1, f"{root}/a/deep": 1, f"{root}/b": 3, root: 4}
    assert counts(spark, fbase) == want == recounted(spark, base, fbase)
    assert set(states(spark, fbase).values()) == {("Outdated", True)}
    # delivered again: nothing; delivered again after a stop between the two tables: completed
    ingest.apply_events(spark, base, events, 0, embedder, 2, "watch", folders_base=fbase)
    assert counts(spark, fbase) == want
    fs, path = tables._fs(spark, f"{fbase}/{tables.commits(spark, fbase)[-1].name}")
    fs.delete(path, True)
    assert counts(spark, fbase) != want
    ingest.apply_events(spark, base, events, 0, embedder, 2, "watch", folders_base=fbase)
    assert counts(spark, fbase) == want
    # content that overwrites another file, and a second scan over all of it
    put(f"{root}/b/4.emb", b"a/deep/3.emb", 1_700_000_100)
    ingest.scan_library(spark, [root], base, embedder, now=3, folders_base=fbase)
    assert counts(spark, fbase) == recounted(spark, base, fbase)
    tables.compact(spark, fbase, tables.FOLDER_SCHEMA)
    assert counts(spark, fbase) == recounted(spark, base, fbase)


def test_a_batch_writes_the_folders_it_changes(spark, tmp_path):
    fbase = str(tmp_path / "folders")
    tables.write_snapshot(folder_rows(spark, [(f"/r/{n}", 1, "Pending") for n in range(500)]), fbase)
    gone = spark.createDataFrame([("/r/3/x.emb",), ("/r/4/x.emb",), ("/none/x",)], "file_path string")
    added = spark.createDataFrame([("/r/3/y.emb",), ("/r/5/deep/y.emb",)], "file_path string")
    deltas = FO.count_deltas(gone, added)
    assert {(r.path, r.delta) for r in deltas.collect()} >= {("/r/4", -1), ("/r/5", 1), ("/r/5/deep", 1)}
    assert deltas.where("path = '/r/3'").count() == 0
    changed = FO.changed_folders(tables.read_folders(spark, fbase), deltas.withColumn("outdated", F.lit(False)), now=5)
    assert {(r.path, r.indexed_files, r.status) for r in changed.collect()} == {("/r/4", 0, "Pending"), ("/r/5", 1, "Completed")}
