import datetime as dt
import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from threadlake.functions import scalars as S
from threadlake.sources import files as FS
from threadlake.sources import tables
from threadlake.streaming import events as EV
from threadlake.streaming import ingest


def put(path, data: bytes, mtime: int | None = None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)
    if mtime:
        os.utime(path, (mtime, mtime))


def fingerprint(data: bytes) -> str:
    return hashlib.sha256(str(len(data)).encode() + data[: 2 * 1024 * 1024]).hexdigest()


def embedder(contents):
    text = F.col("content").cast("string")
    vec = F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    return contents.select("id", F.when(~text.startswith("bad"), vec).alias("embedding"))


def test_scan_listing(spark, rows, tmp_path):
    root = str(tmp_path / "lib")
    for name in ("a.emb", "sub/b.EMB", "sub/c.eMb", "x.jpg", ".hid/d.emb", "node_modules/e.emb", "sub/__pycache__/f.emb", "emb"):
        put(f"{root}/{name}", b"data", 1_700_000_000)
    got = FS.scan_files(spark, [root, f"{root}/sub"])
    assert rows(got, "file_path", "size_bytes", "file_mtime", "size_kb") == [
        (f"{root}/a.emb", 4, 1_700_000_000, 4 / 1024),
        (f"{root}/sub/b.EMB", 4, 1_700_000_000, 4 / 1024),
        (f"{root}/sub/c.eMb", 4, 1_700_000_000, 4 / 1024),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    everything = rows(FS.scan_files(spark, [root], skip_hidden=False), "file_path")
    assert (f"{root}/node_modules/e.emb",) in everything
    roots = spark.createDataFrame([(root,), (f"{root}/sub",), ("/none",)], "path string")
    assert rows(FS.root_totals(got, roots), "path", "total_files") == [("/none", 0), (root, 3), (f"{root}/sub", 2)]
    assert rows(FS.scan_eval_set(got, root), "file_path") == [(f"{root}/a.emb",)]


def test_fingerprints_use_size_and_the_first_two_mebibytes(spark, tmp_path):
    big = b"a" * (2 * 1024 * 1024) + b"tail"
    other = b"a" * (2 * 1024 * 1024) + b"TAIL"
    for name, data in (("1.emb", big), ("2.emb", other), ("3.emb", b"a"), ("4.emb", b"")):
        put(f"{tmp_path}/{name}", data)
    listed = FS.walk_files(spark, [str(tmp_path)])
    gone = listed.where("file_path like '%3.emb'").withColumn("file_path", F.lit(f"{tmp_path}/none.emb"))
    ids = {os.path.basename(r["file_path"]): r["id"] for r in FS.fingerprint_files(listed.unionAll(gone)).collect()}
    assert ids["1.emb"] == ids["2.emb"] == fingerprint(big)
    assert ids["3.emb"] == fingerprint(b"a") and ids["4.emb"] == fingerprint(b"") and ids["none.emb"] is None
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.emb").load(str(tmp_path))
    same = {os.path.basename(r[0]): r[1] for r in content.select("path", S.content_id("length", "content")).collect()}
    # Spark's listing leaves out the empty file
    assert same == {k: v for k, v in ids.items() if k not in ("none.emb", "4.emb")}


def test_walk_finds_what_the_listing_leaves_out(spark, rows, tmp_path):
    root = str(tmp_path / "lib")
    for name in ("a.emb", "x/y/z/b.EMB", "_u/c.emb", "x/_d.emb", "x/.e.emb", ".h/f.emb", "x/.git/g.emb", "x/n.jpg", "x/__pycache__/h.emb"):
        put(f"{root}/{name}", b"data", 1_700_000_000)
    put(f"{root}/x/empty.emb", b"", 1_700_000_000)
    got = FS.walk_files(spark, [root, f"{root}/x"])
    want = ["_u/c.emb", "a.emb", "x/.e.emb", "x/_d.emb", "x/empty.emb", "x/y/z/b.EMB"]
    assert rows(got, "file_path", "file_mtime") == [(f"{root}/{n}", 1_700_000_000) for n in want]
    listed = {r[0] for r in rows(FS.scan_files(spark, [root]), "file_path")}
    assert listed == {f"{root}/a.emb", f"{root}/x/y/z/b.EMB"}
    assert FS.walk_files(spark, [f"{root}/.h"]).count() == 0
    assert FS.walk_files(spark, [f"{root}/none"]).count() == 0


def scan(spark, root, base, batch, force=False, deleted=None):
    """A library scan: fingerprints only for files whose listing changed."""
    listing = FS.scan_files(spark, [root])
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    content = content.select(FS.plain_path("path").alias("file_path"), "content")
    files = FS.fingerprint_files(listing).join(content, "file_path").select(
        F.col("file_path").alias("seq"), "file_path", "file_mtime", "size_kb", "id", "content"
    )
    out = ingest.apply_changes(spark, base, files, batch, embedder, now=batch * 100, force=force, deleted=deleted)
    return {os.path.relpath(r["file_path"], root): r["outcome"] for r in out.collect()}


def state(spark, base, root):
    got = tables.read_catalog(spark, base).collect()
    assert len({r["id"] for r in got}) == len({r["file_path"] for r in got}) == len(got)
    return {os.path.relpath(r["file_path"], root): (r["id"][:6], r["indexed_at"]) for r in got}


def test_library_scans(spark, tmp_path):
    root, base = str(tmp_path / "lib"), str(tmp_path / "table")
    put(f"{root}/a.emb", b"one")
    put(f"{root}/s/b.emb", b"second")
    put(f"{root}/bad.emb", b"bad file")
    assert scan(spark, root, base, 1) == {"a.emb": "indexed", "s/b.emb": "indexed", "bad.emb": "failed"}
    one, second = fingerprint(b"one")[:6], fingerprint(b"second")[:6]
    assert state(spark, base, root) == {"a.emb": (one, 100), "s/b.emb": (second, 100)}
    # again: nothing to do but the broken file
    assert scan(spark, root, base, 2) == {"a.emb": "skipped", "s/b.emb": "skipped", "bad.emb": "failed"}
    # a move, a change and a copy
    shutil.move(f"{root}/a.emb", f"{root}/moved.emb")
    put(f"{root}/s/b.emb", b"changed", 1_600_000_000)
    put(f"{root}/t/copy.emb", b"changed")
    got = scan(spark, root, base, 3)
    assert got == {"moved.emb": "moved", "s/b.emb": "indexed", "t/copy.emb": "moved", "bad.emb": "failed"}
    changed = fingerprint(b"changed")[:6]
    assert state(spark, base, root) == {"moved.emb": (one, 100), "t/copy.emb": (changed, 300)}
    # the same batch again changes nothing
    assert scan(spark, root, base, 3) == got
    before = state(spark, base, root)
    tables.compact(spark, base)
    assert state(spark, base, root) == before
    # a deletion in the batch after the compaction
    os.remove(f"{root}/moved.emb")
    gone = spark.createDataFrame([(f"{root}/moved.emb",)], "file_path string")
    scan(spark, root, base, 4, deleted=gone)
    assert "moved.emb" not in state(spark, base, root)
    leftovers = [d for d in os.listdir(spark.conf.get("spark.checkpoint.dir")) if d.startswith("staging-")]
    assert leftovers == []


def test_stream_picks_up_new_files_and_goes_on_after_a_restart(spark, tmp_path):
    root, base, mark = (str(tmp_path / p) for p in ("in", "table", "mark"))
    put(f"{root}/a.emb", b"one", 1_700_000_000)
    put(f"{root}/s/b.EMB", b"two", 1_700_000_001)
    put(f"{root}/x.jpg", b"no", 1_700_000_001)
    log = []

    def run():
        def keep(outcomes, batch):
            log.append(sorted((os.path.basename(r["file_path"]), r["outcome"]) for r in outcomes.collect()))

        ingest.ingest_stream(
                spark, root, base, embedder, mark, on_outcomes=keep, compact_every=2
            ).awaitTermination()

    run()
    assert log == [[("a.emb", "indexed"), ("b.EMB", "indexed")]]
    # the last file seen vanishes, a new one and a copy of known content arrive
    os.remove(f"{root}/s/b.EMB")
    put(f"{root}/c.emb", b"three", 1_700_000_002)
    put(f"{root}/d.emb", b"one", 1_700_000_003)
    run()
    assert log[1:] == [[("c.emb", "indexed"), ("d.emb", "moved")]]
    assert set(state(spark, base, root)) == {"s/b.EMB", "c.emb", "d.emb"}


def test_snapshots_and_folder_events(spark, rows, tmp_path):
    base = str(tmp_path / "folders")
    first = spark.createDataFrame([("/a", "a", 1, 1, "", "Completed", False, 0, 0)], tables.FOLDER_SCHEMA)
    assert tables.read_folders(spark, base).count() == 0
    tables.write_snapshot(first, base)
    ev = spark.createDataFrame([("/a/x.emb",)], "path string")
    ingest.outdated_batch(spark, base, ev, 5)
    assert rows(tables.read_folders(spark, base, "/a"), "status", "needs_rescan") == [("Outdated", True)]
    tables.write_snapshot(first, base)
    # an old batch delivered again must not run once more
    ingest.outdated_batch(spark, base, ev, 5)
    assert rows(tables.read_folders(spark, base), "status") == [("Completed",)]
    # an unfinished snapshot is not read
    os.makedirs(f"{base}/snapshot-000000000099")
    assert rows(tables.read_folders(spark, base), "status") == [("Completed",)]
    copy = tables.snapshot(first, base, "2024-01-01_00-00-00")
    assert copy == f"{base}.backup-2024-01-01_00-00-00" and spark.read.parquet(copy).count() == 1


def test_compaction_and_expiry(spark, rows, tmp_path):
    base = str(tmp_path / "t")
    schema = "id string, file_path string"

    def frame(*data):
        return spark.createDataFrame(list(data), schema)

    def read():
        return rows(tables.read_snapshot(spark, base, frame().schema), "id", "file_path")

    tables.write_snapshot(frame(("a", "/1"), ("b", "/2")), base)
    for n in range(1, 7):
        row = frame((f"n{n}", f"/n{n}"), ("a", f"/a{n}"))
        assert tables.write_delta(row, row, row, base, n)
        before = read()
        if n % 2 == 0:
            tables.compact(spark, base, row.schema)
            tables.expire(spark, base)
        assert read() == before
        # the last batch again
        assert not tables.write_delta(row, row, row, base, n)
    assert read() == [("a", "/a6"), ("b", "/2"), *[(f"n{n}", f"/n{n}") for n in range(1, 7)]]
    assert tables.versions(spark, base) == [(4, "snapshot"), (5, "delta"), (6, "delta"), (6, "snapshot")]


def test_media_leave_the_catalogue(spark, rows):
    data = spark.createDataFrame(
        [("a", bytearray(b"p"), None), ("b", None, bytearray(b"t"))], "id string, preview_png binary, thumbnail binary"
    )
    slim, media = tables.split_media(data)
    assert rows(slim) == [("a", True), ("b", False)]
    assert media.columns == ["id", "preview_png", "thumbnail"]


def test_watch_stream(spark, rows, tmp_path):
    root, base, source, mark = (str(tmp_path / p) for p in ("lib", "table", "events", "mark"))
    for name, data in (("a.emb", b"one"), ("b.emb", b"two"), ("c.emb", b"three"), ("c.jpg", b"-")):
        put(f"{root}/{name}", data, 1_700_000_000)
    scan(spark, root, base, 1)
    # b is deleted, a moves to d, e appears and is written twice, c's companion changes
    os.remove(f"{root}/b.emb")
    shutil.move(f"{root}/a.emb", f"{root}/d.emb")
    put(f"{root}/e.emb", b"fresh")
    put(f"{root}/c.emb", b"three, changed", 1_700_000_000)
    log = [
        ("b.emb", "remove", 0), ("a.emb", "rename", 1), ("d.emb", "create", 1.1), ("e.emb", "create", 2),
        ("e.emb", "write", 2.2), ("c.jpg", "write", 3), ("x.txt", "write", 3), ("orphan.png", "write", 3),
        ("later.emb", "write", 60),
    ]
    start = dt.datetime(2024, 1, 1)
    data = [(f"{root}/{n}", op, start + dt.timedelta(seconds=s), i) for i, (n, op, s) in enumerate(log)]
    spark.createDataFrame(data, EV.EVENT_SCHEMA).coalesce(1).write.parquet(source)
    ingest.watch_stream(
        spark, EV.read_events(spark, source), base, embedder, mark, first_batch=10, settle="trigger", availableNow=True
    ).awaitTermination()
    got = state(spark, base, root)
    assert set(got) == {"c.emb", "d.emb", "e.emb"}
    assert got["d.emb"] == (fingerprint(b"one")[:6], 100)
    assert got["c.emb"][0] == fingerprint(b"three, changed")[:6]


def test_streams_share_one_table(spark, tmp_path):
    """Both streams with their defaults, a fresh checkpoint, and an imported snapshot."""
    root, base, source = (str(tmp_path / p) for p in ("lib", "table", "events"))
    old = spark.createDataFrame([("x", f"{root}/x.emb", "x.emb", "emb", 1.0, 1, True, [1.0], None, 1)], tables.CATALOG_SCHEMA)
    tables.write_snapshot(old, base, 5)
    put(f"{root}/a.emb", b"one", 1_700_000_000)
    ingest.ingest_stream(spark, root, base, embedder, str(tmp_path / "m1")).awaitTermination()
    assert set(state(spark, base, root)) == {"x.emb", "a.emb"}
    put(f"{root}/b.emb", b"two", 1_700_000_001)
    start = dt.datetime(2024, 1, 1)
    data = [(f"{root}/b.emb", "create", start, 0), (f"{root}/x.emb", "remove", start, 1), (f"{root}/later.emb", "write", start + dt.timedelta(minutes=1), 2)]
    spark.createDataFrame(data, EV.EVENT_SCHEMA).coalesce(1).write.parquet(source)
    ingest.watch_stream(spark, EV.read_events(spark, source), base, embedder, str(tmp_path / "m2"), settle="trigger", availableNow=True).awaitTermination()
    assert set(state(spark, base, root)) == {"a.emb", "b.emb"}
    # a fresh checkpoint delivers everything once more
    put(f"{root}/c.emb", b"three", 1_700_000_002)
    ingest.ingest_stream(spark, root, base, embedder, str(tmp_path / "m3")).awaitTermination()
    assert set(state(spark, base, root)) == {"a.emb", "b.emb", "c.emb"}


def test_compaction_never_rewrites_what_it_reads(spark, rows, tmp_path):
    base = str(tmp_path / "t")
    row = spark.createDataFrame([("a", "/1")], "id string, file_path string")
    assert tables.compact(spark, base, row.schema) is None
    assert tables.write_delta(row, row, row, base, 0, "s")
    assert tables.compact(spark, base, row.schema) is not None
    for _ in range(2):
        # nothing is newer; a batch delivered again after its compaction changes nothing
        assert tables.compact(spark, base, row.schema) is None
        assert not tables.write_delta(row, row, row, base, 0, "s")
    # the same number from another stream is another batch
    other = spark.createDataFrame([("b", "/2")], row.schema)
    assert tables.write_delta(other, other, other, base, 0, "t")
    assert rows(tables.read_snapshot(spark, base, row.schema), "id") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        tables.write_snapshot(row, base, 0)
    # marks outlive the deltas, outcomes of the last batch of a stream too
    tables.write_outcomes(row.withColumn("outcome", F.lit("indexed")), base, 0, "s")
    for n in range(1, 4):
        tables.write_outcomes(row.withColumn("outcome", F.lit("indexed")), base, n, "t")
        assert tables.write_delta(other, other, other, base, n, "t")
        tables.compact(spark, base, row.schema)
        tables.expire(spark, base)
    assert tables.marks(spark, base) == {"s": 0, "t": 3}
    assert not tables.write_delta(row, row, row, base, 0, "s")
    assert tables.read_outcomes(spark, base, 0, "s").count() == 1
    assert tables.read_outcomes(spark, base, 1, "t").count() == 0


def test_folder_marks_are_counted_by_stream(spark, rows, tmp_path):
    base = str(tmp_path / "folders")
    first = spark.createDataFrame([("/a", "a", 1, 1, "", "Completed", False, 0, 0)], tables.FOLDER_SCHEMA)
    tables.write_snapshot(first, base, 7)
    ingest.outdated_batch(spark, base, spark.createDataFrame([("/a/x.emb",)], "path string"), 0, "s")
    assert rows(tables.read_folders(spark, base), "status") == [("Outdated",)]


def test_scan_library(spark, tmp_path):
    """Old, changed, empty, underscored and tool files; contents are read once each."""
    root, base = str(tmp_path / "lib"), str(tmp_path / "table")
    put(f"{root}/a.emb", b"one", 1_700_000_000)
    put(f"{root}/_old/_b.emb", b"two", 1_000_000_000)
    put(f"{root}/empty.emb", b"", 1_700_000_000)
    put(f"{root}/copy.emb", b"one", 1_700_000_001)
    put(f"{root}/node_modules/n.emb", b"no", 1_700_000_000)
    put(f"{root}/bad.emb", b"bad file", 1_700_000_000)
    read = spark.sparkContext.accumulator(0)

    def counting(contents):
        contents.foreach(lambda r: read.add(1))
        return embedder(contents)

    def run(**more):
        found = ingest.scan_library(spark, [root], base, counting, **more).collect()
        return {os.path.relpath(r["file_path"], root): r["outcome"] for r in found}

    first = {"a.emb": "indexed", "copy.emb": "moved", "_old/_b.emb": "indexed", "empty.emb": "indexed", "bad.emb": "failed"}
    assert run() == first and read.value == 4
    assert set(state(spark, base, root)) == {"copy.emb", "_old/_b.emb", "empty.emb"}
    # a file rewritten under its path, an old one that comes in late
    put(f"{root}/_old/_b.emb", b"two, changed", 1_000_000_005)
    put(f"{root}/late.emb", b"three", 900_000_000)
    os.remove(f"{root}/a.emb")
    assert run() == {"copy.emb": "skipped", "empty.emb": "skipped", "_old/_b.emb": "indexed", "late.emb": "indexed", "bad.emb": "failed"}
    assert read.value == 7
    assert state(spark, base, root)["_old/_b.emb"][0] == fingerprint(b"two, changed")[:6]
    before = state(spark, base, root)
    assert run(batch_id=1)["late.emb"] == "indexed" and state(spark, base, root) == before


def test_whole_contents_tell_long_files_apart(spark, tmp_path):
    head = b"a" * (5 * 1024 * 1024)
    put(f"{tmp_path}/1.emb", head + b"x")
    put(f"{tmp_path}/2.emb", head + b"y")
    listed = FS.walk_files(spark, [str(tmp_path)])
    assert FS.fingerprint_files(listed).select("id").distinct().count() == 1
    assert FS.fingerprint_files(listed, prefix_bytes=None).select("id").distinct().count() == 2


def test_scans_keep_long_files_with_equal_heads(spark, tmp_path):
    head = b"a" * (2 * 1024 * 1024)
    for name in ("x", "y"):
        put(f"{tmp_path}/lib/{name}.emb", head + name.encode(), 1_700_000_000)
    want = {f"{tmp_path}/lib/{name}.emb" for name in ("x", "y")}
    ids = {hashlib.sha256(str(len(head) + 1).encode() + head + name.encode()).hexdigest() for name in ("x", "y")}
    for base, given in (("whole", {}), ("short", {"prefix_bytes": S.FINGERPRINT_BYTES})):
        at = str(tmp_path / base)
        for _ in range(2):
            ingest.scan_library(spark, [f"{tmp_path}/lib"], at, embedder, now=5, **given)
        found = tables.read_catalog(spark, at).collect()
        assert ({r["file_path"] for r in found} == want) == (base == "whole")
        assert ({r["id"] for r in found} == ids) == (base == "whole")
    paths = spark.createDataFrame([(p,) for p in want], "file_path string")
    assert {r["id"] for r in FS.load_files(paths).select("id").collect()} == ids


def test_library_stream(spark, tmp_path):
    root, base, mark = (str(tmp_path / p) for p in ("lib", "table", "mark"))
    put(f"{root}/a.emb", b"one", 1_700_000_000)
    seen = []
    query = ingest.library_stream(spark, [root], base, embedder, mark, every="1 second", on_outcomes=lambda o, n: seen.append(o.count()))
    try:
        deadline = dt.datetime.now() + dt.timedelta(seconds=90)
        while not seen and query.isActive and dt.datetime.now() < deadline:
            query.awaitTermination(1)
    finally:
        query.stop()
    assert seen and set(state(spark, base, root)) == {"a.emb"}


def test_watch_stream_needs_no_later_event(spark, tmp_path):
    """The last burst is applied, and so is an event far behind the others."""
    root, base, source, mark = (str(tmp_path / p) for p in ("lib", "table", "events", "mark"))
    for name in ("a.emb", "b.emb"):
        put(f"{root}/{name}", name.encode(), 1_700_000_000)
    ingest.scan_library(spark, [root], base, embedder)
    start = dt.datetime(2024, 1, 1)
    put(f"{root}/c.emb", b"three")

    def run(*log):
        data = [(f"{root}/{n}", op, start + dt.timedelta(seconds=s), i) for i, (n, op, s) in enumerate(log)]
        spark.createDataFrame(data, EV.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.watch_stream(spark, EV.read_events(spark, source), base, embedder, mark, settle="trigger", availableNow=True).awaitTermination()

    run(("c.emb", "create", 3600), ("c.emb", "write", 3600.1))
    assert set(state(spark, base, root)) == {"a.emb", "b.emb", "c.emb"}
    os.remove(f"{root}/a.emb")
    run(("a.emb", "remove", 0))
    assert set(state(spark, base, root)) == {"b.emb", "c.emb"}


class Watched:
    """A library under a running watch stream whose encoder notes what it is given."""

    def __init__(self, spark, tmp_path):
        self.spark = spark
        self.root, self.base, self.source, self.mark = (str(tmp_path / p) for p in ("lib", "table", "events", "mark"))
        self.notes = str(tmp_path / "notes")
        os.makedirs(self.source)

    def encode(self, contents):
        seen = contents.select("id", F.col("content").cast("string").alias("text"))
        seen.write.mode("append").parquet(self.notes)
        return embedder(contents)

    def encoded(self):
        return sorted(r.text for r in self.spark.read.schema("id string, text string").parquet(self.notes).collect())

    def send(self, *log):
        now = dt.datetime.now()
        data = [(f"{self.root}/{n}", op, now + dt.timedelta(milliseconds=i), i) for i, (n, op) in enumerate(log)]
        self.spark.createDataFrame(data, EV.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(self.source)

    def start(self, **how):
        self.spark.conf.set("spark.sql.shuffle.partitions", "2")
        try:
            return self._start(**how)
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", "8")

    def _start(self, **how):
        return ingest.watch_stream(self.spark, EV.read_events(self.spark, self.source), self.base, self.encode, self.mark, **how)

    def wait(self, query, done, seconds=60):
        end = dt.datetime.now() + dt.timedelta(seconds=seconds)
        while not done():
            if not query.isActive:
                query.awaitTermination()
            assert dt.datetime.now() < end, self.paths()
            query.awaitTermination(0.3)

    def rows(self):
        return {os.path.relpath(r.file_path, self.root): r for r in tables.read_catalog(self.spark, self.base).collect()}

    def paths(self):
        return set(self.rows())


def test_a_rename_waits_for_the_file_to_come_back(spark, tmp_path):
    """Away and back within the grace, away for good, and moved: no trailing event is sent."""
    w = Watched(spark, tmp_path)
    for name in ("back.emb", "gone.emb", "old.emb"):
        put(f"{w.root}/{name}", name.encode(), 1_700_000_000)
    ingest.scan_library(spark, [w.root], w.base, w.encode)
    before, known = w.rows(), w.encoded()
    assert known == ["back.emb", "gone.emb", "old.emb"]
    query = w.start(grace="30 seconds")
    try:
        shutil.move(f"{w.root}/back.emb", f"{tmp_path}/away")
        os.remove(f"{w.root}/gone.emb")
        shutil.move(f"{w.root}/old.emb", f"{w.root}/new.emb")
        w.send(("back.emb", "rename"), ("gone.emb", "rename"), ("old.emb", "rename"), ("new.emb", "create"))
        w.wait(query, lambda: "new.emb" in w.paths())
        # the move is known at once; the renamed paths are still waited for
        assert w.paths() == {"back.emb", "gone.emb", "new.emb"}
        shutil.move(f"{tmp_path}/away", f"{w.root}/back.emb")
        w.send(("back.emb", "create"))
        w.wait(query, lambda: w.paths() == {"back.emb", "new.emb"}, 120)
    finally:
        query.stop()
    after = w.rows()
    assert after["back.emb"] == before["back.emb"]
    assert (after["new.emb"].id, after["new.emb"].embedding) == (before["old.emb"].id, before["old.emb"].embedding)
    assert w.encoded() == known  # nothing was encoded again


def test_a_file_that_is_still_written_is_left_alone(spark, tmp_path):
    w = Watched(spark, tmp_path)
    put(f"{w.root}/a.emb", b"first", 1_700_000_000)
    ingest.scan_library(spark, [w.root], w.base, w.encode)
    query = w.start(gap="8 seconds")
    try:
        for step in range(4):  # several triggers, each within the quiet time of the one before
            put(f"{w.root}/big.emb", b"part" * (step + 1))
            w.send(("big.emb", "write"))
            query.awaitTermination(1.5)
            assert w.paths() == {"a.emb"}
        w.wait(query, lambda: "big.emb" in w.paths())
    finally:
        query.stop()
    assert w.encoded() == ["first", "part" * 4]


def test_open_bursts_survive_a_restart(spark, tmp_path):
    w = Watched(spark, tmp_path)
    put(f"{w.root}/a.emb", b"a", 1_700_000_000)
    ingest.scan_library(spark, [w.root], w.base, w.encode)
    put(f"{w.root}/b.emb", b"b", 1_700_000_000)
    w.send(("b.emb", "create"))
    query = w.start(gap="8 seconds")
    w.wait(query, lambda: bool(query.lastProgress))
    query.stop()
    assert w.paths() == {"a.emb"}
    query = w.start(gap="8 seconds")
    try:
        w.wait(query, lambda: "b.emb" in w.paths())
    finally:
        query.stop()


def test_watching_needs_a_query_that_runs_on(spark, tmp_path):
    w = Watched(spark, tmp_path)
    for how in ({"availableNow": True}, {"settle": "never"}):
        with pytest.raises(ValueError):
            w.start(**how)


def test_content_that_changes_after_hashing_fails(spark, rows, tmp_path):
    put(f"{tmp_path}/a.emb", b"one")
    put(f"{tmp_path}/b.emb", b"two")
    ids = {n: hashlib.sha256(b"3" + t).hexdigest() for n, t in (("a", b"one"), ("b", b"two"))}
    fresh = spark.createDataFrame([(ids["a"], f"{tmp_path}/a.emb"), (ids["b"], f"{tmp_path}/b.emb")], "id string, file_path string")
    put(f"{tmp_path}/b.emb", b"TWO")
    assert rows(ingest.contents_of(fresh)) == [(ids["a"], b"one")]
    assert len(rows(ingest.contents_of(fresh, whole=False))) == 2
