from threadlake.functions import scalars as S
from threadlake.operators import folders as FO
from threadlake.sources import progress_table, roots
from threadlake.sources.tables import FOLDER_SCHEMA


def folder(path, total=0, indexed=0, status="Pending", rescan=False):
    return (path, path.rsplit("/", 1)[-1], total, indexed, "last", status, rescan, 0, 0)


def table(spark, *data):
    return spark.createDataFrame(list(data), FOLDER_SCHEMA)


def test_provisional_states_never_replace_real_ones(spark, rows):
    old = table(spark, folder("/a", 5, 2, "Completed"), folder("/b", 5, 2, "Scouting..."), folder("/c", 5, 2, ""), folder("/k", 1, 1, "Error"))
    new = table(
        spark, folder("/a", 0, 0, "scouting..."), folder("/b", 7, 1, "Pending"), folder("/c", 3, 0, "Pending"),
        folder("/n", 0, 0, "Scouting..."), folder("/k", 2, 1, "In Progress"),
    )
    out = FO.upsert_folders(old, new, now=9)
    assert rows(out, "path", "total_files", "indexed_files", "status", "updated_at") == [
        ("/a", 5, 0, "Completed", 9), ("/b", 7, 1, "Pending", 9), ("/c", 3, 0, "Pending", 9),
        ("/k", 2, 1, "In Progress", 9), ("/n", 0, 0, "Scouting...", 9),
    ]


def test_untouched_folders_stay(spark, rows):
    old = table(spark, folder("/a", 5, 2, "Stopped", True))
    out = FO.upsert_folders(old, table(spark, folder("/b")), now=9)
    assert rows(out, "path", "total_files", "status", "needs_rescan", "updated_at") == [
        ("/a", 5, "Stopped", True, 0), ("/b", 0, "Pending", False, 9)
    ]


def test_completion_does_not_touch_outdated(spark, rows):
    data = [folder(f"/{s}", 2, 2, s, True) for s in ("Pending", "Stopped", "Scouting...", "Error", "Outdated", "In Progress")]
    out = FO.fix_completed(table(spark, *data, folder("/zero", 0, 0, "Pending", True)), now=4)
    done = {r["path"] for r in out.where("status = 'Completed' and not needs_rescan and updated_at = 4").collect()}
    assert done == {"/Pending", "/Stopped", "/Scouting...", "/Error"}
    assert out.where("path = '/zero'").first()["status"] == "Pending"


def test_stuck_stop_and_set(spark, rows):
    data = table(spark, folder("/a", status="In Progress"), folder("/b", status="Error"))
    assert rows(FO.reset_stuck(data, 3), "path", "status", "needs_rescan", "updated_at") == [("/a", "Stopped", True, 3), ("/b", "Error", False, 0)]
    assert rows(FO.stop_all(data, 3), "path", "status", "needs_rescan") == [("/a", "Stopped", False), ("/b", "Error", False)]
    one = spark.createDataFrame([("/b",)], "path string")
    assert rows(FO.set_status(data, one, S.OUTDATED, 5), "path", "status", "updated_at") == [("/a", "In Progress", 0), ("/b", "Outdated", 5)]


def test_recount_is_strict_and_refresh_counts_the_own_path(spark, rows):
    cat = spark.createDataFrame([("/a/x",), ("/a/b/y",), ("/a/b",), ("/ab/z",)], "file_path string")
    data = table(spark, folder("/a"), folder("/a/b"), folder("/ab", indexed=7), folder("/q", indexed=3))
    assert rows(FO.recount_folders(data, cat, 1), "path", "indexed_files") == [("/a", 3), ("/a/b", 1), ("/ab", 1), ("/q", 0)]
    touched = spark.createDataFrame([("/a/b/new",)], "file_path string")
    out = FO.refresh_containing(data, cat, touched, now=1)
    assert rows(out, "path", "indexed_files", "updated_at") == [("/a", 3, 1), ("/a/b", 2, 1), ("/ab", 7, 0), ("/q", 3, 0)]


def test_events_mark_containing_folders(spark, rows):
    data = table(spark, folder("/a", status="Completed"), folder("/a/b", status="Completed"), folder("/ab", status="Completed"))
    ev = spark.createDataFrame([("/a/b",), ("/a/b/f.emb",)], "path string")
    assert rows(FO.mark_outdated(data, ev), "path", "status", "needs_rescan") == [
        ("/a", "Outdated", True), ("/a/b", "Outdated", True), ("/ab", "Completed", False)
    ]


def test_order_and_pending(spark):
    data = table(
        spark, folder("/z", 1, 1, "In Progress"), folder("/y", 2, 1, "Completed"), folder("/x", 1, 1, "Completed"),
        folder("/w", 1, 1, "Error"), folder("/v", 1, 1, "Stopped", True),
    )
    assert [r["path"] for r in FO.order_folders(data).collect()] == ["/z", "/v", "/y", "/w", "/x"]
    assert {r["path"] for r in FO.pending_folders(data).collect()} == {"/w", "/v"}


def test_cleanup_and_report(spark, rows):
    cat = spark.createDataFrame(
        [(1, "/a/x", True), (2, "/a/x", False), (3, "/a/y", False), (4, "/a/y", False), (5, "/a/z", False)],
        "rowid long, file_path string, has_preview boolean",
    )
    data = table(spark, folder("/a", 2, 9, "In Progress"))
    clean, fixed = FO.cleanup(cat, data, now=1)
    assert rows(clean, "rowid") == [(1,), (5,)]
    assert rows(fixed, "indexed_files", "status", "needs_rescan") == [(2, "Completed", False)]
    assert tuple(FO.repair_report(cat).first()) == (5, 2, 3)
    assert tuple(FO.repair_report(cat, strict=False).first()) == (5, 3, 2)


def test_roots(spark, rows):
    text = spark.createDataFrame([(" /a;/b ; ;/a",), ("/c",)], "t string")
    assert rows(roots.parse_roots(text, "t")) == [("/a",), ("/b",), ("/c",)]
    have = spark.createDataFrame([("/a", "A")], "path string, label string")
    assert rows(roots.parse_roots(text, "t", have)) == [("/a", "A"), ("/b", "Test (b)"), ("/c", "Test (c)")]
    chosen = FO.set_roots(spark.createDataFrame([(" /a ",), ("",), ("/a",)], "path string"))
    assert rows(FO.add_root(FO.add_root(chosen, "/a"), " ")) == [("/a",)]
    drives = spark.createDataFrame(
        [("/", "ext4"), ("/data", "ext4"), ("/x", "tmpfs"), ("/snapx", None), ("/y", None)], "path string, fs_type string"
    )
    assert rows(FO.usable_roots(drives), "path") == [("/data",), ("/y",)]


def test_requested_paths_or_default(spark, rows):
    asked = spark.createDataFrame([(0, " /b"), (1, ""), (2, "/a"), (3, "/b ")], "pos int, path string")
    default = spark.createDataFrame([(0, "/d")], "pos int, path string")
    assert rows(FO.request_paths(asked, default), "path", "pos") == [("/a", 2), ("/b", 0)]
    assert rows(FO.request_paths(asked.where("pos = 1"), default), "path", "pos") == [("/d", 0)]


def test_checkpoints(spark, rows):
    empty = spark.createDataFrame([], progress_table.PROGRESS_SCHEMA)
    batch = spark.createDataFrame([("/a", "f", 5), ("", "g", 1)], "drive_path string, last_file string, processed int")
    one = progress_table.save_progress(empty, batch, 1)
    two = progress_table.save_progress(one, batch.selectExpr("drive_path", "'' as last_file", "9 as processed"), 2)
    assert rows(two) == [("/a", "", 9, 2)]
    asked = spark.createDataFrame([("/a",), ("/q",)], "path string")
    assert rows(progress_table.load_progress(two, asked)) == [("/a", "", 9, True), ("/q", "", 0, False)]
    left, kept = progress_table.clear_progress(two, table(spark, folder("/a"), folder("/b")), asked)
    assert left.count() == 0 and rows(kept, "path") == [("/b",)]
