import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import catalog as C
from threadlake.operators import dml
from threadlake.streaming.ingest import plan_changes

CATALOG = (
    "id string, file_path string, file_name string, format string, size_kb double, file_mtime long,"
    " has_preview boolean, embedding array<float>, sidecar_embedding array<float>, indexed_at long"
)
FILES = "seq long, file_path string, file_mtime long, size_kb double, id string, content binary"


def row(id, path, mtime=1, kb=1.0, at=0):
    return (id, path, path.rsplit("/", 1)[-1], "emb", kb, mtime, True, [1.0, 0.0], None, at)


def file(seq, path, id, mtime=1, kb=1.0):
    return (seq, path, mtime, kb, id, bytearray((id or "").encode()))


def one_by_one(stored, files, force=False, broken=()):
    """The scan rules applied to one file after the other."""
    state = {id: (path, mtime, kb) for id, path, mtime, kb in stored}
    outcomes = {}
    for seq, path, mtime, kb, id, _ in sorted(files):
        at = next((i for i, v in state.items() if v[0] == path), None)
        if not force and at and state[at] == (path, mtime, kb):
            outcomes[seq] = "skipped"
            continue
        if id is None:
            outcomes[seq] = "failed"
            continue
        if id in state and state[id][0] != path:
            outcomes[seq] = "moved"
        elif id in broken:
            outcomes[seq] = "failed"
            continue
        else:
            outcomes[seq] = "indexed"
        if at and at != id:
            del state[at]
        state[id] = (path, mtime, kb)
    return outcomes, {(i, *v) for i, v in state.items()}


def vectors(contents):
    text = F.col("content").cast("string")
    good = F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")
    return contents.select("id", F.when(~text.startswith("x"), good).alias("embedding"))


def run(spark, stored, files, force=False):
    cat = spark.createDataFrame([row(*r) for r in stored], CATALOG)
    changes = plan_changes(cat, spark.createDataFrame(files, FILES), vectors, 9, force)
    outcomes = {r["seq"]: r["outcome"] for r in changes.outcomes.collect()}
    after = changes.applied_to(cat)
    got = after.select("id", "file_path", "file_mtime", "size_kb", "file_name").collect()
    assert len({r["id"] for r in got}) == len({r["file_path"] for r in got}) == len(got)
    assert all(r["file_name"] == r["file_path"].rsplit("/", 1)[-1] for r in got)
    return outcomes, {tuple(r)[:4] for r in got}


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_one_file_after_the_other(spark, seed):
    rng = random.Random(seed)
    paths = [f"/p{i}" for i in range(12)]
    ids = [f"h{i}" for i in range(8)]
    homes = rng.sample(paths, 6)
    stored = [(i, p, rng.randint(1, 2), 1.0) for i, p in zip(rng.sample(ids, 6), homes)]
    known = {p: (i, m) for i, p, m, _ in stored}
    files = []
    for seq, p in enumerate(rng.sample(paths, 10)):
        mtime = rng.randint(1, 2)
        # an unchanged file still has its old content
        id = known[p][0] if p in known and known[p][1] == mtime else rng.choice(ids)
        files.append(file(seq, p, id, mtime))
    assert run(spark, stored, files) == one_by_one(stored, files)
    assert run(spark, stored, files, force=True) == one_by_one(stored, files, force=True)


def test_copies_swaps_and_failures(spark):
    stored = [("a", "/1", 1, 1.0), ("b", "/2", 1, 1.0), ("x1", "/5", 1, 1.0)]
    swap = [file(1, "/1", "b", 2), file(2, "/2", "a", 2)]
    assert run(spark, stored, swap) == one_by_one(stored, swap)
    copies = [file(s, f"/c{s}", "new") for s in range(5)] + [file(9, "/1", "a")]
    assert run(spark, stored, copies) == one_by_one(stored, copies)
    ping_pong = [file(1, "/0", "a"), file(2, "/1", "a")]
    assert run(spark, stored, ping_pong) == one_by_one(stored, ping_pong)
    broken = [file(1, "/7", "x9"), file(2, "/8", None), file(3, "/5", "x1", 5)]
    assert run(spark, stored, broken) == one_by_one(stored, broken, broken=("x1", "x9"))


def test_moves_keep_the_vector_and_only_new_content_is_embedded(spark):
    cat = spark.createDataFrame([row("a", "/1", at=5)], CATALOG)
    seen = spark.sparkContext.accumulator(0)

    def counting(contents):
        got = contents.collect()
        seen.add(len(got))
        return vectors(contents)

    files = spark.createDataFrame([file(1, "/9", "a"), file(2, "/n1", "n"), file(3, "/n2", "n")], FILES)
    after = {r["id"]: r for r in plan_changes(cat, files, counting, 77).applied_to(cat).collect()}
    assert seen.value == 1
    assert after["a"]["file_path"] == "/9" and after["a"]["embedding"] == [1.0, 0.0] and after["a"]["indexed_at"] == 5
    assert after["n"]["file_path"] == "/n2" and after["n"]["embedding"] == [0.0, 1.0] and after["n"]["indexed_at"] == 77


# -- changes ---------------------------------------------------------------------


def test_upsert_keeps_old_media_and_both_keys(spark, rows):
    schema = "id string, file_path string, thumbnail string, indexed_at long"
    cat = spark.createDataFrame([("a", "/1", "ta", 1), ("b", "/2", "tb", 1), ("c", "/3", None, 1)], schema)
    batch = spark.createDataFrame(
        [("a2", "/1", None, 1), ("b", "/9", "new", 2), ("n", "/n", None, 3), ("n", "/m", None, 4)],
        "id string, file_path string, thumbnail string, seq long",
    )
    out = dml.upsert(cat, batch, now=50, order="seq")
    assert rows(out) == [("a2", "/1", "ta", 50), ("b", "/9", "new", 50), ("c", "/3", None, 1), ("n", "/m", None, 50)]
    assert out.select("id").distinct().count() == out.select("file_path").distinct().count() == out.count()


def test_deletes(spark, rows):
    cat = spark.createDataFrame([("/a/b",), ("/a/b/x",), ("/a/bc/y",), ("/z",)], "file_path string")
    under = spark.createDataFrame([("/a/b",)], "path string")
    assert rows(dml.delete_under(cat, under)) == [("/a/bc/y",), ("/z",)]
    assert rows(dml.delete_paths(cat, spark.createDataFrame([("/z",)], "file_path string"))) == [("/a/b",), ("/a/b/x",), ("/a/bc/y",)]
    assert dml.clear(cat).count() == 0 and dml.clear(cat).schema == cat.schema


def test_moves_drop_the_row_at_the_target(spark, rows):
    cat = spark.createDataFrame([row("a", "/1"), row("b", "/2"), row("c", "/3")], CATALOG)
    moves = spark.createDataFrame([("a", "/2", 7, 2.0)], "id string, file_path string, file_mtime long, size_kb double")
    assert rows(dml.apply_moves(cat, moves), "id", "file_path", "file_name", "file_mtime", "size_kb") == [
        ("a", "/2", "2", 7, 2.0), ("c", "/3", "3", 1, 1.0)
    ]


def test_dedupe_modes(spark, rows):
    data = [(1, "/a", False), (2, "/a", False), (3, "/b", True), (4, "/b", False), (5, "/b", True), (6, "/c", False)]
    cat = spark.createDataFrame(data, "rowid long, file_path string, has_preview boolean")
    strict = dml.dedupe_paths(cat)
    assert rows(strict, "rowid") == [(5,), (6,)]
    assert rows(dml.dedupe_paths(strict)) == rows(strict)
    assert rows(dml.dedupe_paths(cat, strict=False), "rowid") == [(2,), (5,), (6,)]


def test_dedupe_of_a_hot_path_reduces_before_the_shuffle(spark):
    cat = spark.range(20000).selectExpr("id as rowid", "if(id % 3 > 0, '/hot', concat('/', id)) as file_path", "id % 2 = 0 as has_preview")
    out = dml.dedupe_paths(cat)
    assert out.where("file_path = '/hot'").first()["rowid"] == 19996  # highest even number that 3 does not divide
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange hashpartitioning(file_path")


# -- reads -------------------------------------------------------------------------


def test_browse_pages_and_wildcards(spark, rows):
    data = [(f"i{n:03d}", f"/f/{n}", f"n{n % 3}_{n:03d}.emb", "emb" if n % 2 else "jpg", 1.0, n, True) for n in range(130)]
    cat = spark.createDataFrame(data, "id string, file_path string, file_name string, format string, size_kb double, indexed_at long, has_preview boolean")
    assert C.browse(cat).count() == 48
    assert [r["id"] for r in C.browse(cat, page=2, page_size=3).collect()] == ["i123", "i121", "i119"]
    assert C.browse(cat, page=9).count() == 0
    assert C.browse(cat, page_size=500).count() == 48
    assert [r["file_name"] for r in C.browse(cat, q="N1_", page_size=2).collect()] == ["n1_001.emb", "n1_007.emb"]
    assert tuple(C.browse_meta(cat, q="n1", page_size=10).first()) == (22, 1, 10, 3)
    assert rows(C.name_contains(cat, "n1_", wildcards=False), "id") == rows(C.name_contains(cat, "n1_"), "id")
    assert C.name_contains(cat, "n__0").count() > 0 and C.name_contains(cat, "n__0", wildcards=False).count() == 0
    assert C.latest(cat).first()["id"] == "i129" and C.latest(cat).count() == 50


def test_format_count_map(spark):
    cat = spark.createDataFrame([("emb",), ("emb",), ("jpg",)], "format string")
    assert C.format_count_map(cat).first()["counts"] == {"emb": 2, "jpg": 1}


def test_dedupe_aggregates_numbers_only(spark):
    cat = spark.range(100).selectExpr("id as rowid", "concat('/', id % 40) as file_path", "id % 2 = 0 as has_preview", "array(1.0, 2.0) as embedding")
    for strict in (True, False):
        out = dml.dedupe_paths(cat, strict)
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == (20 if strict else 40)
