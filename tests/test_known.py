"""Narrow lookups of a catalogue: equal to the catalogue, and only the buckets of the batch."""

import re

import pytest
from pyspark.sql import functions as F

from threadlake.operators.catalog import plan_scan
from threadlake.sources import known, tables


def rows_of(spark, data):
    """(id, path, mtime) as catalogue rows."""
    full = [(i, p, p and p.rpartition("/")[2], "emb", float(m), m, True, [1.0, float(m)], None, m) for i, p, m in data]
    return spark.createDataFrame(full, tables.CATALOG_SCHEMA)


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def change(spark, base, batch, data):
    rows = rows_of(spark, data)
    tables.write_delta(rows, rows.select("id"), rows.select("file_path"), base, batch)


def lookup(spark, base, kind, values):
    return sorted((r.id, r.file_path, r.file_mtime) for r in tables.read_known(spark, base, keys(spark, values), kind).collect())


@pytest.mark.parametrize("copy", [True, False])
def test_lookups_follow_snapshots_and_deltas(spark, tmp_path, monkeypatch, copy):
    monkeypatch.setattr(known, "BUCKET_ROWS", 3)
    base = str(tmp_path / "t")
    assert lookup(spark, base, "path", ["/a/1.emb"]) == []
    stored = [(f"i{n}", f"/a/{n}.emb", n) for n in range(40)] + [("null", None, 1)]
    tables.write_catalog(rows_of(spark, stored), base)
    if not copy:  # a table from before there were copies
        fs, path = tables._fs(spark, f"{base}/known-{0:012d}")
        fs.delete(path, True)
    assert lookup(spark, base, "path", ["/a/1.emb", "/a/7.emb", "/none", None]) == [("i1", "/a/1.emb", 1), ("i7", "/a/7.emb", 7)]
    assert lookup(spark, base, "id", ["i3"]) == [("i3", "/a/3.emb", 3)]
    change(spark, base, 1, [("i3", "/b/moved.emb", 50), ("new", "/a/7.emb", 60)])
    assert lookup(spark, base, "path", ["/a/3.emb", "/a/7.emb", "/b/moved.emb"]) == [("i3", "/b/moved.emb", 50), ("new", "/a/7.emb", 60)]
    assert lookup(spark, base, "id", ["i3", "i7", "new"]) == [("i3", "/b/moved.emb", 50), ("new", "/a/7.emb", 60)]
    assert lookup(spark, base, "stem", ["/b/moved", "/a/3", "/a/4"]) == [("i3", "/b/moved.emb", 50), ("i4", "/a/4.emb", 4)]
    change(spark, base, 2, [("i3", "/a/3.emb", 70)])
    before = lookup(spark, base, "id", [f"i{n}" for n in range(40)])
    whole = tables.read_catalog(spark, base).where("id like 'i%'")
    assert before == sorted((r.id, r.file_path, r.file_mtime) for r in whole.collect())
    tables.compact(spark, base)
    assert lookup(spark, base, "id", [f"i{n}" for n in range(40)]) == before
    for _ in range(3):
        tables.write_catalog(tables.read_catalog(spark, base).cache(), base)
    tables.expire(spark, base)
    names = tables._names(spark, base)
    assert sum(n.startswith("known-") for n in names) == sum(n.startswith("snapshot-") for n in names) == 2


def test_a_batch_reads_its_buckets_and_no_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known, "BUCKET_ROWS", 10)
    base = str(tmp_path / "t")
    tables.write_catalog(rows_of(spark, [(f"i{n}", f"/a/{n}.emb", n) for n in range(300)]), base)
    found = tables.read_known(spark, base, keys(spark, ["/a/5.emb"]), "path")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any(re.search(r"kind#\d+ = path", f) and re.search(r"bucket#\d+ = \d+", f) for f in filters), filters
    assert len(spark.read.parquet(f"{base}/known-{0:012d}/buckets-32").inputFiles()) > 60


def test_planning_by_lookups_equals_planning_by_the_catalogue(spark, tmp_path):
    stored = [("a", "/1", 1), ("b", "/2", 2), ("c", "/3", 3), ("d", "/4", 4)]
    base = str(tmp_path / "t")
    tables.write_catalog(rows_of(spark, stored), base)
    files = [(1, "/1", 1, 1.0, "a"), (2, "/2", 9, 1.0, "c"), (3, "/5", 1, 1.0, "b"), (4, "/6", 1, 1.0, "x"), (5, "/7", 1, 1.0, "x")]
    listing = spark.createDataFrame(files, "seq int, file_path string, file_mtime long, size_kb double, id string")
    catalog = tables.read_catalog(spark, base)
    by_path = tables.read_known(spark, base, listing.select(F.col("file_path").alias("key")), "path")
    ids = listing.select(F.col("id").alias("key")).union(by_path.select("id")).distinct()
    by_id = tables.read_known(spark, base, ids, "id")
    want = sorted(map(tuple, plan_scan(listing, catalog).collect()))
    assert sorted(map(tuple, plan_scan(listing, by_path, by_id=by_id).collect())) == want
