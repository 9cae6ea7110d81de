import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake import session
from threadlake.functions import vectors as V
from threadlake.operators import ordered, pooling, search

CATALOG = "id string, format string, has_preview boolean, embedding array<float>, side array<float>"


def catalog(spark, data):
    return spark.createDataFrame(data, CATALOG)


def queries(spark, data):
    return spark.createDataFrame(data, "query_id long, view_id long, qv array<float>")


BASE = [
    ("a", "emb", True, [1.0, 0.0], None),
    ("b", "EMB", True, [0.0, 1.0], [1.0, 0.0]),
    ("c", "emb", False, [0.9, 0.1], None),
    ("d", "jpg", True, [1.0, 0.0], None),
    ("e", "emb", True, [-1.0, 0.0], None),
    ("f", "emb", True, [1.0, 0.0, 0.0], None),
    ("g", "emb", True, [1.0, 0.0], None),
]
KEEP = ["has_preview"]


def test_ties_go_to_the_smaller_id_and_k_may_exceed_n(spark, rows):
    q = queries(spark, [(1, 0, [1.0, 0.0])])
    out = search.knn(catalog(spark, BASE), q, 100)
    order = [r["id"] for r in out.orderBy(F.desc("score"), "id").collect()]
    assert order == ["a", "d", "g", "c", "b", "f", "e"]
    top = search.knn(catalog(spark, BASE), q, 2)
    assert rows(top, "id", "score") == [("a", 1.0), ("d", 1.0)]


def test_unequal_length_scores_zero(spark):
    q = queries(spark, [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 0.0, 1.0])])
    got = {(r["view_id"], r["id"]): r["score"] for r in search.knn(catalog(spark, BASE), q, 9).collect()}
    assert got[(0, "f")] == 0.0 and got[(1, "a")] == 0.0 and got[(1, "f")] == 0.0


def test_empty_catalogue_and_empty_queries(spark):
    q = queries(spark, [(1, 0, [1.0, 0.0])])
    assert search.search(catalog(spark, []), q, keep=KEEP).count() == 0
    assert search.search(catalog(spark, BASE), queries(spark, []), keep=KEEP).count() == 0


def test_non_positive_scores_vanish(spark, rows):
    q = queries(spark, [(1, 0, [1.0, 0.0])])
    assert rows(search.search(catalog(spark, BASE), q, keep=KEEP), "id") == [("a",), ("g",)]


def test_not_a_number_never_wins(spark, rows):
    q = queries(spark, [(1, 0, [1.0, 0.0])])
    odd = catalog(spark, [*BASE, ("z", "emb", True, [float("nan"), 0.0], None), ("0", "emb", True, None, None)])
    assert rows(search.search(odd, q, keep=KEEP), "id") == [("a",), ("g",)]
    assert [r["id"] for r in search.knn(odd, q, 4).orderBy(F.desc("score"), "id").collect()] == ["a", "d", "g", "c"]


def test_depth_is_cut_before_the_preview_filter(spark, rows):
    q = queries(spark, [(1, 0, [0.9, 0.1])])
    # best three of the emb rows are a and g (0.9) and c (0.82, no preview)
    assert rows(search.search(catalog(spark, BASE), q, depth=3, keep=KEEP), "id") == [("a",), ("g",)]
    assert rows(search.search(catalog(spark, BASE), q, depth=4, keep=KEEP), "id") == [("a",), ("b",), ("g",)]


def test_best_view_counts(spark, rows):
    q = queries(spark, [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 0.5])])
    got = rows(search.search(catalog(spark, BASE), q, keep=KEEP), "id", "score")
    assert got == [("a", 1.0), ("b", 0.5), ("g", 1.0)]


def test_dual_uses_the_companion_where_there_is_one(spark, rows):
    q = queries(spark, [(1, 0, [1.0, 0.0])])
    got = rows(search.search(catalog(spark, BASE), q, keep=KEEP, dual="side"), "id", "score")
    assert got == [("a", 1.0), ("b", 1.0), ("g", 1.0)]


def test_one_view_equals_knn(spark, rows):
    q = queries(spark, [(1, 0, [0.3, 0.7])])
    one = search.knn(catalog(spark, BASE).where("has_preview"), q, 1000, fmt="emb").where("score > 0")
    both = search.search(catalog(spark, BASE), q, keep=KEEP)
    assert rows(one, "id", "score") == rows(both, "id", "score")


def random_set(n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)).round(2).astype("float32")


def brute(items, qs, k):
    out = set()
    for q, vec in enumerate(qs):
        s = np.round(items.astype("float64") @ vec.astype("float64"), 6)
        for i in np.lexsort((np.arange(len(items)), -s))[:k]:
            out.add((q, int(i), float(s[i])))
    return out


@pytest.mark.parametrize("blocks", [False, True])
def test_blocks_batches_and_salts_equal_brute_force(spark, monkeypatch, blocks):
    items, qs = random_set(3000, 8, 1), random_set(40, 8, 2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(qs)], "query_id long, view_id long, qv array<float>")
    if blocks:
        for name, value in (("BROADCAST_VIEWS", 6), ("BLOCK_QUERIES", 7), ("CHUNK_BYTES", 4000), ("CELLS", 200)):
            monkeypatch.setattr(search, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = {tuple(r) for r in search.knn(table, q, 15).select("query_id", "id", "score").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute(items, qs, 15)


def test_scan_reads_only_the_needed_columns(spark, tmp_path):
    path = str(tmp_path / "cat")
    catalog(spark, BASE).write.parquet(path)
    q = queries(spark, [(1, 0, [1.0, 0.0])])
    plan = search.knn(spark.read.parquet(path), q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,embedding:array<float>>" in plan
    assert "WindowGroupLimit" in plan
    filtered = search.knn(spark.read.parquet(path).withColumnRenamed("format", "f").withColumn("format", F.col("f")), q, 5, fmt="emb")
    assert "has_preview" not in filtered._jdf.queryExecution().executedPlan().toString()


def test_salts_follow_the_size_of_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "cat")
    spark.range(20000).selectExpr("id", "array(cast(id % 97 as float), cast(id % 89 as float)) as embedding").write.parquet(path)
    table = spark.read.parquet(path)
    assert session.scan_tasks(table) == 1 and session.salt_count(table, 1000) == 1
    assert session.scan_tasks(catalog(spark, BASE)) is None
    q = queries(spark, [(1, 0, [1.0, 0.5])])
    plain = rows(search.knn(table, q, 30), "id", "score")
    kept, session.SINGLE_LEVEL_ROWS = session.SINGLE_LEVEL_ROWS, 1
    try:
        assert session.salt_count(table, 30) == 2
        assert rows(search.knn(table, q, 30), "id", "score") == plain
    finally:
        session.SINGLE_LEVEL_ROWS = kept


def test_top_k_with_salts(spark, rows):
    df = spark.range(1000).selectExpr("id % 3 as key", "id", "id * 7 % 101 as v")
    order = [F.desc("v"), F.asc("id")]
    plain = ordered.top_k(df, ["key"], order, 5)
    salted = ordered.top_k(df, ["key"], order, 5, spread=F.col("id"), salts=6)
    assert rows(plain) == rows(salted)


def test_centroid_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    data = [(0 if i % 3 else i, rng.normal(size=5).astype("float32").tolist()) for i in range(900)]
    df = spark.createDataFrame(data, "key long, v array<float>").repartition(12)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    held, pooling.HELD_SUMS = pooling.HELD_SUMS, 20
    try:
        got = {r["key"]: r["v"] for r in pooling.centroid(df, ["key"], "v").collect()}
    finally:
        pooling.HELD_SUMS = held
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len({k for k, _ in data})
    for key, vec in got.items():
        mean = np.mean([np.array(v, "float64") for k, v in data if k == key], axis=0)
        assert np.allclose(vec, mean / np.linalg.norm(mean), atol=1e-9)


def test_zero_mean_is_left_as_it_is(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0])], "key long, v array<float>")
    assert pooling.centroid(df, ["key"], "v").first()["v"] == [0.0, 0.0]


def test_vector_blobs_with_nulls_and_trailing_bytes(spark):
    one = np.array([1.5, -2.0], "<f4").tobytes()
    df = spark.createDataFrame(
        [(1, bytearray(one)), (2, None), (3, bytearray(one + b"xyz")), (4, bytearray(b""))], "id long, blob binary"
    ).coalesce(1)
    got = {r["id"]: r["embedding"] for r in V.decode_vectors(df, "blob").collect()}
    assert got == {1: [1.5, -2.0], 2: None, 3: [1.5, -2.0], 4: []}
    back = V.encode_vectors(V.decode_vectors(df, "blob").drop("blob"), "embedding")
    assert {r["id"]: r["blob"] and bytes(r["blob"]) for r in back.collect()} == {1: one, 2: None, 3: one, 4: b""}


def test_large_query_sets_stay_off_the_driver(spark, monkeypatch):
    """30,000 views in blocks: the driver reads no more than what decides that they are many."""
    items, qs = random_set(200, 4, 3), random_set(30_000, 4, 4)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(qs)], "query_id long, view_id int, qv array<float>")
    fetched = []
    kind = type(q)
    read = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: fetched.append(read(self)) or fetched[-1])
    files = []
    split = search._block_files
    monkeypatch.setattr(search, "_block_files", lambda *a: files.extend(split(*a)) or files)
    got = {(r.query_id, r.id, r.score) for r in search.knn(table, q, 1).select("query_id", "id", "score").toLocalIterator()}
    assert got == brute(items, qs, 1)
    assert [t.num_rows for t in fetched] == [search.BROADCAST_VIEWS + 1]
    assert len(files) >= 30_000 // search.BLOCK_QUERIES
    sizes = [search._read_block(f, ["query_id", "view_id"], "qv")[2] for f in files]
    assert sum(sizes) == 30_000 and max(sizes) <= search.BLOCK_QUERIES


def test_blocks_hold_odd_vectors_and_keys(spark, monkeypatch, rows):
    data = [(1, None, [1.0, 0.0]), (None, 0, [0.0, 1.0]), (2, 0, None), (2, 1, []), (3, 0, [1.0, 0.0, 0.0])]
    q = spark.createDataFrame(data, "query_id long, view_id long, qv array<float>")
    small = rows(search.knn(catalog(spark, BASE), q, 3), "query_id", "view_id", "id", "score")
    for name, value in (("BROADCAST_VIEWS", 2), ("BLOCK_QUERIES", 2)):
        monkeypatch.setattr(search, name, value)
    assert rows(search.knn(catalog(spark, BASE), q, 3), "query_id", "view_id", "id", "score") == small
