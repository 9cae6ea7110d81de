"""Benchmark decontamination: short test items searched inside long documents.

Items and documents are sets of word shingles. The containment of an item in a document is
the share of the item's shingles that the document has. The search is one bottom-k
prefix join for items of all sizes: one hash function orders all shingles, and an item with
``q`` shingles is represented by its ``k`` smallest ones, ``k = q - need + 1`` where
``need = ceil(threshold * q)``. A document that has ``need`` of the ``q`` shingles misses at
most ``k - 1``, so it has one of the ``k``: no pair at or above the threshold is lost, however
long the document is. Shingles of documents above the largest of all sketch
values never leave their task. Candidates are verified by exact
shingle containment. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import stage

from .common import held, small, table

SHINGLE = 5
PERCENT = 80


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks: case and punctuation don't hide a copy."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+")
    return F.filter(parts, lambda w: w != "")


def shingles(found: Column, n: int, form) -> Column:
    """``form`` of each run of ``n`` words; empty for shorter texts."""
    places = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: form(F.slice(found, i, n)))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Rows are told apart by id and text; a null id equals itself."""
    return a["_doc"].eqNullSafe(b["_doc"]) & (a["_print"] == b["_print"])


def item_sets(items: DataFrame, n: int = SHINGLE) -> DataFrame:
    """One row per row of ``items`` (item_id, text) with words: _item, _n (words per shingle),
    _set (its distinct shingles), _key (hash of both, which names the class of equal sets).

    Items shorter than ``n`` words form one shingle of all their words and are looked up
    among the runs of that many words; items without words can't be found and are left out.
    """
    w = F.col("_w")
    return (
        items.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("_w"))
        .where(F.size(w) > 0)
        .select("_item", F.least(F.size(w), F.lit(n)).alias("_n"), "_w")
        .select(
            "_item",
            "_n",
            F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(shingles(w, n, lambda x: F.array_join(x, " "))).alias("_s"),
        )
        .select("_item", "_n", F.sort_array(F.array_distinct("_s")).alias("_set"))
        .withColumn("_key", F.xxhash64("_n", "_set"))
    )


def item_classes(items: DataFrame, n: int = SHINGLE) -> DataFrame:
    """One row per distinct shingle set among ``items``: _key, _n, _set, item_id (smallest id,
    null only if there is no other; not unique if an id has several texts), n_items."""
    return item_sets(items, n).groupBy("_key", "_n", "_set").agg(F.min("_item").alias("item_id"), F.count("*").alias("n_items"))


def find_items(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Leaks of ``items`` (item_id, text) in ``docs`` (doc_id, text): one row per document row
    and distinct item: doc_id, item_id (smallest id of equal items), n_items (how many share
    it), n_item_shingles, n_shared, containment, _print (hash of the document's text) and _key
    (of the item's class). Different texts of one item_id, or without one, are items each.

    Null, empty and short texts have no shingles and no leaks; repeated document rows (same id
    and text) count once; other columns are ignored; either table may be empty.
    """
    spark = docs.sparkSession
    classes = stage(item_classes(items, n), "items")
    lengths = [r[0] for r in classes.select("_n").distinct().orderBy("_n").collect()]  # n at most
    if not lengths:
        lengths = [n]
    q = F.size("_set")
    need = ((q * percent + 99) / 100).cast("int")
    hashed = lambda s: F.xxhash64(F.split(s, " "))
    sketches = stage(
        classes.select(
            "_key",
            F.explode(F.slice(F.sort_array(F.transform("_set", hashed)), F.lit(1), q - need + 1)).alias("_h"),
        ),
        "sketches",
    )
    most = sketches.agg(F.max("_h").alias("_top"), F.count("*").alias("_rows")).first()
    top, n_sketches = -(2**63) if most["_top"] is None else most["_top"], most["_rows"]

    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_print"))
    tokens = held(rows, "_w", words(F.col("_text")))
    runs = [shingles(F.col("_w"), m, lambda x: F.xxhash64(x)) for m in lengths]
    # the outer form, as Spark infers a filter on the array from a plain explode
    probes = tokens.select("_doc", "_print", F.explode_outer(F.concat(*runs) if len(runs) > 1 else runs[0]).alias("_h")).where(F.col("_h") <= top)
    candidates = stage(
        probes.join(small(sketches.select("_key", "_h"), n_sketches), "_h").select("_doc", "_print", "_key").distinct(), "candidates"
    )

    n_candidates, n_classes = candidates.count(), classes.count()
    wanted = small(candidates.withColumnsRenamed({"_doc": "_cdoc", "_print": "_cprint"}), n_candidates)
    found = rows.join(wanted, rows["_doc"].eqNullSafe(wanted["_cdoc"]) & (rows["_print"] == wanted["_cprint"])).drop("_cdoc", "_cprint")
    # only candidate texts come this far
    found = held(found.join(small(classes, n_classes), "_key"), "_w", words(F.col("_text")))
    own = [F.when(F.col("_n") == m, shingles(F.col("_w"), m, lambda x: F.array_join(x, " "))) for m in lengths]
    shared = F.size(F.array_intersect(F.coalesce(*own), F.col("_set")))
    return (
        found.select("_doc", "item_id", "n_items", q.alias("n_item_shingles"), shared.alias("n_shared"), "_print", "_key", need.alias("_need"))
        .where(F.col("n_shared") >= F.col("_need"))
        .dropDuplicates(["_doc", "_print", "_key"])
        .select(
            F.col("_doc").alias("doc_id"), "item_id", "n_items", "n_item_shingles", "n_shared",
            (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"), "_print", "_key",
        )
    )


def drop_leaks(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    leaks = stage(find_items(docs, items, n, percent).select(F.col("doc_id").alias("_doc"), "_print").distinct(), "leaks")
    bad = small(leaks, leaks.count())
    print_of = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (print_of == bad["_print"]), "left_anti")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_shingles", "n_shared", F.round("containment", 6).alias("containment"))


def leaks_by_item(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``find_items`` with one row per document row and item id: copies of an item, which share
    a row there, have a row each."""
    members = stage(item_sets(items, n).select("_key", F.col("_item").alias("item_id")).distinct(), "members")
    found = find_items(docs, items, n, percent).drop("item_id", "n_items")
    return found.join(small(members, members.count()), "_key")


def op1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks_by_item(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_shingles", "n_shared", F.round("containment", 6).alias("containment"))


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\p{M}]+'), lambda x: x <> '') w FROM documents),
b0 AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\p{M}]+'), lambda x: x <> '') w FROM benchmark),
b1 AS (SELECT item_id, least(len(w), 5) n, unnest(range(1, len(w) - least(len(w), 5) + 2)) i, w FROM b0 WHERE len(w) > 0),
b2 AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') s FROM b1),
b3 AS (SELECT item_id, n, list_sort(list(s)) ss, count(*) q FROM b2 GROUP BY item_id, n),
b4 AS (SELECT min(item_id) item_id, n, ss, q FROM b3 GROUP BY n, ss, q),
b5 AS (SELECT item_id, n, q, unnest(ss) s FROM b4),
d1 AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM b4) WHERE len(w) >= n),
d2 AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') s FROM d1)
SELECT doc_id, item_id, CAST(max(q) AS INTEGER) n_item_shingles, CAST(count(*) AS INTEGER) n_shared, round(count(*) / max(q), 6) containment
FROM d2 JOIN b5 USING (n, s) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * max(q)
"""
# every item id for itself
ORACLE_ITEMS = ORACLE.replace("SELECT min(item_id) item_id, n, ss, q FROM b3 GROUP BY n, ss, q", "SELECT item_id, n, ss, q FROM b3")
