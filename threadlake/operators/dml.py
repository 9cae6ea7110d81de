"""Catalogue changes as snapshot transforms.

Each function maps a catalogue to the next one. Batches are small next to the
catalogue, so every join below has the batch on the side Spark may broadcast when
its measured size allows; the catalogue itself is filtered in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import paths as P
from threadlake.operators.joins import left_lookup
from threadlake.operators.ordered import keep_latest

# Columns whose old value survives a null in the batch.
KEPT = ("preview_png", "thumbnail", "sidecar_embedding")


def upsert(
    catalog: DataFrame,
    batch: DataFrame,
    now: Column | int,
    order: str | None = None,
    kept: Sequence[str] = KEPT,
) -> DataFrame:
    """Insert or replace by path; id and path both stay unique.

    The batch row wins; ``kept`` columns keep the old value where the batch has null.
    Replaced rows get ``indexed_at`` = now, new rows too. With ``order`` a batch that
    names an id or a path more than once is first reduced to the last row of each.

    Every join filters the catalogue by the batch, so the catalogue is not shuffled for
    a broadcastable batch.
    """
    if order is not None:
        batch = keep_latest(keep_latest(batch, "id", [order]), "file_path", [order])
    now = now if isinstance(now, Column) else F.lit(now).cast("long")
    paths, ids = batch.select("file_path"), batch.select("id")
    untouched = catalog.join(paths, "file_path", "left_anti").join(ids, "id", "left_anti")
    kept = [c for c in kept if c in catalog.columns]
    new = batch
    if kept:
        old = catalog.select("file_path", *[F.col(c).alias(f"_old_{c}") for c in kept])
        new = left_lookup(batch, old, "file_path")
    cols = []
    for c in catalog.columns:
        if c == "indexed_at":
            cols.append(now.alias(c))
        elif c in kept:
            cols.append(
                (F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in batch.columns else F.col(f"_old_{c}")).alias(c)
            )
        else:
            cols.append(F.col(c).cast(catalog.schema[c].dataType).alias(c))
    return untouched.select(*catalog.columns).unionByName(new.select(*cols))


def delete_paths(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """Delete by exact path."""
    return catalog.join(paths.select("file_path"), "file_path", "left_anti").select(*catalog.columns)


def delete_under(catalog: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Delete the paths themselves and everything below them."""
    names = prefixes.select("path").distinct()
    placed = catalog.withColumn("_dir", P.dirname("file_path"))
    dirs = placed.select("_dir").distinct()
    gone = (
        dirs.select("_dir", F.explode(P.ancestors("_dir", include_self=True)).alias("path"))
        .join(names, "path", "left_semi")
        .select("_dir")
        .distinct()
    )
    return (
        placed.join(gone, "_dir", "left_anti")
        .join(names.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
        .select(*catalog.columns)
    )


def clear(df: DataFrame) -> DataFrame:
    """The empty table of the same schema."""
    return df.sparkSession.createDataFrame([], df.schema)


def apply_moves(catalog: DataFrame, moves: DataFrame) -> DataFrame:
    """Re-point rows by id to a new path; a row already at that path is dropped.

    ``moves``: id, file_path, file_mtime, size_kb, one row per id and per path.
    """
    new = moves.select(
        "id",
        F.col("file_path").alias("_path"),
        F.col("file_mtime").alias("_mtime"),
        F.col("size_kb").alias("_kb"),
    )
    target = moves.select("file_path", F.col("id").alias("_new_id"))
    rows = catalog.join(target, "file_path", "left")
    # dropped: someone else's row at a path that a moved id takes over
    rows = rows.where(F.col("_new_id").isNull() | (F.col("_new_id") == F.col("id"))).drop("_new_id")
    rows = rows.join(new, "id", "left")
    changed = {
        "file_path": F.coalesce("_path", "file_path"),
        "file_name": F.when(F.col("_path").isNotNull(), P.basename("_path")).otherwise(F.col("file_name")),
        "file_mtime": F.when(F.col("_path").isNotNull(), F.col("_mtime")).otherwise(F.col("file_mtime")),
        "size_kb": F.when(F.col("_path").isNotNull(), F.col("_kb")).otherwise(F.col("size_kb")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in catalog.columns])


def dedupe_paths(
    catalog: DataFrame, strict: bool = True, row_id: str = "rowid", has_preview: str = "has_preview"
) -> DataFrame:
    """One row per path.

    In a duplicated path rows without preview go first, then the highest ``row_id``
    stays. ``strict`` keeps the literal rule, under which a duplicated path without any
    preview disappears; otherwise its highest row stays. ``row_id`` is unique.

    Only numbers are aggregated; the rows themselves meet the few duplicated paths in one
    join and are not copied, so a path with any number of copies costs one number per task.
    """
    best = (
        catalog.groupBy("file_path")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(row_id).alias("_any"),
            F.max_by(row_id, F.when(F.col(has_preview), F.col(row_id))).alias("_shown"),
        )
        .where("_n > 1")
        .select(F.col("file_path").alias("_path"), F.lit(True).alias("_twice"), (F.col("_shown") if strict else F.coalesce("_shown", "_any")).alias("_stays"))
    )
    rows = catalog.join(best, catalog["file_path"].eqNullSafe(best["_path"]), "left")
    return rows.where(F.col("_twice").isNull() | (F.col(row_id) == F.col("_stays"))).select(*[catalog[c] for c in catalog.columns])
