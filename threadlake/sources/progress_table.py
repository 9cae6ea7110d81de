"""Scan checkpoints per root (S7): drive_path, last_file, processed, updated_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROGRESS_SCHEMA = "drive_path string, last_file string, processed long, updated_at long"


def save_progress(progress: DataFrame, batch: DataFrame, now: Column | int) -> DataFrame:
    """Upsert by root; rows of ``batch`` without a root are ignored.

    ``batch``: drive_path, last_file, processed; one row per root.
    """
    stamp = now if isinstance(now, Column) else F.lit(now).cast("long")
    new = batch.where("drive_path <> ''").select(
        "drive_path", "last_file", F.col("processed").cast("long").alias("processed"), stamp.alias("updated_at")
    )
    kept = progress.join(new.select("drive_path"), "drive_path", "left_anti")
    return kept.select(*progress.columns).unionByName(new)


def load_progress(progress: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored checkpoint of each root (``path``); found is false where there is none."""
    stored = progress.select(
        F.col("drive_path").alias("path"), "last_file", "processed", F.lit(True).alias("found")
    )
    return roots.select("path").join(stored, "path", "left").select(
        "path",
        F.coalesce("last_file", F.lit("")).alias("last_file"),
        F.coalesce("processed", F.lit(0)).cast("long").alias("processed"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def clear_progress(
    progress: DataFrame, folders: DataFrame, roots: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drops the checkpoint and the folder row of each root: (progress, folders)."""
    gone = roots.select("path")
    left = progress.join(
        gone.withColumnRenamed("path", "drive_path"), "drive_path", "left_anti"
    )
    return left.select(*progress.columns), folders.join(gone, "path", "left_anti").select(*folders.columns)
