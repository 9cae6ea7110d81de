"""Path-containment joins (J1, J3-J5, P12) and counts under folders.

A prefix test between two tables plans as a nested loop. Here every directory is
expanded to its ancestors, so containment is an equality on the folder path. The
expansion runs over the *distinct directories* of the files, not over the files,
and counts are summed per folder before any join: a top folder that holds most of
the library is one pre-aggregated row, never a hot join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import paths as P


def _dirs_under(dirs: DataFrame, folders: DataFrame) -> DataFrame:
    """(dir, folder) for each folder that is ``dir`` itself or lies above it."""
    chain = dirs.select("dir", F.explode(P.ancestors("dir", include_self=True)).alias("folder"))
    return chain.join(folders.select(F.col("path").alias("folder")).distinct(), "folder")


def _with_dir(files: DataFrame, path: str) -> DataFrame:
    return files.withColumn("dir", P.dirname(path))


def containment_join(
    files: DataFrame,
    folders: DataFrame,
    include_self: bool = False,
    path: str = "file_path",
) -> DataFrame:
    """Each file with every folder that contains it (column ``folder``).

    ``include_self`` also pairs a file with a folder row of the same path.
    """
    placed = _with_dir(files, path)
    pairs = _dirs_under(placed.select("dir").distinct(), folders)
    inside = placed.join(pairs, "dir").select(*files.columns, "folder")
    if not include_self:
        return inside
    same = files.join(
        folders.select(F.col("path").alias("folder")).distinct(), F.col(path) == F.col("folder")
    )
    return inside.unionByName(same.select(*files.columns, "folder"))


def count_under(
    files: DataFrame,
    folders: DataFrame,
    include_self: bool = False,
    path: str = "file_path",
    out: str = "n",
) -> DataFrame:
    """Files below each folder, zero included: folders + ``out`` (the core of J2 and A4).

    Three partial aggregations: files -> directories -> ancestors -> folders.
    """
    per_dir = _with_dir(files, path).groupBy("dir").agg(F.count(F.lit(1)).alias(out))
    per_folder = (
        per_dir.select(F.explode(P.ancestors("dir", include_self=True)).alias("path"), out)
        .groupBy("path")
        .agg(F.sum(out).alias(out))
    )
    if include_self:
        own = files.groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias(out))
        own = own.join(folders.select("path").distinct(), "path", "left_semi")
        per_folder = per_folder.unionByName(own).groupBy("path").agg(F.sum(out).alias(out))
    return folders.join(per_folder, "path", "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(0)).cast("long")
    )


def deepest_root(
    files: DataFrame, roots: DataFrame, path: str = "file_path", out: str = "root"
) -> DataFrame:
    """Longest root that is the path itself or lies above it, null if none.

    The search for the deepest root runs per directory; files only look it up.
    """
    names = roots.select(F.col("path").alias("folder")).distinct()
    placed = _with_dir(files, path)
    per_dir = (
        _dirs_under(placed.select("dir").distinct(), roots)
        .groupBy("dir")
        .agg(F.max_by("folder", F.length("folder")).alias("_above"))
    )
    found = placed.join(per_dir, "dir", "left").join(
        names.withColumnRenamed("folder", "_self"), F.col(path) == F.col("_self"), "left"
    )
    return found.select(*files.columns, F.coalesce("_self", "_above").alias(out))


def under_roots(files: DataFrame, roots: DataFrame, path: str = "file_path") -> DataFrame:
    """Files at or below any of the roots (semi join)."""
    return deepest_root(files, roots, path, "_root").where("_root is not null").drop("_root")


def outside_roots(files: DataFrame, roots: DataFrame, path: str = "file_path") -> DataFrame:
    """Files that are not strictly below any of the roots (anti join)."""
    placed = _with_dir(files, path)
    inside = _dirs_under(placed.select("dir").distinct(), roots).select("dir").distinct()
    return placed.join(inside, "dir", "left_anti").select(*files.columns)
