"""Root lists given as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import paths as P


def parse_roots(df: DataFrame, col: str, existing: DataFrame | None = None) -> DataFrame:
    """Entries of ';'-separated texts, trimmed, blanks and repeats dropped.

    With ``existing`` (path, label) the new ones are appended to it, labelled by name.
    """
    pieces = df.select(F.explode(F.split(col, ";")).alias("path"))
    entries = pieces.select(F.trim("path").alias("path")).where("path <> ''").distinct()
    if existing is None:
        return entries
    new = entries.join(existing.select("path"), "path", "left_anti").select(
        "path", F.concat(F.lit("Test ("), P.basename("path"), F.lit(")")).alias("label")
    )
    return existing.select("path", "label").unionByName(new)
