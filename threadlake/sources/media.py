"""Previews and thumbnails of items (P6, P7), apart from the catalogue's rows.

A batch writes the media of the contents it has embedded under the number of its commit,
ordered by id and in small row groups: a filter on ids reaches the scan, and the preview of one
item is one row group. Ids are hashes of contents, so media of one id are the same, whichever
batch wrote them. ``fold_media`` merges the batches and leaves out what the catalogue has lost.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.sources import tables

SCHEMA = "id string, preview_png binary, thumbnail binary"
ROW_GROUP_BYTES = 4 * 1024 * 1024

_NAME = re.compile(r"^(media|folded)-(\d{12})$")


def _parts(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """Numbers and names of what readers need: the newest folded part and the batches after it."""
    found = []
    for name in tables._names(spark, os.path.join(base, "media")):
        m = _NAME.match(name)
        if m and tables._exists(spark, os.path.join(base, "media", name, "_SUCCESS")):
            found.append((int(m[2]), m[1], name))
    last = max((n for n, kind, _ in found if kind == "folded"), default=-1)
    return sorted((n, name) for n, kind, name in found if n > last or (n == last and kind == "folded"))


def _write(media: DataFrame, target: str) -> None:
    ordered = media.repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.option("parquet.block.size", ROW_GROUP_BYTES).mode("overwrite").parquet(target)


def write_media(media: DataFrame, base: str) -> None:
    """Media (id, preview_png, thumbnail) of the batch that is about to be committed."""
    with tables.writing(base):
        number = tables.next_number(media.sparkSession, base)
        _write(media, os.path.join(base, "media", f"media-{number:012d}"))


def read_media(spark: SparkSession, base: str, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Media of the given ids (a few texts, or a frame with ``id``), or all; a row per id."""
    parts = _parts(spark, base)
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    table = spark.read.schema(SCHEMA).parquet(*(os.path.join(base, "media", name) for _, name in parts))
    if isinstance(ids, DataFrame):
        table = table.join(ids.select("id"), "id", "left_semi")
    elif ids is not None:
        table = table.where(F.col("id").isin(list(ids)))
    return table.dropDuplicates(["id"])


def fold_media(spark: SparkSession, base: str) -> None:
    """Merges the batches into one part with the media of the ids that the catalogue holds."""
    with tables.writing(base):
        parts = _parts(spark, base)
        if len(parts) < 2:
            return
        kept = read_media(spark, base, tables.read_catalog(spark, base))
        _write(kept, os.path.join(base, "media", f"folded-{parts[-1][0]:012d}"))
        fs, _ = tables._fs(spark, base)
        for _, name in parts:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(base, "media", name)), True)
