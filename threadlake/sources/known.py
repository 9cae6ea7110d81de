"""What a catalogue knows of the keys of a batch, without its vectors.

Beside each catalogue snapshot lies a narrow copy of it: three rows per item, one under its
path, one under its id and one under its directory and stem, in buckets of the key's hash. A
batch names its buckets, a bounded set of numbers, so a lookup reads those partitions alone
and its cost follows the batch, not the catalogue; the deltas after the snapshot are merged in
as they are for the catalogue itself. A snapshot without the copy is read in its place.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import paths as P

COLUMNS = ["id", "file_path", "file_mtime", "size_kb"]
# Rows of a bucket, and the most buckets of a kind.
BUCKET_ROWS = 200_000
MOST_BUCKETS = 4096


def stem_key(path: Column | str) -> Column:
    """Directory and stem of a path, which an item shares with its companions."""
    return F.concat_ws("/", P.dirname(path), P.stem(path))


KEYS = {"path": lambda: F.col("file_path"), "id": lambda: F.col("id"), "stem": lambda: stem_key("file_path")}


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_known(rows: DataFrame, target: str, count: int) -> None:
    """The narrow copy of ``count`` catalogue rows below ``target``."""
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * BUCKET_ROWS < count:
        buckets *= 2
    voices = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), key().alias("key")) for kind, key in KEYS.items())))
    named = rows.select(*COLUMNS, voices.alias("_v")).select("_v.kind", "_v.key", *COLUMNS)
    placed = named.where("key is not null").withColumn("bucket", bucket(F.col("key"), buckets))
    spread = placed.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "key")
    spread.write.mode("overwrite").partitionBy("kind", "bucket").parquet(os.path.join(target, f"buckets-{buckets}"))


def read_buckets(spark: SparkSession, target: str, buckets: int, kind: str, keys: DataFrame) -> DataFrame:
    """Rows of the copy whose key of the ``kind`` is among ``keys`` (key)."""
    wanted = sorted(r[0] for r in keys.select(bucket(F.col("key"), buckets)).distinct().collect())
    schema = "key string, id string, file_path string, file_mtime long, size_kb double, kind string, bucket int"
    stored = spark.read.schema(schema).parquet(os.path.join(target, f"buckets-{buckets}"))
    stored = stored.where((F.col("kind") == kind) & F.col("bucket").isin(wanted))
    return stored.join(keys, "key", "left_semi").select(*COLUMNS)
