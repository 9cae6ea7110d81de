"""Catalogue and folder tables on Parquet.

A table is a folder of snapshots plus small deltas:

    base/snapshot-000000000007/                     all rows
    base/delta-000000000008-<stream>-<batch>/rows   rows as they are after one batch
                                            /keys   ids and paths it took over

Both are complete once Spark has written ``_SUCCESS``. All writers share one sequence of
numbers: a commit takes the next free one. A batch is told by its stream and its number in
that stream; delivered again, it changes nothing, also after its delta has been compacted
away, since a snapshot's marks name the last batch of each stream. Writers of one process
take turns; a table has one writing process. A batch writes its own size, not the
catalogue's; reading merges the deltas after the newest snapshot with two anti joins
against their (small) keys, and ``compact`` folds them into a new snapshot.
"""

from __future__ import annotations

import json
import os
import re
import threading
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, LongType, StringType, StructField, StructType,
)

from threadlake.sources import known

BLOBS = ("preview_png", "thumbnail")

CATALOG_SCHEMA = StructType(
    [
        StructField("id", StringType()),
        StructField("file_path", StringType()),
        StructField("file_name", StringType()),
        StructField("format", StringType()),
        StructField("size_kb", DoubleType()),
        StructField("file_mtime", LongType()),
        StructField("has_preview", BooleanType()),
        StructField("embedding", ArrayType(FloatType())),
        StructField("sidecar_embedding", ArrayType(FloatType())),
        StructField("indexed_at", LongType()),
    ]
)

FOLDER_SCHEMA = StructType(
    [
        StructField("path", StringType()),
        StructField("name", StringType()),
        StructField("total_files", LongType()),
        StructField("indexed_files", LongType()),
        StructField("last_file", StringType()),
        StructField("status", StringType()),
        StructField("needs_rescan", BooleanType()),
        StructField("last_scan", LongType()),
        StructField("updated_at", LongType()),
    ]
)

_NAME = re.compile(r"^(snapshot|delta)-(\d{12})(?:-([A-Za-z0-9_]+)-(\d+))?$")
_OUTCOMES = re.compile(r"^outcomes-([A-Za-z0-9_]+)-(\d{12})$")
# The stream of batches that are applied by hand.
BY_HAND = "batch"

_locks: dict[str, threading.RLock] = defaultdict(threading.RLock)


class Commit(NamedTuple):
    number: int
    kind: str
    stream: str | None
    batch: int | None
    name: str


def writing(base: str) -> threading.RLock:
    """Held while a table is read, planned against and written, so that the streams of one
    driver do not commit over each other."""
    return _locks[base.rstrip("/")]


def _fs(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, base: str) -> list[str]:
    fs, path = _fs(spark, base)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def commits(spark: SparkSession, base: str) -> list[Commit]:
    """Complete commits, oldest first; a snapshot after the delta whose number it carries."""
    found = []
    for name in _names(spark, base):
        m = _NAME.match(name)
        if m and _exists(spark, os.path.join(base, name, "_SUCCESS" if m[1] == "snapshot" else "keys/_SUCCESS")):
            found.append(Commit(int(m[2]), m[1], m[3], None if m[4] is None else int(m[4]), name))
    return sorted(found, key=lambda c: (c.number, c.kind))


def versions(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """Complete versions as (number, kind), oldest first."""
    return [(c.number, c.kind) for c in commits(spark, base)]


def _next(done: list[Commit]) -> int:
    return done[-1].number + 1 if done else 0


def next_number(spark: SparkSession, base: str) -> int:
    """The number of the next commit."""
    return _next(commits(spark, base))


def marks(spark: SparkSession, base: str) -> dict[str, int]:
    """The last batch of each stream that the table holds."""
    done = commits(spark, base)
    snaps = [c.number for c in done if c.kind == "snapshot"]
    found: dict[str, int] = {}
    if snaps:
        fs, path = _fs(spark, os.path.join(base, f"marks-{snaps[-1]:012d}"))
        if fs.exists(path):
            stream = fs.open(path)
            try:
                found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    for c in done:
        if c.stream is not None:
            found[c.stream] = max(found.get(c.stream, -1), c.batch)
    return found


def delivered(spark: SparkSession, base: str, batch_id: int, stream: str = BY_HAND) -> bool:
    """Whether the table holds this batch. The numbers of a stream only grow."""
    return marks(spark, base).get(stream, -1) >= batch_id


def write_snapshot(df: DataFrame, base: str, number: int | None = None, delivers: tuple[str, int] | None = None) -> str:
    """All rows as a new snapshot; readers keep the old one until it is complete.

    ``number`` must be new among the snapshots and not behind the newest commit.
    ``delivers`` names a batch (stream, number) that the snapshot itself applies."""
    spark = df.sparkSession
    with writing(base):
        done = commits(spark, base)
        if number is None:
            number = _next(done)
        elif done and (number < done[-1].number or (number, "snapshot") in [(c.number, c.kind) for c in done]):
            raise ValueError(f"{base} is at {done[-1].number} already, {number} would be lost")
        last = marks(spark, base)
        if delivers is not None:
            last[delivers[0]] = max(last.get(delivers[0], -1), delivers[1])
        # written first: with the snapshot's success mark both are in force
        fs, path = _fs(spark, os.path.join(base, f"marks-{number:012d}"))
        out = fs.create(path, True)
        try:
            out.write(bytearray(json.dumps(last), "utf-8"))
        finally:
            out.close()
        target = os.path.join(base, f"snapshot-{number:012d}")
        # an incomplete directory of the same number is a failed earlier attempt
        df.write.mode("overwrite").parquet(target)
        if set(known.COLUMNS) <= set(df.columns):
            rows = spark.read.schema(df.schema).parquet(target).select(*known.COLUMNS)
            known.write_known(rows, os.path.join(base, f"known-{number:012d}"), rows.count())
    return target


write_catalog = write_snapshot


def write_delta(
    rows: DataFrame, gone_ids: DataFrame, gone_paths: DataFrame, base: str, batch_id: int, stream: str = BY_HAND
) -> bool:
    """One batch: ``rows`` as they are after it, and the ids and paths it touched, as the
    next commit. A batch that is delivered again changes nothing. Returns whether it was
    written now."""
    spark = rows.sparkSession
    with writing(base):
        if delivered(spark, base, batch_id, stream):
            return False
        target = os.path.join(base, f"delta-{_next(commits(spark, base)):012d}-{stream}-{batch_id}")
        keys = gone_ids.select(F.lit("id").alias("kind"), F.col("id").alias("key")).unionAll(
            gone_paths.select(F.lit("path").alias("kind"), F.col("file_path").alias("key"))
        )
        rows.write.mode("overwrite").parquet(os.path.join(target, "rows"))
        # written last: its success mark completes the delta
        keys.write.mode("overwrite").parquet(os.path.join(target, "keys"))
    return True


def _outcomes(base: str, batch_id: int, stream: str) -> str:
    return os.path.join(base, f"outcomes-{stream}-{batch_id:012d}")


def write_outcomes(outcomes: DataFrame, base: str, batch_id: int, stream: str = BY_HAND) -> None:
    """Outcome per file of one batch (skipped / moved / indexed / failed)."""
    outcomes.select("file_path", "id", "outcome").write.mode("overwrite").parquet(_outcomes(base, batch_id, stream))


def read_outcomes(spark: SparkSession, base: str, batch_id: int, stream: str = BY_HAND) -> DataFrame:
    """Outcomes of a batch; none once they have expired."""
    schema, path = "file_path string, id string, outcome string", _outcomes(base, batch_id, stream)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_counts(deltas: DataFrame, base: str, batch_id: int, stream: str = BY_HAND) -> None:
    """What a batch changes in the folder table (path, delta, outdated), beside its outcomes."""
    deltas.write.mode("overwrite").parquet(os.path.join(_outcomes(base, batch_id, stream), "_counts"))


def read_counts(spark: SparkSession, base: str, batch_id: int, stream: str = BY_HAND) -> DataFrame:
    schema, path = "path string, delta long, outdated boolean", os.path.join(_outcomes(base, batch_id, stream), "_counts")
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def write_folder_delta(rows: DataFrame, base: str, batch_id: int, stream: str = BY_HAND) -> bool:
    """One batch of folder rows as they are after it; the other folders are not written."""
    none = rows.select(F.col("path").alias("id")).limit(0)
    return write_delta(rows, none, rows.select(F.col("path").alias("file_path")), base, batch_id, stream)


def read_snapshot(spark: SparkSession, base: str, schema: StructType = CATALOG_SCHEMA) -> DataFrame:
    """Newest snapshot with the deltas after it; an empty table if there is none."""
    done = commits(spark, base)
    snaps = [c for c in done if c.kind == "snapshot"]
    if snaps:
        table = spark.read.schema(schema).parquet(os.path.join(base, snaps[-1].name))
    else:
        table = spark.createDataFrame([], schema)
    return _with_deltas(spark, base, done, table, schema)


def read_known(spark: SparkSession, base: str, keys: DataFrame, kind: str) -> DataFrame:
    """Current rows (id, file_path, file_mtime, size_kb) of a catalogue whose ``kind`` of key
    (path / id / stem) is among ``keys`` (key, each once); no vector is read."""
    done = commits(spark, base)
    snaps = [c for c in done if c.kind == "snapshot"]
    keys = keys.where("key is not null")
    target = os.path.join(base, f"known-{snaps[-1].number:012d}") if snaps else ""
    copies = [n for n in _names(spark, target) if _exists(spark, os.path.join(target, n, "_SUCCESS"))] if snaps else []
    if copies:
        table = known.read_buckets(spark, target, int(copies[0].rpartition("-")[2]), kind, keys)
    elif snaps:
        stored = spark.read.schema(CATALOG_SCHEMA).parquet(os.path.join(base, snaps[-1].name)).select(*known.COLUMNS)
        table = stored.withColumn("key", known.KEYS[kind]()).join(keys, "key", "left_semi").drop("key")
    else:
        table = spark.createDataFrame([], CATALOG_SCHEMA).select(*known.COLUMNS)
    slim = StructType([f for f in CATALOG_SCHEMA if f.name in known.COLUMNS])
    now = _with_deltas(spark, base, done, table, slim)
    return now.withColumn("key", known.KEYS[kind]()).join(keys, "key", "left_semi").select(*known.COLUMNS)


def _with_deltas(spark: SparkSession, base: str, done: list[Commit], table: DataFrame, schema: StructType) -> DataFrame:
    """``table``, rows of the newest snapshot, as the deltas after it have left them."""
    snaps = [c for c in done if c.kind == "snapshot"]
    deltas = [c for c in done if c.kind == "delta" and (not snaps or c.number > snaps[-1].number)]
    if not deltas:
        return table

    def each(part: str, part_schema):
        out = None
        for c in deltas:
            one = spark.read.schema(part_schema).parquet(os.path.join(base, c.name, part))
            one = one.withColumn("_batch", F.lit(c.number).cast("long"))
            out = one if out is None else out.unionByName(one)
        return out

    keys = each("keys", "kind string, key string")
    last = keys.groupBy("kind", "key").agg(F.max("_batch").alias("_last"))
    by_id = last.where("kind = 'id'").select(F.col("key").alias("id"), F.col("_last").alias("_l1"))
    names = schema.names
    path = "file_path" if "file_path" in names else "path"
    by_path = last.where("kind = 'path'").select(F.col("key").alias(path), F.col("_last").alias("_l2"))
    kept = table.join(by_path, path, "left_anti")
    added = each("rows", schema).join(by_path, path, "left").where(F.col("_batch") >= F.coalesce("_l2", F.lit(-1)))
    if "id" in names:
        kept = kept.join(by_id, "id", "left_anti")
        added = added.join(by_id, "id", "left").where(F.col("_batch") >= F.coalesce("_l1", F.lit(-1)))
    return kept.select(*names).unionByName(added.select(*names))


def compact(spark: SparkSession, base: str, schema: StructType = CATALOG_SCHEMA) -> str | None:
    """Folds the deltas into a new snapshot that carries the number of the last one; does
    nothing, and returns None, where no delta is newer than the newest snapshot."""
    with writing(base):
        done = commits(spark, base)
        if not done or done[-1].kind == "snapshot":
            return None
        return write_snapshot(read_snapshot(spark, base, schema), base, done[-1].number)


def expire(spark: SparkSession, base: str, keep: int = 2) -> None:
    """Removes what only snapshots older than the newest ``keep`` need, and the outcomes of
    batches that are neither among the remaining deltas nor the last of their stream."""
    with writing(base):
        done = commits(spark, base)
        snaps = [c.number for c in done if c.kind == "snapshot"]
        if len(snaps) <= keep:
            return
        oldest, last = snaps[-keep], marks(spark, base)
        gone = [c.name for c in done if c.number < oldest or (c.number == oldest and c.kind == "delta")]
        kept = {(c.stream, c.batch) for c in done if c.name not in gone} | set(last.items())
        for name in _names(spark, base):
            m = _OUTCOMES.match(name)
            if m and (m[1], int(m[2])) not in kept or name in [f"{kind}-{n:012d}" for kind in ("marks", "known") for n in snaps[:-keep]]:
                gone.append(name)
        fs, _ = _fs(spark, base)
        for name in gone:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(base, name)), True)


def read_catalog(spark: SparkSession, base: str, schema: StructType = CATALOG_SCHEMA) -> DataFrame:
    """S3: catalogue with vectors and the preview flag; media live in their own table."""
    return read_snapshot(spark, base, schema)


def read_folders(spark: SparkSession, base: str, path: str | None = None) -> DataFrame:
    """Folder table, or the stored row of one folder."""
    table = read_snapshot(spark, base, FOLDER_SCHEMA)
    return table if path is None else table.where(F.col("path") == path)


def split_media(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A catalogue with blobs -> (catalogue with ``has_preview``, media table by id), so
    that scans and searches never touch image bytes."""
    blobs = [c for c in BLOBS if c in rows.columns]
    media = rows.select("id", *blobs)
    slim = rows.withColumn("has_preview", F.col("preview_png").isNotNull()) if "preview_png" in blobs else rows
    return slim.drop(*blobs), media


def snapshot(df: DataFrame, base: str, ts: str) -> str:
    """Backup copy next to the table, named by a timestamp text."""
    target = f"{base.rstrip('/')}.backup-{ts}"
    df.write.mode("errorifexists").parquet(target)
    return target
