"""File listings (S1, S2, S11, S12) and content fingerprints of listed files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from threadlake.functions import paths as P
from threadlake.functions import scalars as S
from threadlake.session import shuffle_partitions, stage


# How much of a file is held while it is hashed.
PIECE_BYTES = 4 * 1024 * 1024


def _filesystem(name: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)


def open_store(name: str) -> tuple[fs.FileSystem, str]:
    """Store and path of a file that Spark has written: 'file:/a', '/a', 'hdfs://..', 's3a://..'."""
    local = re.match(r"file:/+(.*)", name)
    return (fs.LocalFileSystem(), f"/{unquote(local[1])}") if local else _filesystem(re.sub("^s3[an]://", "s3://", name))


def plain_path(path):
    """'file:/a' and 'file:///a' -> '/a'; other schemes are kept."""
    return F.regexp_replace(path, r"^file:/+", "/")


def _glob(exts: Sequence[str]) -> str:
    """A glob for the extensions in every mix of letter case."""
    def any_case(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*{" + ",".join(any_case(e) for e in exts) + "}"


def scan_files(
    spark: SparkSession,
    roots: Sequence[str],
    exts: Sequence[str] = P.ITEM_EXTS,
    skip_hidden: bool = True,
) -> DataFrame:
    """Files below the roots with one of the extensions (any letter case).

    Directories starting with a dot and tool directories, the root included, are left
    out unless ``skip_hidden`` is off. Only file metadata is listed: content is a column
    Spark does not read unless it is selected. Spark's own listing leaves out empty files
    and names starting with '_' or '.'; ``walk_files`` finds those too.
    """
    found = None
    for root in roots:
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", _glob(exts))
            .load(root)
            .select(
                plain_path("path").alias("file_path"),
                F.col("length").alias("size_bytes"),
                F.unix_timestamp("modificationTime").alias("file_mtime"),
            )
        )
        if skip_hidden:
            listed = listed.where(~P.hidden_or_tool_dir("file_path", F.lit(root.rstrip("/"))))
        found = listed if found is None else found.unionByName(listed)
    if found is None:
        raise ValueError("no roots to scan")
    # roots may overlap
    return found.dropDuplicates(["file_path"]).withColumn("size_kb", S.size_kb("size_bytes"))


_ENTRY = "file_path string, is_dir boolean, size_bytes long, file_mtime long"


def _list_dirs(dirs: DataFrame) -> DataFrame:
    """Direct children of each directory, listed on the executors; directories that
    cannot be read have none."""

    def run(batches):
        for batch in batches:
            for name in batch.column("file_path").to_pylist():
                system, inner = _filesystem(name)
                try:
                    found = system.get_file_info(fs.FileSelector(inner))
                except OSError:
                    continue
                head = name[: len(name) - len(inner)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([head + f.path for f in found], pa.string()),
                        pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                        pa.array([f.size for f in found], pa.int64()),
                        pa.array([f.mtime_ns and f.mtime_ns // 10**9 for f in found], pa.int64()),
                    ],
                    names=["file_path", "is_dir", "size_bytes", "file_mtime"],
                )

    return dirs.mapInArrow(run, _ENTRY)


def one_feed(feeds: Sequence[DataFrame]) -> DataFrame:
    """The files of several roots as one feed, column by name; a column that a feed lacks is
    null there. Nested roots are listed by each, see ``walk_files`` for one walk over all."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def walk_files(
    spark: SparkSession,
    roots: Sequence[str],
    exts: Sequence[str] = P.ITEM_EXTS,
    skip_hidden: bool = True,
) -> DataFrame:
    """S1 / S11 on file systems the executors reach themselves (mounts, s3, hdfs ...):
    as ``scan_files``, but with empty files and every file name.

    One job per level of the tree: the directories of a level are spread over all tasks,
    and what they contain is staged for the next one.
    """
    level = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "file_path string")
    name = P.basename("file_path")
    excluded = name.startswith(".") | name.isin(*P.EXCLUDED_DIRS)
    if skip_hidden:
        level = level.where(~excluded)
    found = spark.createDataFrame([], _ENTRY)
    while True:
        # round robin: neighbouring directories are often alike in size
        level = level.repartition(shuffle_partitions(spark))
        children = stage(_list_dirs(level), "walk")
        found = found.unionByName(children.where(~F.col("is_dir") & P.is_supported("file_path", exts)))
        level = children.where("is_dir").select("file_path")
        if skip_hidden:
            level = level.where(~excluded)
        if level.isEmpty():
            break
    return (
        found.drop("is_dir")
        .dropDuplicates(["file_path"])
        .withColumn("size_kb", S.size_kb("size_bytes"))
    )


def root_totals(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Number of scanned files per root, zero included."""
    from threadlake.operators.containment import count_under

    return count_under(files, roots, include_self=True, out="total_files")


def scan_eval_set(files: DataFrame, folder: str, path: str = "file_path") -> DataFrame:
    """Items directly inside one folder, not below it."""
    return files.where(
        (P.dirname(path) == folder.rstrip("/")) & P.raw_ext(path).isin(".EMB", ".emb")
    )


def fingerprint_files(
    files: DataFrame,
    path: str = "file_path",
    size: str = "size_bytes",
    out: str = "id",
    prefix_bytes: int | None = S.FINGERPRINT_BYTES,
) -> DataFrame:
    """F5 for listed files: the hash of the size and the first ``prefix_bytes`` of each, read
    on the executors. With None the whole content counts, piece by piece, so files that
    differ only behind the prefix are told apart.

    Give it only the files whose listing changed; an unreadable file gets a null id.
    """
    schema = StructType([*files.schema.fields, StructField(out, StringType())])

    def run(batches):
        for batch in batches:
            ids = []
            for name, length in zip(batch.column(path).to_pylist(), batch.column(size).to_pylist()):
                try:
                    system, inner = _filesystem(name)
                    digest, left = hashlib.sha256(str(length).encode()), prefix_bytes
                    with system.open_input_stream(inner) as stream:
                        while piece := stream.read(PIECE_BYTES if left is None else min(left, PIECE_BYTES)):
                            digest.update(piece)
                            left = None if left is None else left - len(piece)
                    ids.append(digest.hexdigest())
                except OSError:
                    ids.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.string())], names=schema.names
            )

    return files.mapInArrow(run, schema)


def load_files(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """Current state of single files, read on the executors: whether each exists, its size,
    mtime, fingerprint (F5 over the whole content) and content. For the few files of a change batch."""
    schema = (
        "file_path string, present boolean, size_bytes long, file_mtime long, id string, content binary"
    )

    def read(name: str):
        system, inner = _filesystem(name)
        try:
            info = system.get_file_info(inner)
            if info.type != fs.FileType.File:
                return (name, False, None, None, None, None)
            with system.open_input_stream(inner) as stream:
                content = stream.read()
        except OSError:
            return (name, False, None, None, None, None)
        digest = hashlib.sha256(str(len(content)).encode())
        digest.update(content)
        id = digest.hexdigest()
        return (name, True, len(content), info.mtime_ns // 10**9, id, content)

    def run(batches):
        types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["file_path", "present", "size_bytes", "file_mtime", "id", "content"]
        for batch in batches:
            # one file at a time: contents are not gathered
            for name in batch.column(path).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(read(name), types)], names=names
                )

    return paths.select(path).mapInArrow(run, schema)
