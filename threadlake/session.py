"""Session helpers: builder, shared staging folder, lineage cuts and size checks."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows of one group that a single task may merge, and the most pieces a group is cut into.
SINGLE_LEVEL_ROWS = 100_000
MAX_SALTS = 1000


def get_spark(app: str = "threadlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are designed for.

    AQE (join switching, partition coalescing, skew splits) does the run-time
    planning; only settings that differ from Spark's defaults are named.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split hot keys even where that costs one more shuffle afterwards
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # merge sessions on the map side before the shuffle
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once per application, so that Python stages can
    import it wherever the driver runs (the same as ``spark-submit --py-files``)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "threadlake.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(here)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A private folder is made only on a single-machine session that names none;
    on a cluster a missing setting is an error rather than a machine-local path.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a frame feeds several branches or costs a Python stage: the copy
    survives executor loss and keeps the lineage short.
    """
    spark = df.sparkSession
    path = os.path.join(folder or shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession):
    """A sub-folder of the shared folder for ``stage``, removed at the end of the block."""
    folder = os.path.join(shared_dir(spark), f"staging-{uuid.uuid4().hex}")
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def size_in_bytes(text: str) -> int:
    """'16m', '128MB' or '134217728b' as a number of bytes; a bare number counts bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def scan_tasks(df: DataFrame) -> int | None:
    """About how many tasks read ``df``, from the optimizer's size of it; None if unknown."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # sources without statistics report (at least) the largest long
    if size >= 2**60:
        return None
    per_task = size_in_bytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    return max(1, -(-size // per_task))


def salt_count(df: DataFrame, rows_per_task: int = 1) -> int:
    """How many pieces a hot group is split into when each task reading ``df`` adds up to
    ``rows_per_task`` rows to it: the root of the number of tasks, so that both levels of
    the merge see about as many rows; 1 where a single level is small."""
    tasks = scan_tasks(df)
    if tasks is None:
        return max(1, shuffle_partitions(df.sparkSession) // 8)
    if tasks * rows_per_task <= SINGLE_LEVEL_ROWS:
        return 1
    return min(MAX_SALTS, math.isqrt(tasks) + 1)
