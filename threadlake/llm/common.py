"""What the operators of this subpackage share: table readers and column helpers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import ship_package

# One or more characters that are none of space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def split_words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(parts, lambda w: w != "")


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` computed once per row. A plain column is substituted into filters
    that Spark pushes down, and into the lambdas there it is then computed per element; the
    output of a generator is not."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


# A side of at most this many rows of a few numbers (some tens of MB) is broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; beyond the bound its join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for jobs that run in the block, whose rows are
    megabytes each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
