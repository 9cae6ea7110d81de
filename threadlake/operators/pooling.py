"""Mean-pooling of vectors per key, then L2 renormalisation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from threadlake.functions import vectors as V
from threadlake.session import salt_count

# Partial sums held by one task before they are handed on.
HELD_SUMS = 4096


def _flush(keys, names, held):
    rows = list(held.values())
    sums = [r[1] for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sums]))).astype("int32")
    arrays = [pa.array([r[0][i] for r in rows], t) for i, (_, t) in enumerate(keys)]
    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sums))))
    arrays.append(pa.array([r[2] for r in rows], pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _combine(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Adds up vectors and counts of equal keys that meet in one task.

    Streams over batches and holds about HELD_SUMS sums. A flush keeps the key of
    the last row open, so input sorted by key gives exactly one row per key; other
    input may give several, which the next round of the tree adds up.
    """
    fields = [df.schema[k] for k in keys]
    schema = StructType(
        [*fields, StructField(vec, ArrayType(DoubleType())), StructField("_n", LongType())]
    )
    names = schema.names

    def run(batches):
        held, types = {}, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [(k, batch.column(k).type) for k in keys]
            lists = batch.column(vec)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
            counts = batch.column("_n").to_numpy()
            index = {}
            columns = [batch.column(k).to_pylist() for k in keys]
            group = np.fromiter(
                (index.setdefault(k, len(index)) for k in zip(*columns)), "int64", batch.num_rows
            )
            dims = np.unique(sizes[sizes > 0])
            if len(dims) == 0:
                continue
            if len(dims) > 1:
                raise ValueError("vectors of one pooling job must have one length")
            rows = sizes > 0
            order = np.argsort(group[rows], kind="stable")
            groups, first = np.unique(group[rows][order], return_index=True)
            sums = np.add.reduceat(flat.reshape(-1, dims[0])[order], first, axis=0)
            totals = np.add.reduceat(counts[rows][order], first)
            by_group = list(index)
            for g, s, n in zip(groups, sums, totals):
                key = by_group[g]
                if key in held:
                    old = held[key]
                    held[key] = (key, old[1] + s, old[2] + int(n))
                else:
                    held[key] = (key, s, int(n))
            if len(held) > HELD_SUMS:
                last = tuple(c[-1] for c in columns)
                still_open = {last: held.pop(last)} if last in held else {}
                yield _flush(types, names, held)
                held = still_open
        if held:
            yield _flush(types, names, held)

    return df.mapInArrow(run, schema)


def vector_sum(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Element-wise sum and row count per key as a tree: inside each input task,
    then per (key, salt) when many tasks read the input, then per key.

    Whole vectors are shuffled, never exploded elements, and a key that owns a
    third of the rows arrives as one partial sum per task.
    """
    keys = list(keys)
    partial = _combine(df.select(*keys, vec, F.lit(1).cast("long").alias("_n")), keys, vec)
    # vectors are wide: a group of more than a hundred partial sums is merged in two steps
    salts = salt_count(df, 1000)
    if salts > 1:
        partial = partial.repartition(
            *keys, F.pmod(F.spark_partition_id(), F.lit(salts))
        ).sortWithinPartitions(*keys)
        partial = _combine(partial, keys, vec)
    return _combine(partial.repartition(*keys).sortWithinPartitions(*keys), keys, vec)


def centroid(df: DataFrame, keys: Sequence[str], vec: str = "embedding") -> DataFrame:
    """Mean of the vectors per key, scaled to unit length (a zero mean stays zero)."""
    keys = list(keys)
    sums = vector_sum(df, keys, vec)
    mean = sums.withColumn(vec, F.transform(vec, lambda x: x / F.col("_n")))
    return mean.select(*keys, V.l2_normalize(vec).alias(vec))


def union_views(*frames: DataFrame) -> DataFrame:
    """View vectors of several companions as one frame."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
