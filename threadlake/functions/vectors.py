"""Vector expressions: dot product (F6), L2 normalisation (F7), float32 blob codec."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double; 0 when the lengths differ."""
    a, b = _c(a), _c(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def norm(v: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(v: Column | str) -> Column:
    """Unit-length vector in double; a zero vector is returned as it is."""
    v = _c(v)
    length = norm(v)
    return F.transform(
        v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))
    )


def decode_vectors(df: DataFrame, blob: str, out: str = "embedding") -> DataFrame:
    """float32 little-endian blobs -> array<float>; trailing bytes are ignored.

    The data buffer of an Arrow batch of blobs already is the vectors' buffer, so
    a batch of whole blobs becomes a list column by dividing its offsets by four.
    """
    schema = StructType(df.schema.fields + [StructField(out, ArrayType(FloatType()))])

    def run(batches):
        for batch in batches:
            column = batch.column(blob).cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], "<i8")[column.offset :][: len(column) + 1]
            sizes = np.diff(ends)
            raw = column.buffers()[2]
            data = np.frombuffer(raw, "u1")[ends[0] : ends[-1]] if raw is not None else np.empty(0, "u1")
            if (sizes % 4).any():
                inside = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], sizes)
                data = data[inside < np.repeat(sizes // 4 * 4, sizes)]
            offsets = np.concatenate(([0], np.cumsum(sizes // 4))).astype("int32")
            vectors = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(data.view("<f4")), mask=column.is_null()
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, vectors], names=[*batch.schema.names, out]
            )

    return df.mapInArrow(run, schema)


def encode_vectors(df: DataFrame, vec: str, out: str = "blob") -> DataFrame:
    """array<float> -> float32 little-endian blobs."""
    schema = StructType(df.schema.fields + [StructField(out, BinaryType())])

    def run(batches):
        for batch in batches:
            column = batch.column(vec)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype("int64")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            offsets = np.concatenate(([0], np.cumsum(sizes * 4))).astype("int32")
            blobs = pa.Array.from_buffers(
                pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]
            )
            blobs = pc.if_else(column.is_null(), pa.scalar(None, pa.binary()), blobs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, blobs], names=[*batch.schema.names, out]
            )

    return df.mapInArrow(run, schema)
