"""Embedding jobs (U1, U5): the encoder is the one plug-in point.

An encoder factory returns a callable that takes a list of uint8 RGB arrays and gives
one vector per image. It is called once per task, inside the executor.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from threadlake.operators.images import PIXELS, augment_views, on_white, pictures
from threadlake.operators.pooling import centroid

Encoder = Callable[[list[np.ndarray]], np.ndarray]

# Images given to the encoder in one call.
ENCODE_BATCH = 256


def grid_encoder(cells: int = 2) -> Callable[[], Encoder]:
    """A deterministic stand-in encoder: mean colour of each cell of a grid."""

    def factory() -> Encoder:
        def encode(images: list[np.ndarray]) -> np.ndarray:
            out = np.empty((len(images), cells * cells * 3))
            for i, a in enumerate(images):
                h, w = a.shape[:2]
                means = [
                    a[h * r // cells : h * (r + 1) // cells, w * c // cells : w * (c + 1) // cells]
                    .reshape(-1, 3)
                    .mean(axis=0)
                    for r in range(cells)
                    for c in range(cells)
                ]
                out[i] = np.concatenate(means)
            return out

        return encode

    return factory


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; zero rows stay zero."""
    v = np.asarray(vectors, "float64")
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=v.copy(), where=length > 0)


def embed(
    images: DataFrame,
    encoder_factory: Callable[[], Encoder],
    keys: Sequence[str] = ("img_id", "view_id"),
    out: str = "embedding",
    batch_size: int = ENCODE_BATCH,
) -> DataFrame:
    """Unit-length vectors of all images; views of many images share a batch.

    An image the encoder cannot take (empty or null data) gets a null vector.
    """
    keys = list(keys)
    schema = StructType(
        [*[images.schema[k] for k in keys], StructField(out, ArrayType(FloatType()))]
    )

    def run(batches):
        encode = encoder_factory()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                arrays = [on_white(a) if a is not None and a.size else None for a in pictures(part)]
                good = [a for a in arrays if a is not None]
                vectors = iter(unit_rows(encode(good)).astype("float32")) if good else iter(())
                column = pa.array(
                    [None if a is None else next(vectors) for a in arrays], pa.list_(pa.float32())
                )
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in keys], column], names=schema.names
                )

    return images.select(*keys, *PIXELS).mapInArrow(run, schema)


def companion_vectors(
    images: DataFrame,
    encoder_factory: Callable[[], Encoder],
    item: str = "item_id",
    key: str = "img_id",
) -> DataFrame:
    """One vector per item from all augmented views of all its companion images
    (U3, U1, A6). ``images`` carries the item each image belongs to."""
    views = augment_views(images, [item, key])
    vectors = embed(views, encoder_factory, [item, key, "view_id"])
    return centroid(vectors.where("embedding is not null"), [item], "embedding")


def png(image: np.ndarray) -> bytes:
    """A picture (height, width, 1 / 3 / 4 channels, 8 bits) as a PNG file."""
    height, width, channels = image.shape
    lines = np.zeros((height, 1 + width * channels), np.uint8)  # each line starts with its filter, none
    lines[:, 1:] = image.reshape(height, -1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def shrink(image: np.ndarray, side: int) -> np.ndarray:
    """The picture in whole steps down to at most ``side`` pixels a side, each the mean of its square."""
    step = -(-max(image.shape[:2]) // side)
    if step <= 1:
        return image
    high, wide = (np.arange(0, n, step) for n in image.shape[:2])
    sums = np.add.reduceat(np.add.reduceat(image.astype("float64"), high, axis=0), wide, axis=1)
    cells = np.outer(np.diff(np.append(high, image.shape[0])), np.diff(np.append(wide, image.shape[1])))
    return np.round(sums / cells[:, :, None]).astype(np.uint8)


def image_embedder(
    decode: Callable[[bytes], np.ndarray | None],
    encoder_factory: Callable[[], Encoder],
    preview_side: int = 1024,
    thumbnail_side: int = 256,
    batch_size: int = ENCODE_BATCH,
) -> Callable[[DataFrame], DataFrame]:
    """The embedder of scans and streams over files that hold pictures: (id, content) -> id,
    embedding, preview_png, thumbnail.

    ``decode`` turns one content into a picture (height, width, channels), or None; what it
    cannot read, or refuses with ValueError, has nulls. It and the encoder run on the
    executors, ``batch_size`` contents at a time.
    """
    schema = "id string, embedding array<float>, preview_png binary, thumbnail binary"

    def read(content: bytes | None) -> np.ndarray | None:
        try:
            found = decode(content) if content else None
        except ValueError:
            return None
        return None if found is None or not found.size else on_white(found)

    def run(batches):
        encode = encoder_factory()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                pictures = [read(c.as_py()) for c in part.column(1)]
                good = [p for p in pictures if p is not None]
                vectors = iter(unit_rows(encode(good)).astype("float32")) if good else iter(())
                columns = [
                    part.column(0),
                    pa.array([None if p is None else next(vectors) for p in pictures], pa.list_(pa.float32())),
                    pa.array([None if p is None else png(shrink(p, preview_side)) for p in pictures], pa.binary()),
                    pa.array([None if p is None else png(shrink(p, thumbnail_side)) for p in pictures], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "embedding", "preview_png", "thumbnail"])

    return lambda contents: contents.select("id", "content").mapInArrow(run, schema)
