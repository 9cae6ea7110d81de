"""Image jobs.

``images``: id columns plus height, width, channels (3 or 4) and data, the row-major
RGB(A) bytes. One image is one row; the numpy helpers below work on one image.
``pixels``: img_id, x, y, r, g, b, a for the jobs that are plain aggregations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from threadlake.functions import scalars as S

# Images handed on together by a Python stage.
IMAGES_OUT = 64
# Canvas size, enhancement gains, augmentation and background defaults.
CANVAS = 512
CONTRAST_GAIN, COLOR_GAIN = 1.4, 1.3
ANGLE, BRIGHT, DARK = 5, 1.15, 0.85
DEFAULT_FOREGROUND = (60, 60, 60)

PIXELS = ("height", "width", "channels", "data")


def _image_type(keys: Sequence[StructField], extra: Sequence[StructField] = ()) -> StructType:
    return StructType(
        [
            *keys,
            *extra,
            StructField("height", IntegerType()),
            StructField("width", IntegerType()),
            StructField("channels", IntegerType()),
            StructField("data", BinaryType()),
        ]
    )


def pictures(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """The pictures of a batch, as views of its buffers: no pixel is copied and none becomes a
    Python object. None where a size or the data are null."""
    data = batch.column("data")
    wide = pa.types.is_large_binary(data.type)
    _, ends, raw = data.buffers()
    ends = np.frombuffer(ends, "<i8" if wide else "<i4")[data.offset : data.offset + len(data) + 1].tolist()
    raw = np.frombuffer(raw, "u1") if raw is not None else np.zeros(0, "u1")
    shapes = [batch.column(c) for c in PIXELS[:3]]
    known = data.is_valid().to_numpy(zero_copy_only=False)
    for column in shapes:
        known = known & column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in shapes], axis=1).tolist()
    return [raw[a:b].reshape(size) if ok else None for ok, a, b, size in zip(known.tolist(), ends, ends[1:], sizes)]


def map_images(
    images: DataFrame,
    keys: Sequence[str],
    views: Callable[[np.ndarray], Iterator[np.ndarray] | list[np.ndarray]],
    view_col: str | None = None,
) -> DataFrame:
    """Applies ``views`` to each image; each returned array is one output row, numbered
    in ``view_col`` if named; an image with a null size or null data has none. Output leaves in
    small batches, so memory stays bounded."""
    keys = list(keys)
    extra = [StructField(view_col, IntegerType())] if view_col else []
    schema = _image_type([images.schema[k] for k in keys], extra)
    names = schema.names

    def run(batches):
        rows: list[tuple] = []

        def pack(batch):
            source, numbers, made = zip(*rows)
            owner = pa.array(source)
            sizes = np.array([view.shape for view in made], "i4")
            ends = np.concatenate(([0], np.cumsum([view.size for view in made]))).astype("i4")
            flat = np.concatenate([view.ravel() for view in made]) if ends[-1] else np.zeros(0, "u1")
            data = pa.BinaryArray.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            counted = [pa.array(numbers, pa.int32())] if view_col else []
            arrays = [*(batch.column(k).take(owner) for k in keys), *counted, *(pa.array(sizes[:, i]) for i in range(3)), data]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for at, image in enumerate(pictures(batch)):
                rows += [(at, n, view) for n, view in enumerate(views(image) if image is not None else ())]
                if len(rows) >= IMAGES_OUT:
                    yield pack(batch)
                    rows = []
            if rows:
                yield pack(batch)
                rows = []

    return images.select(*keys, *PIXELS).mapInArrow(run, schema)


def from_image_source(df: DataFrame) -> DataFrame:
    """Rows of ``spark.read.format('image')`` as ``images`` keyed by origin: the source
    stores BGR(A) with one to four channels."""
    image = df.select(
        F.col("image.origin").alias("origin"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )

    def to_rgb(a: np.ndarray):
        if a.shape[2] == 1:
            return [np.repeat(a, 3, axis=2)]
        return [np.concatenate((a[:, :, 2::-1], a[:, :, 3:]), axis=2)]

    return map_images(image, ["origin"], to_rgb)


# -- one image at a time -----------------------------------------------------


def on_white(a: np.ndarray) -> np.ndarray:
    """Alpha composited on white; RGB input is returned as it is."""
    if a.shape[2] == 3:
        return a
    alpha = a[:, :, 3:].astype("int64")
    mixed = a[:, :, :3].astype("int64") * alpha + 255 * (255 - alpha)
    return ((mixed + 127) // 255).astype("u1")


def _luma(a: np.ndarray) -> np.ndarray:
    # ITU-R 601 weights in 16-bit fixed point.
    r, g, b = (a[:, :, i].astype("int64") for i in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16


def _blend(base: np.ndarray | float, a: np.ndarray, gain: float) -> np.ndarray:
    return np.clip(base + gain * (a.astype("float64") - base), 0, 255).astype("u1")


def contrast(a: np.ndarray, gain: float) -> np.ndarray:
    return _blend(float(int(_luma(a).mean() + 0.5)), a, gain)


def color(a: np.ndarray, gain: float) -> np.ndarray:
    return _blend(_luma(a)[:, :, None].astype("float64"), a, gain)


def brightness(a: np.ndarray, gain: float) -> np.ndarray:
    return _blend(0.0, a, gain)


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about the centre on the same canvas, nearest pixel, white outside."""
    h, w = a.shape[:2]
    t = np.deg2rad(-degrees)
    cos, sin = np.cos(t), np.sin(t)
    y, x = np.mgrid[0:h, 0:w] + 0.5
    u = np.floor(cos * (x - w / 2) + sin * (y - h / 2) + w / 2).astype("int64")
    v = np.floor(-sin * (x - w / 2) + cos * (y - h / 2) + h / 2).astype("int64")
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    out = np.full_like(a, 255)
    out[inside] = a[v[inside], u[inside]]
    return out


def pad_square(a: np.ndarray, size: int = CANVAS) -> np.ndarray:
    """Shrinks to fit (nearest pixel) and centres on a white square."""
    h, w = a.shape[:2]
    scale = min(1.0, size / max(h, w))
    if scale < 1.0:
        nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
        a = a[np.arange(nh) * h // nh][:, np.arange(nw) * w // nw]
        h, w = nh, nw
    out = np.full((size, size, 3), 255, "u1")
    top, left = (size - h) // 2, (size - w) // 2
    out[top : top + h, left : left + w] = a
    return out


def prepared(a: np.ndarray, size: int = CANVAS) -> np.ndarray:
    return pad_square(color(contrast(on_white(a), CONTRAST_GAIN), COLOR_GAIN), size)


def tiles(a: np.ndarray) -> list[np.ndarray]:
    """Four quadrants (those of at least one pixel), then the whole image."""
    h, w = a.shape[:2]
    cuts = [a[: h // 2, : w // 2], a[: h // 2, w // 2 :], a[h // 2 :, : w // 2], a[h // 2 :, w // 2 :]]
    return [c for c in cuts if c.size] + [a]


def augmented(a: np.ndarray) -> list[np.ndarray]:
    """Base, mirror, two rotations, brighter, darker."""
    return [a, a[:, ::-1], rotate(a, ANGLE), rotate(a, -ANGLE), brightness(a, BRIGHT), brightness(a, DARK)]


# -- jobs ----------------------------------------------------------------------


def prepare_images(images: DataFrame, keys: Sequence[str] = ("img_id",), size: int = CANVAS) -> DataFrame:
    """U4: composite on white, contrast and colour gain, centred on a white square."""
    return map_images(images, keys, lambda a: [prepared(a, size)])


def expand_views(
    images: DataFrame, keys: Sequence[str] = ("img_id",), mode: str = "tiles"
) -> DataFrame:
    """Up to four regions and the whole image, which comes last (view_id)."""
    if mode not in ("tiles", "whole"):
        raise ValueError(f"unknown view mode {mode!r}")
    cut = tiles if mode == "tiles" else (lambda a: [a])
    return map_images(images, keys, lambda a: cut(on_white(a)), "view_id")


def augment_views(images: DataFrame, keys: Sequence[str] = ("img_id",)) -> DataFrame:
    """Six views of each image (view_id 0..5)."""
    return map_images(images, keys, lambda a: augmented(on_white(a)), "view_id")


def pixel_table(images: DataFrame, key: str = "img_id") -> DataFrame:
    """``images`` as one row per pixel; alpha is 255 for RGB images. JVM only."""
    at = F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("_i")

    def channel(n: int) -> Column:
        byte = F.substring("data", F.col("_i") * F.col("channels") + F.lit(n + 1), F.lit(1))
        return F.conv(F.hex(byte), 16, 10).cast("int")

    return images.where("height > 0 and width > 0").select(key, "width", "channels", "data", at).select(
        key,
        (F.col("_i") % F.col("width")).alias("x"),
        F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"),
        channel(0).alias("r"),
        channel(1).alias("g"),
        channel(2).alias("b"),
        F.when(F.col("channels") == 4, channel(3)).otherwise(F.lit(255)).alias("a"),
    )


def corner_background(pixels: DataFrame, key: str = "img_id") -> DataFrame:
    """Integer mean of the four corner pixels per image (bg_r, bg_g, bg_b)."""
    rgb = F.struct("r", "g", "b")
    across, down = F.struct("x", "y"), F.struct("x", -F.col("y"))
    corners = pixels.groupBy(key).agg(
        F.min_by(rgb, across).alias("c0"),
        F.max_by(rgb, across).alias("c1"),
        F.min_by(rgb, down).alias("c2"),
        F.max_by(rgb, down).alias("c3"),
    )

    def mean(ch: str) -> Column:
        return F.floor(sum(F.col(f"c{i}.{ch}") for i in range(4)) / F.lit(4)).cast("int")

    return corners.select(key, *[mean(ch).alias(f"bg_{ch}") for ch in "rgb"])


def with_foreground(pixels: DataFrame, key: str = "img_id", tolerance: int = 30) -> DataFrame:
    """flags each pixel against the corner background of its image."""
    rgba = tuple(F.col(c) for c in "rgba")
    background = tuple(F.col(f"bg_{c}") for c in "rgb")
    return pixels.join(corner_background(pixels, key), key).withColumn(
        "foreground", S.is_foreground(rgba, background, tolerance)
    )


def color_profile(pixels: DataFrame, key: str = "img_id", tolerance: int = 30) -> DataFrame:
    """Background, foreground pixel count and upper-median foreground colour.

    The medians come from channel histograms (at most 256 rows per image and channel),
    so no image's pixels are collected.
    """
    flagged = with_foreground(pixels, key, tolerance)
    base = flagged.groupBy(key).agg(
        *[F.first(f"bg_{c}").alias(f"bg_{c}") for c in "rgb"],
        F.count_if("foreground").alias("n_fg"),
    )
    channels = F.explode(
        F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("v")) for c in "rgb"])
    ).alias("s")
    hist = (
        flagged.where("foreground")
        .select(key, channels)
        .groupBy(key, F.col("s.ch").alias("ch"), F.col("s.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    part = Window.partitionBy(key, "ch")
    upto = part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    median = (
        hist.withColumn("_cum", F.sum("n").over(upto))
        .withColumn("_all", F.sum("n").over(part))
        .where(F.col("_cum") > F.floor(F.col("_all") / 2))
        .groupBy(key)
        .agg(*[F.min(F.when(F.col("ch") == c, F.col("v"))).alias(f"fg_{c}") for c in "rgb"])
    )
    defaults = dict(zip("rgb", DEFAULT_FOREGROUND))
    return base.join(median, key, "left").select(
        key,
        *[f"bg_{c}" for c in "rgb"],
        "n_fg",
        *[F.coalesce(f"fg_{c}", F.lit(defaults[c])).alias(f"fg_{c}") for c in "rgb"],
    )


def image_profile(images: DataFrame, key: str = "img_id", tolerance: int = 30) -> DataFrame:
    """A16 on packed images: the same columns as ``color_profile``, without a shuffle,
    since every image is one row."""
    names = [key, *[f"bg_{c}" for c in "rgb"], "n_fg", *[f"fg_{c}" for c in "rgb"]]
    ints = [StructField(n, IntegerType()) for n in names[1:4]]
    last = [StructField(n, IntegerType()) for n in names[5:]]
    schema = StructType([images.schema[key], *ints, StructField("n_fg", LongType()), *last])

    def profile(a: np.ndarray) -> tuple[int, ...]:
        h, w, channels = a.shape
        rgb = a[:, :, :3].astype("int64")
        background = (rgb[0, 0] + rgb[0, w - 1] + rgb[h - 1, 0] + rgb[h - 1, w - 1]) // 4
        far = np.abs(rgb - background).sum(axis=2) > tolerance
        shown = rgb[far & (a[:, :, 3] >= 128)] if channels == 4 else rgb[far]
        n = len(shown)
        middle = np.sort(shown, axis=0)[n // 2] if n else DEFAULT_FOREGROUND
        return (*map(int, background), n, *map(int, middle))

    def run(batches):
        for batch in batches:
            shown = [(i, profile(a)) for i, a in enumerate(pictures(batch)) if a is not None]
            if shown:
                at, rows = zip(*shown)
                types = [pa.int32()] * 3 + [pa.int64()] + [pa.int32()] * 3
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), *columns], names=names)

    return images.where("height > 0 and width > 0").select(key, *PIXELS).mapInArrow(run, schema)


def is_canvas(r: Column, g: Column, b: Column) -> Column:
    """Light beige: red not far above green, red above blue, bright enough."""
    # Thresholds of the beige canvas test.
    return (F.greatest(r - g, F.lit(0)) < 30) & ((r - b) > 5) & (r > 180)


def content_box(
    pixels: DataFrame, predicate: Column, key: str = "img_id", margin: int = 5, min_lines: int = 50
) -> DataFrame:
    """Box around the pixels that pass, ``margin`` added at the top left; the centre
    80 % if fewer than ``min_lines`` rows or columns have such a pixel."""
    hit = pixels.withColumn("_hit", predicate)
    box = hit.groupBy(key).agg(
        (F.max("x") + 1).alias("w"),
        (F.max("y") + 1).alias("h"),
        F.min(F.when(F.col("_hit"), F.col("x"))).alias("lx"),
        F.max(F.when(F.col("_hit"), F.col("x"))).alias("hx"),
        F.min(F.when(F.col("_hit"), F.col("y"))).alias("ly"),
        F.max(F.when(F.col("_hit"), F.col("y"))).alias("hy"),
    )
    lines = [
        hit.where("_hit").groupBy(key, axis).agg(F.lit(1).alias("_o")).groupBy(key)
        .agg(F.count(F.lit(1)).alias(f"n_{axis}"))
        for axis in ("x", "y")
    ]
    joined = box.join(lines[0], key, "left").join(lines[1], key, "left")
    enough = F.coalesce(F.least("n_x", "n_y"), F.lit(0)) >= min_lines
    px, py = F.floor(F.col("w") / 10), F.floor(F.col("h") / 10)
    # least() ignores nulls; an axis without hits is covered by the flag below
    enough = enough & F.col("n_x").isNotNull() & F.col("n_y").isNotNull()

    def pick(found: Column, centre: Column) -> Column:
        return F.when(enough, found).otherwise(centre).cast("int")

    return joined.select(
        key,
        pick(F.greatest(F.lit(0), F.col("lx") - margin), px).alias("x0"),
        pick(F.greatest(F.lit(0), F.col("ly") - margin), py).alias("y0"),
        pick(F.col("hx"), F.col("w") - px).alias("x1"),
        pick(F.col("hy"), F.col("h") - py).alias("y1"),
        enough.alias("found"),
    )
