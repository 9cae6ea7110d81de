"""Scalar expressions F4-F22. All are built-in Spark expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes, thresholds and status names.
FINGERPRINT_BYTES = 2 * 1024 * 1024
MEDIA_BYTES = 128 * 1024
SCORE_HIGH, SCORE_MID = 0.6, 0.3
PENDING, IN_PROGRESS, COMPLETED = "Pending", "In Progress", "Completed"
STOPPED, OUTDATED, SCOUTING, ERROR = "Stopped", "Outdated", "Scouting...", "Error"

# Fallback thread colours by index.
PALETTE = (
    (0x1A, 0x1A, 0x1A), (0xFF, 0xFF, 0xFF), (0xFF, 0x00, 0x00), (0x00, 0xAA, 0x00),
    (0x00, 0x00, 0xFF), (0xFF, 0xFF, 0x00), (0xFF, 0x80, 0x00), (0x80, 0x00, 0x80),
    (0x00, 0xCC, 0xCC), (0xFF, 0x66, 0x99), (0x99, 0x66, 0x33), (0x66, 0x99, 0x00),
    (0x00, 0x66, 0xFF), (0xFF, 0x00, 0xFF), (0x00, 0x80, 0x80), (0xC0, 0xC0, 0xC0),
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def size_kb(size_bytes: Column | str) -> Column:
    return _c(size_bytes) / F.lit(1024.0)


def content_id(size_bytes: Column | str, content: Column | str, prefix_bytes: int | None = FINGERPRINT_BYTES) -> Column:
    """hex sha256 over the decimal byte size followed by the first 2 MiB of content, or by
    all of it with None."""
    whole = _c(content).cast("binary")
    head = whole if prefix_bytes is None else F.substring(whole, 1, prefix_bytes)
    size_text = _c(size_bytes).cast("string").cast("binary")
    return F.sha2(F.concat(size_text, head), 256)


def clip_bytes(blob: Column | str, n: int = MEDIA_BYTES) -> Column:
    return F.substring(_c(blob), 1, n)


def score_band(score: Column | str) -> Column:
    score = _c(score)
    return (
        F.when(score >= SCORE_HIGH, F.lit("high"))
        .when(score >= SCORE_MID, F.lit("mid"))
        .otherwise(F.lit("low"))
    )


def pct_text(score: Column | str) -> Column:
    return F.format_string("%.1f%%", _c(score) * F.lit(100.0))


def hits_text(hits: Column | str, total: Column | str) -> Column:
    """'h/t = x.x%'; an empty total counts as one in the ratio only."""
    hits, total = _c(hits), _c(total)
    share = F.bround(hits / F.greatest(total, F.lit(1)) * F.lit(100.0), 1)
    return F.format_string(
        "%d/%d = %.1f%%", hits.cast("long"), total.cast("long"), share
    )


def score_bar(score: Column | str, width: int = 12) -> Column:
    filled = (_c(score) * F.lit(width)).cast("int")
    return F.concat(
        F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled)
    )


def name_number(name: Column | str) -> Column:
    """digits of the first '(digits)' in a name, null if there are none."""
    found = F.regexp_extract(_c(name), r"\((\d+)\)", 1)
    return F.when(found != "", found)


def name_prefix(name: Column | str) -> Column:
    return F.substring(_c(name), 1, 1)


def folder_state(
    status: Column | str, needs_rescan: Column | str, indexed: Column | str, total: Column | str
) -> Column:
    """scanning / ok / outdated / pending."""
    status, needs_rescan, indexed, total = map(_c, (status, needs_rescan, indexed, total))
    complete = (status == COMPLETED) | ((total > 0) & (indexed >= total))
    return (
        F.when(status == IN_PROGRESS, F.lit("scanning"))
        .when(complete, F.lit("ok"))
        .when(needs_rescan | (indexed < total), F.lit("outdated"))
        .otherwise(F.lit("pending"))
    )


def verdict(at1: Column | str, at5: Column | str, at10: Column | str) -> Column:
    """verdict from accuracies in percent."""
    at1, at5, at10 = _c(at1), _c(at5), _c(at10)
    return (
        F.when((at10 == 100) & (at5 == 100) & (at1 >= 90), F.lit("EXCELLENT"))
        .when((at10 >= 95) & (at1 >= 80), F.lit("GOOD"))
        .when(at10 >= 85, F.lit("ACCEPTABLE"))
        .otherwise(F.lit("POOR"))
    )


def estimate_meta(
    size_bytes: Column | str, stitches: Column | None = None, colors: Column | None = None
) -> Column:
    """struct of estimated stitch, colour and trim counts; known counts win."""
    size_bytes = _c(size_bytes)
    kb = F.bround(size_kb(size_bytes), 1)
    guess_st = F.floor(size_bytes / F.lit(0.6)).cast("long")
    guess_co = F.greatest(F.lit(1), F.least(F.lit(50), F.bround(kb / F.lit(3.0), 0))).cast("long")
    st = guess_st if stitches is None else F.coalesce(stitches.cast("long"), guess_st)
    co = guess_co if colors is None else F.coalesce(colors.cast("long"), guess_co)
    trims = F.greatest(F.lit(0), F.bround(st / F.lit(500.0), 0)).cast("long")
    return F.struct(
        st.alias("stitch_count"), co.alias("color_count"), trims.alias("trim_count")
    )


def _little_endian(blob: Column, offset: int, width: int) -> Column:
    """Unsigned little-endian integer at a byte offset, null past the end."""
    digits = F.hex(F.substring(blob, offset + 1, width))
    swapped = F.concat(
        *[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]
    )
    value = F.conv(swapped, 16, 10).cast("long")
    return F.when(F.length(blob) >= offset + width, value)


def probe_u32(
    blob: Column | str,
    offsets: Sequence[int] = (12, 8, 16, 20, 24),
    lo: int = 100,
    hi: int = 5_000_000,
) -> Column:
    """F16: first 32-bit value at the candidate offsets that lies within [lo, hi]."""
    blob = _c(blob)
    # as an array, so that each offset is decoded once
    reads = F.array(*[_little_endian(blob, o, 4) for o in offsets])
    return F.try_element_at(F.filter(reads, lambda v: v.between(lo, hi)), F.lit(1))


def probe_u16(
    blob: Column | str, offset: int = 0, lo: int = 1, hi: int = 100, min_bytes: int = 4
) -> Column:
    """F16: 16-bit value at an offset if within [lo, hi] and the blob has ``min_bytes``."""
    blob = _c(blob)
    value = _little_endian(blob, offset, 2)
    return F.when((F.length(blob) >= min_bytes) & value.between(lo, hi), value)


def first_of(
    strategies: Sequence[tuple[str, Column]], unknown: str = "unknown", required: Column | None = None
) -> list[Column]:
    """value of the first strategy that is not null, its tag, and an approximate flag."""
    value = F.coalesce(*[v for _, v in strategies])
    tag = F.lit(unknown)
    for name, v in reversed(strategies):
        tag = F.when(v.isNotNull(), F.lit(name)).otherwise(tag)
    known = value if required is None else required
    return [value.alias("value"), tag.alias("source"), known.isNull().alias("approximate")]


def unpack_rgb(packed: Column | str) -> Column:
    packed = _c(packed)
    return F.struct(
        F.shiftright(packed, 16).bitwiseAND(F.lit(255)).cast("int").alias("r"),
        F.shiftright(packed, 8).bitwiseAND(F.lit(255)).cast("int").alias("g"),
        packed.bitwiseAND(F.lit(255)).cast("int").alias("b"),
    )


def palette_color(index: Column | str) -> Column:
    """fallback colour, cycling through the palette."""
    table = F.array(
        *[
            F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
            for r, g, b in PALETTE
        ]
    )
    return F.element_at(table, (_c(index) % F.lit(len(PALETTE)) + F.lit(1)).cast("int"))


def to_pixel(
    x: Column, y: Column, min_x: Column, max_y: Column, width: Column, height: Column, size: int = 512
) -> list[Column]:
    """design units to canvas pixels, 8 % padding, y pointing down."""
    pad = int(size * 0.08)
    scale = F.lit(float(size - 2 * pad)) / F.greatest(width, height)
    px = ((x - min_x) * scale).cast("int") + F.lit(pad)
    py = ((max_y - y) * scale).cast("int") + F.lit(pad)
    return [px.alias("px"), py.alias("py")]


def is_foreground(
    rgba: tuple[Column, Column, Column, Column], background: tuple[Column, Column, Column], tolerance: int = 30
) -> Column:
    """opaque enough and further than ``tolerance`` (L1) from the background."""
    r, g, b, a = rgba
    br, bg, bb = background
    return (a >= 128) & (F.abs(r - br) + F.abs(g - bg) + F.abs(b - bb) > tolerance)


def preview_base64(blob: Column | str) -> Column:
    return F.base64(_c(blob))


def progress_pct(done: Column | str, total: Column | str) -> Column:
    """percent capped at 100, 0 when nothing is expected."""
    done, total = _c(done), _c(total)
    return F.when(
        total > 0, F.least(F.lit(100.0), done / total * F.lit(100.0))
    ).otherwise(F.lit(0.0))
