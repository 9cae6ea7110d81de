"""Stitch-record sequences (W4-W6, A14, A15, F18, F19) and design metadata.

``stitches``: design_id, seq, x, y, cmd. ``seq`` is unique within a design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import scalars as S
from threadlake.operators.ordered import SEGMENT_ROWS, ordered_columns, with_segment

# Record commands.
STITCH, JUMP, TRIM, COLOR_CHANGE = "STITCH", "JUMP", "TRIM", "COLOR_CHANGE"
ENDINGS = ("END", "STOP")


def until_end(stitches: DataFrame) -> DataFrame:
    """Records before the first END or STOP of their design."""
    ends = (
        stitches.where(F.col("cmd").isin(*ENDINGS))
        .groupBy("design_id")
        .agg(F.min("seq").alias("_end"))
    )
    joined = stitches.join(ends, "design_id", "left")
    return joined.where(F.col("_end").isNull() | (F.col("seq") < F.col("_end"))).drop("_end").select(
        *stitches.columns
    )


def _changes() -> Column:
    return F.when(F.col("cmd") == COLOR_CHANGE, 1).otherwise(0).cast("long")


def with_color_index(stitches: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Number of colour changes up to and including each record."""
    cut = with_segment(stitches, "seq", segment_rows)
    return ordered_columns(
        cut, ["design_id"], ["seq"], totals={"color_index": _changes()}
    ).drop("_seg")


def segments(stitches: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Lines drawn before the first end record: a STITCH whose previous record is
    positional. The needle's position is forgotten after a colour change, a trim and at
    the start."""
    cut = with_segment(until_end(stitches), "seq", segment_rows)
    prev = ordered_columns(
        cut,
        ["design_id"],
        ["seq"],
        totals={"color_index": _changes()},
        previous={"_prev": ["x", "y", "cmd"]},
    )
    drawn = prev.where(
        (F.col("cmd") == STITCH)
        & F.col("_prev").isNotNull()
        & ~F.col("_prev.cmd").isin(COLOR_CHANGE, TRIM)
    )
    return drawn.select(
        "design_id",
        "seq",
        F.col("_prev.x").alias("x0"),
        F.col("_prev.y").alias("y0"),
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        "color_index",
    )


def design_stats(stitches: DataFrame) -> DataFrame:
    """Stitches, trims (TRIM or JUMP), colours = changes + 1."""
    cmd = F.col("cmd")
    return stitches.groupBy("design_id").agg(
        F.count_if(cmd == STITCH).alias("stitch_count"),
        F.count_if(cmd.isin(TRIM, JUMP)).alias("trim_count"),
        F.greatest(F.lit(1), F.count_if(cmd == COLOR_CHANGE) + 1).cast("long").alias("color_count"),
    )


def design_bbox(stitches: DataFrame) -> DataFrame:
    """Bounding box; an extent of zero counts as one."""
    def extent(hi: str, lo: str):
        return F.coalesce(F.nullif(F.col(hi) - F.col(lo), F.lit(0)), F.lit(1))

    return (
        stitches.groupBy("design_id")
        .agg(
            F.min("x").alias("min_x"),
            F.max("x").alias("max_x"),
            F.min("y").alias("min_y"),
            F.max("y").alias("max_y"),
        )
        .select(
            "*", extent("max_x", "min_x").alias("width"), extent("max_y", "min_y").alias("height")
        )
    )


def to_canvas(segs: DataFrame, stitches: DataFrame, size: int = 512) -> DataFrame:
    """F19 over W6: drawn lines in pixels with their fallback colour."""
    box = design_bbox(stitches)
    joined = segs.join(box, "design_id")
    def at(x: str, y: str, n: int):
        px, py = S.to_pixel(
            F.col(x), F.col(y), F.col("min_x"), F.col("max_y"), F.col("width"), F.col("height"), size
        )
        return [px.alias(f"px{n}"), py.alias(f"py{n}")]

    return joined.select(
        "design_id", "seq", *at("x0", "y0", 0), *at("x1", "y1", 1),
        S.palette_color("color_index").alias("rgb"),
    )


def design_metadata(
    files: DataFrame, stitches: DataFrame, headers: DataFrame, estimate: bool = False
) -> DataFrame:
    """Counts from records where a file has any, else from its header, else null.

    ``files``: design_id, file_name, size_bytes. ``headers``: design_id, info, aux (the
    two header blobs). With ``estimate`` missing counts are guessed from the size.
    """
    stats = design_stats(stitches)
    probes = headers.select(
        "design_id",
        S.probe_u32("info").alias("_h_stitches"),
        S.probe_u16("aux").alias("_h_colors"),
    )
    joined = files.join(stats, "design_id", "left").join(probes, "design_id", "left")
    has_records = F.col("color_count").isNotNull()
    stitch_count, source, approximate = S.first_of(
        [("records", F.col("stitch_count")), ("header", F.col("_h_stitches"))]
    )
    # a header is consulted only for files without records
    colors = F.when(has_records, F.col("color_count")).otherwise(F.col("_h_colors"))
    trims = F.col("trim_count")
    out = joined.select(
        "design_id",
        "file_name",
        "size_bytes",
        F.bround(S.size_kb("size_bytes"), 1).alias("size_kb"),
        stitch_count.alias("stitch_count"),
        trims.alias("trim_count"),
        colors.alias("color_count"),
        approximate.alias("approximate"),
        source.alias("source"),
    )
    if estimate:
        guess = S.estimate_meta("size_bytes", F.col("stitch_count"), F.col("color_count"))
        out = out.withColumn("_g", guess)
        for c in ("stitch_count", "color_count", "trim_count"):
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_g.{c}")))
        out = out.drop("_g")
    return out.drop("size_bytes")
