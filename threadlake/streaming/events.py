"""File-change events: source, filter, classification, debounce, rename grace.

Events carry path, op in create / write / remove / rename, ts (timestamp), and in batch
form seq to order equal times. Streams compare events by their times and wait by the clock
(``timers``), so none is dropped and the last one needs no later one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions import paths as P
from threadlake.streaming.timers import first_stream, renamed_stream, settle_stream

EVENT_SCHEMA = "path string, op string, ts timestamp, seq long"

# Quiet time of a path and grace of a rename; and how long a request stands.
DEBOUNCE = "750 milliseconds"
RENAME_GRACE = "2 seconds"
DELAY = "10 seconds"

PRESENT_OPS = ("create", "write")


def micros(interval: str) -> int:
    """'750 milliseconds' -> 750000."""
    return int(pd.Timedelta(interval) / pd.Timedelta("1us"))


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Stream of the event files that appear below ``path``."""
    return spark.readStream.format(fmt).schema(EVENT_SCHEMA).options(**options).load(path)


def relevant_events(events: DataFrame) -> DataFrame:
    """Events on catalogue files and companions only."""
    return events.where(P.ext("path").isin(*P.ITEM_EXTS, *P.COMPANION_EXTS))


def event_action() -> Column:
    """index / delete / delete_later for items, reindex_owner for companions."""
    item = P.is_supported("path")
    return (
        F.when(item & (F.col("op") == "remove"), "delete")
        .when(item & (F.col("op") == "rename"), "delete_later")
        .when(item & F.col("op").isin(*PRESENT_OPS), "index")
        .when(~item & F.col("op").isin(*PRESENT_OPS, "remove", "rename"), "reindex_owner")
    )


def classify_events(events: DataFrame) -> DataFrame:
    """Relevant events with their action; other ops are dropped."""
    return relevant_events(events).withColumn("action", event_action()).where("action is not null")


def owners(items: DataFrame, path: str = "file_path") -> DataFrame:
    """One item per directory and stem; '.emb' before other spellings."""
    return (
        items.where(P.is_supported(path))
        .groupBy(P.dirname(path).alias("_dir"), P.stem(path).alias("_stem"))
        .agg(F.min_by(path, F.struct(P.raw_ext(path) != ".emb", F.col(path))).alias("owner"))
    )


def to_owner(events: DataFrame, items: DataFrame, path: str = "file_path") -> DataFrame:
    """T4: index requests of classified events: items for themselves, companions for the
    item they belong to (companions without one vanish). Column target."""
    placed = events.withColumn("_dir", P.dirname("path")).withColumn("_stem", P.stem("path"))
    joined = placed.join(owners(items, path), ["_dir", "_stem"], "left")
    target = F.when(F.col("action") == "reindex_owner", F.col("owner")).otherwise(F.col("path"))
    return joined.select(*events.columns, target.alias("target")).where("target is not null")


def dedupe_targets(events: DataFrame, quiet: str = DELAY) -> DataFrame:
    """T4: one request per target of a stream in ``quiet``, the first one."""
    return first_stream(events, quiet)


# -- debounce ------------------------------------------------------------------


def debounce(
    events: DataFrame, gap: str = DEBOUNCE, segment: str = "1 day", key: str = "path"
) -> DataFrame:
    """T2, batch form: one row per burst of events on a path, at its last event.

    Events up to and including ``gap`` apart belong together. Three steps keep a busy
    path off a single task: events of one path inside one gap-long slot are merged by a
    map-side aggregate (they always belong together); bursts are found inside segments
    of the timeline; and only one row per segment is carried over to the next.
    Columns path, op (of the last event), first_ts, last_ts, n.
    """
    width = micros(gap)
    slots_per_segment = max(1, micros(segment) // width)
    us = F.unix_micros("ts")
    slots = (
        events.select(key, "op", "seq", us.alias("_us"), F.floor(us / F.lit(width)).alias("_slot"))
        .groupBy(key, "_slot")
        .agg(
            F.min("_us").alias("_lo"),
            F.max("_us").alias("_hi"),
            F.max(F.struct("_us", "seq", "op")).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        .withColumn("_seg", F.floor(F.col("_slot") / F.lit(slots_per_segment)))
    )
    # inside a segment: a burst starts where the gap to the slot before is too long
    inside = Window.partitionBy(key, "_seg").orderBy("_slot")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    far = F.col("_lo") - F.lag("_hi").over(inside) > width
    cut = slots.withColumn("_starts", F.when(far, 1).otherwise(0).cast("long"))
    # across segments: does the first slot start one too, and how many came before
    across = Window.partitionBy(key).orderBy("_seg")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag("_end").over(across)
    base = (
        cut.groupBy(key, "_seg")
        .agg(F.min("_lo").alias("_begin"), F.max("_hi").alias("_end"), F.sum("_starts").alias("_s"))
        .withColumn(
            "_first", F.when(last.isNull() | (F.col("_begin") - last > width), 1).otherwise(0)
        )
        .select(
            key,
            "_seg",
            (
                F.coalesce(F.sum(F.col("_s") + F.col("_first")).over(earlier), F.lit(0))
                + F.col("_first")
            ).alias("_base"),
        )
    )
    bursts = cut.withColumn("_local", F.sum("_starts").over(upto)).join(base, [key, "_seg"])
    bursts = bursts.withColumn("_burst", F.col("_local") + F.col("_base"))
    return (
        bursts.groupBy(key, "_burst")
        .agg(
            F.max("_last").alias("_last"),
            F.min("_lo").alias("_lo"),
            F.sum("_n").alias("n"),
        )
        .select(
            key,
            F.col("_last.op").alias("op"),
            F.timestamp_micros("_lo").alias("first_ts"),
            F.timestamp_micros(F.col("_last._us")).alias("last_ts"),
            "n",
        )
    )


def debounce_stream(
    events: DataFrame, gap: str = DEBOUNCE, grace: str = RENAME_GRACE, quiet: str | None = None, key: str = "path"
) -> DataFrame:
    """T2, stream form: ``debounce`` over whatever number of triggers, see ``settle_stream``."""
    return settle_stream(events, gap, grace, quiet, key)


def debounce_by_watermark(
    events: DataFrame, gap: str = DEBOUNCE, delay: str = DELAY, key: str = "path"
) -> DataFrame:
    """T2 by event time alone, for runs that end (``availableNow``): a session window per path,
    emitted once the watermark passes it; what lies behind the watermark is dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(key, F.session_window("ts", gap).alias("_w"))
        .agg(
            F.max(F.struct("ts", "seq", "op")).alias("_last"),
            F.min("ts").alias("first_ts"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(key, F.col("_last.op").alias("op"), "first_ts", F.col("_last.ts").alias("last_ts"), "n")
    )


# -- rename grace ----------------------------------------------------------------


def rename_cleanup(
    events: DataFrame, catalog: DataFrame | None = None, grace: str = RENAME_GRACE
) -> DataFrame:
    """T5, batch form: item paths to delete, with the rename time.

    A renamed item goes unless its path is created or written again after the rename
    and within ``grace``. Returns only paths of ``catalog`` if given.

    The interval test is two lookups by (path, time slot): presence events are reduced
    to the first and last of each grace-long slot, the last one answers for the slot of
    the rename and the first one for the slot after it. No event meets another one.
    """
    width = micros(grace)
    items = events.where(P.is_supported("path"))
    us = F.unix_micros("ts")
    timed = items.select("path", "op", us.alias("_us"), F.floor(us / F.lit(width)).alias("_slot"))
    renames = timed.where("op = 'rename'").select("path", "_us", "_slot").distinct()
    back = (
        timed.where(F.col("op").isin(*PRESENT_OPS))
        .groupBy("path", "_slot")
        .agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    )
    same = back.select("path", "_slot", F.col("_hi").alias("_same"))
    later = back.select("path", (F.col("_slot") - 1).alias("_slot"), F.col("_lo").alias("_next"))
    gone = (
        renames.join(same, ["path", "_slot"], "left")
        .join(later, ["path", "_slot"], "left")
        .where(
            ~(
                F.coalesce(F.col("_same") > F.col("_us"), F.lit(False))
                | F.coalesce(F.col("_next") <= F.col("_us") + width, F.lit(False))
            )
        )
        .select("path", F.timestamp_micros("_us").alias("renamed_at"))
    )
    if catalog is not None:
        known = catalog.select(F.col("file_path").alias("path"))
        gone = gone.join(known, "path", "left_semi")
    return gone


def rename_cleanup_stream(
    events: DataFrame, grace: str = RENAME_GRACE, wait: str | None = None
) -> DataFrame:
    """T5, stream form: renames that no presence event has answered, see ``renamed_stream``."""
    watched = events.where(P.is_supported("path")).where(F.col("op").isin("rename", *PRESENT_OPS))
    return renamed_stream(watched, grace, wait)
