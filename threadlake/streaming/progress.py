"""Progress, stall and liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.operators.ordered import SEGMENT_ROWS, ordered_columns, with_segment
from threadlake.streaming.events import micros
from threadlake.streaming.timers import stall_stream

# Flush step, stall and liveness limits, refresh periods.
FLUSH_EVERY = 50
STALL = "2 minutes"
ALIVE = "15 seconds"
DISCOVERY_EVERY = "30 minutes"
STATS_EVERY = "5 seconds"
FEED_EVERY = "1 second"


def progress_summary(events: DataFrame) -> DataFrame:
    """Counters of progress events (discovered, processed, total, scan_done); the
    total shown is what was discovered until the scan is done. Works on streams too."""
    return events.agg(
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("discovered"), F.lit(0)).alias("_disc"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("_total"),
        F.coalesce(F.max("scan_done"), F.lit(False)).alias("scan_done"),
    ).select(
        "processed",
        F.when(F.col("scan_done"), F.col("_total")).otherwise(F.col("_disc")).alias("total"),
        "scan_done",
    )


def progress(events: DataFrame, root: str = "root") -> DataFrame:
    """Files finished per root, running; on a stream use output mode 'update'."""
    return events.groupBy(root).agg(F.count(F.lit(1)).alias("processed"))


def progress_flushes(
    events: DataFrame, root: str = "root", order: str = "seq", file: str = "path",
    every: int = FLUSH_EVERY, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """T8, batch form: the checkpoints a scan writes per root: one at each ``every``-th
    file, and a final one without a file name. Columns root, last_file, processed, final."""
    cut = with_segment(events.select(root, order, file), order, segment_rows)
    counted = ordered_columns(cut, [root], [order], totals={"processed": F.lit(1).cast("long")})
    steps = counted.where(F.col("processed") % every == 0).select(
        root, F.col(file).alias("last_file"), "processed", F.lit(False).alias("final")
    )
    ends = progress(events, root).select(
        root, F.lit("").alias("last_file"), "processed", F.lit(True).alias("final")
    )
    return steps.unionByName(ends)


def progress_stream(events: DataFrame, sink, root: str = "root", every: str = FEED_EVERY, **options):
    """Live feed; ``sink(batch_df, batch_id)`` gets the changed counters each period."""
    return (
        progress(events, root)
        .writeStream.outputMode("update")
        .options(**options)
        .trigger(processingTime=every)
        .foreachBatch(sink)
    )


def stalled(
    events: DataFrame, limit: str = STALL, key: str = "root", segment: str = "1 day",
    now: Column | None = None,
) -> DataFrame:
    """T9, batch form: gaps longer than ``limit`` between progress events of a running,
    not paused key. ``now`` closes the open gap after the last event.

    Events (key, ts, running, paused) are first reduced to one row per instant, so the
    order is total; gaps are looked up inside segments of the timeline.
    """
    us = F.unix_micros("ts")
    instants = (
        events.select(key, us.alias("_us"), "running", "paused")
        .groupBy(key, "_us")
        .agg(F.max("running").alias("running"), F.max("paused").alias("paused"))
    )
    cut = with_segment(instants, "_us", micros(segment))
    linked = ordered_columns(cut, [key], ["_us"], following={"_next": ["_us"]})
    end = F.col("_next._us")
    if now is not None:
        end = F.coalesce(end, F.unix_micros(now))
    active = F.col("running") & ~F.col("paused")
    return linked.where(active & (end - F.col("_us") > micros(limit))).select(
        key, F.timestamp_micros("_us").alias("last_progress_at"), (end - F.col("_us")).alias("idle_us")
    )


def stalled_stream(events: DataFrame, limit: str = STALL, key: str = "root") -> DataFrame:
    """T9, stream form: keys that run unpaused without progress for ``limit``, see ``stall_stream``."""
    return stall_stream(events, limit, key)


def alive(beats: DataFrame, now: Column, limit: str = ALIVE, key: str = "client") -> DataFrame:
    """Last heartbeat per client and whether it is within ``limit`` of ``now``."""
    idle = F.unix_micros(now) - F.unix_micros("last_beat")
    return (
        beats.groupBy(key)
        .agg(F.max("ts").alias("last_beat"))
        .select(key, "last_beat", (idle < micros(limit)).alias("alive"))
    )


def periodic(stream: DataFrame, run, every: str = DISCOVERY_EVERY, **options):
    """``run(batch_df, batch_id)`` once per period, e.g. discovery or totals."""
    return stream.writeStream.options(**options).trigger(processingTime=every).foreachBatch(run)
