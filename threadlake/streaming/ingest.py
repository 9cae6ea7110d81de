"""Incremental catalogue ingestion (T6, T7, T12, T13): batch and stream share one path."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import paths as P
from threadlake.functions import scalars as S
from threadlake.operators.catalog import plan_scan, split_unchanged
from threadlake.operators.folders import changed_folders, count_deltas, event_marks
from threadlake.operators.joins import left_lookup
from threadlake.session import stage, staging
from threadlake.sources import tables
from threadlake.sources.files import fingerprint_files, load_files, walk_files
from threadlake.sources.known import stem_key
from threadlake.sources.media import fold_media, write_media
from threadlake.streaming import events as EV

# The schema of Spark's binaryFile source, which streams have to name.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"

# DataFrame (id, content) -> DataFrame (id, embedding); a null vector marks a failure. It may
# have preview_png and thumbnail as well, which become the item's media.
Embedder = Callable[[DataFrame], DataFrame]
# DataFrame (id, file_path) -> DataFrame (id, content)
Loader = Callable[[DataFrame], DataFrame]


class Changes:
    """What one batch does to the catalogue: ``outcomes`` per file, new ``rows``, and the
    ids and paths that no longer hold their old row; ``media`` of new contents, if the
    embedder makes any."""

    def __init__(self, outcomes: DataFrame, rows: DataFrame, ids: DataFrame, paths: DataFrame, media: DataFrame | None = None):
        self.outcomes, self.rows, self.ids, self.paths, self.media = outcomes, rows, ids, paths, media

    def taken_from(self, by_id: DataFrame, by_path: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
        """Rows (id, file_path) that leave the catalogue or change there, out of those it has
        for the ids and the paths of the batch."""
        paths = self.paths if deleted is None else self.paths.unionByName(deleted)
        one = by_id.join(self.ids, "id", "left_semi").select("id", "file_path")
        two = by_path.join(paths, "file_path", "left_semi").select("id", "file_path")
        return one.unionByName(two).distinct()

    def applied_to(self, catalog: DataFrame) -> DataFrame:
        kept = catalog.join(self.ids, "id", "left_anti").join(self.paths, "file_path", "left_anti")
        return kept.select(*catalog.columns).unionByName(self.rows.select(*catalog.columns))


def plan_changes(
    catalog: DataFrame,
    files: DataFrame,
    embedder: Embedder,
    now: Column | int,
    force: bool = False,
    folder: str | None = None,
    load: Loader | None = None,
    again: str | None = None,
    by_path: DataFrame | None = None,
    by_id: DataFrame | None = None,
) -> Changes:
    """The effect of scanned files, as if handled one by one in ``seq`` order.

    ``files``: seq, file_path, file_mtime, size_kb, id, and content unless ``load`` fetches
    it for the files to embed; one row per path. Each new content is embedded once, whatever
    number of copies it has. ``by_path`` and ``by_id`` are what the catalogue knows of the paths
    and ids of the batch; with them the catalogue itself is read for vectors of known content
    that moves or is indexed again, and for nothing else. A file whose content is unreadable or cannot be embedded is
    'failed' and changes nothing. The plan and the vectors are staged in ``folder``; the
    result is read from there.
    """
    stamp = now if isinstance(now, Column) else F.lit(now).cast("long")
    listing = files.drop("content")
    plan = stage(plan_scan(listing.where("id is not null"), catalog if by_path is None else by_path, force, again, by_id), "plan", folder)
    fresh = plan.where("outcome = 'indexed'").select("id", "file_path")
    if load is None:
        contents = files.join(fresh, ["id", "file_path"], "left_semi").select("id", "content")
    else:
        contents = load(fresh)
    vectors = stage(embedder(contents), "vectors", folder)
    pictured = "preview_png" in vectors.columns
    drawn = F.col("preview_png").isNotNull() if pictured else F.lit(False)
    good = vectors.where("embedding is not null").select("id", F.col("embedding").alias("_new"), drawn.alias("_drawn"))
    # a content that could not be read any more has no vector either
    bad = fresh.select("id").distinct().join(good, "id", "left_anti").withColumn("_bad", F.lit(True))
    home = (catalog if by_id is None else by_id).select("id", F.col("file_path").alias("_home"))
    # a later copy of content that could not be embedded fails as well, unless the
    # catalogue already knows the content
    judged = (
        left_lookup(plan.join(bad, "id", "left"), home, "id")
        .withColumn(
            "outcome",
            F.when(
                F.col("_bad") & ((F.col("outcome") == "indexed") | ((F.col("outcome") == "moved") & F.col("_home").isNull())),
                F.lit("failed"),
            ).otherwise(F.col("outcome")),
        )
        .drop("_bad", "_home")
    )
    unread = listing.where("id is null").select(
        *listing.columns, F.lit("failed").alias("outcome"), F.lit(False).alias("wins")
    )
    outcomes = judged.unionByName(unread)
    done = judged.where(F.col("outcome").isin("moved", "indexed"))
    winners = done.where("wins").join(good, "id", "left")
    old = catalog.select(
        "id",
        F.col("embedding").alias("_old"),
        F.col("format").alias("_format"),
        F.col("sidecar_embedding").alias("_side"),
        F.col("has_preview").alias("_shown"),
        F.col("indexed_at").alias("_at"),
    )
    if by_id is not None:
        stored = winners.select("id").join(by_id.select("id"), "id", "left_semi")
        if stored.isEmpty():
            old = old.limit(0)
    joined = left_lookup(winners, old, "id")
    fresh_row = F.col("_new").isNotNull()
    rows = joined.select(
        "id",
        "file_path",
        P.basename("file_path").alias("file_name"),
        F.when(fresh_row, F.lit("emb")).otherwise(F.col("_format")).alias("format"),
        "size_kb",
        F.col("file_mtime").cast("long").alias("file_mtime"),
        (F.coalesce("_drawn", F.lit(False)) | F.coalesce("_shown", F.lit(False))).alias("has_preview"),
        F.coalesce("_new", "_old").cast("array<float>").alias("embedding"),
        F.col("_side").alias("sidecar_embedding"),
        F.when(fresh_row, stamp).otherwise(F.col("_at")).alias("indexed_at"),
    )
    media = None
    if pictured:
        small = F.col("thumbnail") if "thumbnail" in vectors.columns else F.lit(None).cast("binary")
        media = vectors.where("embedding is not null and preview_png is not null").select("id", "preview_png", small.alias("thumbnail"))
    return Changes(outcomes, rows, done.select("id").distinct(), done.select("file_path").distinct(), media)


def apply_changes(
    spark: SparkSession, base: str, files: DataFrame, batch_id: int, embedder: Embedder,
    now: Column | int, force: bool = False, deleted: DataFrame | None = None, stream: str = tables.BY_HAND,
    load: Loader | None = None, again: str | None = None, folders_base: str | None = None, marks: bool = False,
) -> DataFrame:
    """Plans one batch against the stored catalogue and writes it as a delta.

    ``deleted`` (file_path) goes last: content that left its path and turns up at another
    one in the same batch is a move and keeps its vector; a path the batch stores again
    stays. Stream and batch id make a repeated delivery harmless. Returns the outcomes, which
    are kept beside the delta.

    With ``folders_base`` the counts and states of the folders around the changed rows follow
    (J2, X7), and with ``marks`` the folders around all files of the batch are Outdated (T7). What
    changes there is stored before the batch is, so a delivery that stopped between the
    two tables is completed when it is repeated.
    """
    if not tables.delivered(spark, base, batch_id, stream):
        with tables.writing(base), staging(spark) as folder:
            # the batch feeds several branches: keep one copy of it
            files = stage(files, "files", folder)
            catalog = tables.read_catalog(spark, base)
            touched = files.select("file_path")
            if deleted is not None:
                deleted = stage(deleted.select("file_path").distinct(), "deleted", folder)
                touched = touched.unionByName(deleted)
            by_path = touched.select(F.col("file_path").alias("key")).distinct()
            by_path = stage(tables.read_known(spark, base, by_path, "path"), "by-path", folder)
            ids = files.select("id").unionByName(by_path.select("id")).select(F.col("id").alias("key")).distinct()
            by_id = stage(tables.read_known(spark, base, ids, "id"), "by-id", folder)
            changes = plan_changes(catalog, files, embedder, now, force, folder, load, again, by_path, by_id)
            paths = changes.paths
            if deleted is not None:
                paths = paths.unionByName(deleted).distinct()
            tables.write_outcomes(changes.outcomes.drop("wins", *([again] if again else [])), base, batch_id, stream)
            if folders_base is not None:
                gone = changes.taken_from(by_id, by_path, deleted)
                counts = count_deltas(gone, changes.rows.select("file_path")).withColumn("outdated", F.lit(False))
                tables.write_counts(counts.unionByName(event_marks(touched)) if marks else counts, base, batch_id, stream)
            if changes.media is not None:
                write_media(changes.media, base)
            tables.write_delta(changes.rows, changes.ids, paths, base, batch_id, stream)
    if folders_base is not None:
        with tables.writing(folders_base):
            if not tables.delivered(spark, folders_base, batch_id, stream):
                counts = tables.read_counts(spark, base, batch_id, stream)
                with staging(spark) as folder:
                    after = stage(changed_folders(tables.read_folders(spark, folders_base), counts, now), "folders", folder)
                    tables.write_folder_delta(after, folders_base, batch_id, stream)
    return tables.read_outcomes(spark, base, batch_id, stream)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gave its query: the same after a restart, another one for a
    fresh checkpoint, whose batches therefore count anew."""
    text = spark.read.text(f"{checkpoint}/metadata").first()[0]
    return json.loads(text)["id"].replace("-", "")


def _compact(spark: SparkSession, base: str, batch_id: int, every: int, folders_base: str | None = None) -> None:
    """Folds the deltas after every ``every``-th batch (0: never)."""
    if every and batch_id % every == every - 1:
        tables.compact(spark, base)
        tables.expire(spark, base)
        fold_media(spark, base)
        if folders_base is not None:
            tables.compact(spark, folders_base, tables.FOLDER_SCHEMA)
            tables.expire(spark, folders_base)


def contents_of(fresh: DataFrame, whole: bool = True) -> DataFrame:
    """Contents of planned files (id, file_path), read on the executors; none for a file
    that has vanished since it was listed, or, where ids are hashes of ``whole`` contents, that
    has been written to since it was hashed."""
    found = load_files(fresh).where("present").select("file_path", F.col("id").alias("_now"), "content")
    same = fresh.join(found, "file_path")
    return (same.where("id = _now") if whole else same).select("id", "content")


def scan_library(
    spark: SparkSession, roots: Sequence[str], base: str, embedder: Embedder, now: Column | int | None = None,
    force: bool = False, batch_id: int | None = None, stream: str = "scan", prefix_bytes: int | None = None,
    folders_base: str | None = None,
) -> DataFrame:
    """S1, J6, F5, J7, T6 in one: brings the catalogue at ``base`` up to what lies below
    ``roots``. Returns the outcome per file.

    Everything is listed, whatever its name, age or size, but for dot and tool directories.
    Only files whose path, mtime or size is not in the catalogue are hashed (with ``force``
    all), over their whole contents unless ``prefix_bytes`` bounds that (files that are equal
    so far are then one), and only contents that the catalogue does not know are embedded. Without
    ``batch_id`` the scan takes the next number of its ``stream``. ``folders_base`` names the folder
    table that follows.
    """
    now = F.unix_timestamp(F.current_timestamp()) if now is None else now
    with tables.writing(base), staging(spark) as folder:
        if batch_id is None:
            batch_id = tables.marks(spark, base).get(stream, -1) + 1
        listed = stage(split_unchanged(walk_files(spark, roots), tables.read_catalog(spark, base)), "listed", folder)
        open_ = listed if force else listed.where(~F.col("unchanged"))
        hashed = stage(fingerprint_files(open_, prefix_bytes=prefix_bytes), "hashed", folder)
        if not force:
            hashed = hashed.unionByName(listed.where("unchanged").withColumn("id", F.col("known_id")))
        order = F.struct(F.col("file_mtime").alias("t"), F.col("file_path").alias("p")).alias("seq")
        files = hashed.select(order, "file_path", "file_mtime", "size_kb", "id", F.lit(None).cast("binary").alias("content"))
        return apply_changes(spark, base, files, batch_id, embedder, now, force, stream=stream, load=lambda fresh: contents_of(fresh, prefix_bytes is None), folders_base=folders_base)


def library_stream(
    spark: SparkSession, roots: Sequence[str], base: str, embedder: Embedder, checkpoint: str,
    every: str = "30 minutes", compact_every: int = 100, on_outcomes: Callable[[DataFrame, int], None] | None = None,
    prefix_bytes: int | None = None, folders_base: str | None = None,
):
    """``scan_library`` again and again, so changed files and files with an old
    mtime are found as well. The checkpoint remembers the scans done. Returns the query."""

    def each(batch: DataFrame, batch_id: int) -> None:
        outcomes = scan_library(spark, roots, base, embedder, batch_id=batch_id, stream=stream_id(spark, checkpoint), prefix_bytes=prefix_bytes, folders_base=folders_base)
        _compact(spark, base, batch_id, compact_every, folders_base)
        if on_outcomes is not None:
            on_outcomes(outcomes, batch_id)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(each).start()


def incoming_files(raw: DataFrame) -> DataFrame:
    """binaryFile rows -> the files frame of plan_changes, in time and path order."""
    path = F.regexp_replace("path", r"^file:/+", "/")
    return raw.where(P.is_supported("path")).select(
        F.struct(F.col("modificationTime").alias("t"), path.alias("p")).alias("seq"),
        path.alias("file_path"),
        F.unix_timestamp("modificationTime").alias("file_mtime"),
        S.size_kb("length").alias("size_kb"),
        S.content_id("length", "content", prefix_bytes=None).alias("id"),
        "content",
    )


def ingest_stream(
    spark: SparkSession,
    source: str,
    base: str,
    embedder: Embedder,
    checkpoint: str,
    max_files: int = 10_000,
    first_batch: int = 0,
    on_outcomes: Callable[[DataFrame, int], None] | None = None,
    compact_every: int = 100,
):
    """Picks up new files below ``source``, of any age, and stops when none is left. For
    drop folders whose files are written once; ``scan_library`` and ``library_stream`` find
    changed, empty and underscored files too, which Spark's file source leaves out.

    The streaming checkpoint remembers the files done, so a restart goes on where the
    last run stopped even if single files have vanished. Returns the started query.
    """
    raw = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[eE][mM][bB]")
        .option("maxFilesPerTrigger", max_files)
        # files may be far older than the newest one
        .option("maxFileAge", "36500d")
        .load(source)
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        now = F.unix_timestamp(F.current_timestamp())
        files = incoming_files(batch).where(~P.hidden_or_tool_dir("file_path", F.lit(source.rstrip("/"))))
        name = stream_id(spark, checkpoint)
        outcomes = apply_changes(spark, base, files, first_batch + batch_id, embedder, now, stream=name)
        _compact(spark, base, batch_id, compact_every)
        if on_outcomes is not None:
            on_outcomes(outcomes, batch_id)

    return (
        raw.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )


def apply_events(
    spark: SparkSession, base: str, events: DataFrame, batch_id: int, embedder: Embedder, now: Column | int,
    stream: str = tables.BY_HAND, folders_base: str | None = None,
) -> DataFrame:
    """T3-T7 for one batch of settled events (path, op, last_ts): items are looked at again
    if their file is there and deleted if it is not; a companion's event counts for the
    item it belongs to, which is then indexed again. An item whose listing and content are the
    known ones is skipped: a file that was renamed and came back keeps its row and vector.
    The folders around them in ``folders_base`` are Outdated. Returns the outcomes.
    """
    actions = EV.classify_events(events)
    stems = actions.where("action = 'reindex_owner'").select(stem_key("path").alias("key")).distinct()
    items = tables.read_known(spark, base, stems, "stem").select("file_path")
    targets = (
        EV.to_owner(actions, items)
        .groupBy(F.col("target").alias("file_path"))
        .agg(F.max("last_ts").alias("_ts"), F.max(F.col("action") == "reindex_owner").alias("again"))
    )
    with staging(spark) as folder:
        targets = stage(targets, "targets", folder)
        seen = stage(load_files(targets), "seen", folder)
        order = F.struct(F.col("file_mtime").alias("t"), F.col("file_path").alias("p")).alias("seq")
        files = seen.where("present").join(targets.select("file_path", "again"), "file_path").select(
            order, "file_path", "file_mtime", S.size_kb("size_bytes").alias("size_kb"), "id", "content", "again"
        )
        gone = seen.where("not present").select("file_path")
        return apply_changes(spark, base, files, batch_id, embedder, now, deleted=gone, stream=stream, again="again", folders_base=folders_base, marks=True)


def watch_stream(
    spark: SparkSession,
    events: DataFrame,
    base: str,
    embedder: Embedder,
    checkpoint: str,
    gap: str = EV.DEBOUNCE,
    grace: str = EV.RENAME_GRACE,
    first_batch: int = 0,
    compact_every: int = 100,
    settle: str = "arrival",
    delay: str = EV.DELAY,
    folders_base: str | None = None,
    **trigger,
):
    """File changes as a stream: filter, debounce, apply. Returns the started query.

    ``settle='arrival'``: a burst is applied once nothing more of its path has arrived for
    ``gap``, over as many triggers as that takes; after a rename for ``grace``, so a file that
    comes back, or turns up elsewhere, keeps its row. No event waits for a later one and none is
    too late. Such a query runs until it is stopped.

    For runs that end (``availableNow``): ``settle='trigger'`` debounces and applies what has
    arrived by a trigger, with no waiting; with ``settle='event'`` a burst is applied once the
    watermark (``delay`` behind the newest event) has passed it, and events behind it are dropped.
    """
    if settle not in ("arrival", "trigger", "event"):
        raise ValueError(f"settle by {settle!r}")
    if settle == "arrival" and (trigger.get("availableNow") or trigger.get("once")):
        raise ValueError("a run that ends cannot wait: settle by 'trigger' or 'event'")

    def each(batch: DataFrame, batch_id: int) -> None:
        now = F.unix_timestamp(F.current_timestamp())
        # the state's timers are evaluated once, whatever is done with their rows
        batch = batch.persist()
        try:
            if batch.count():
                settled = EV.debounce(batch, gap) if settle == "trigger" else batch
                apply_events(spark, base, settled, first_batch + batch_id, embedder, now, stream_id(spark, checkpoint), folders_base)
        finally:
            batch.unpersist()
        _compact(spark, base, batch_id, compact_every, folders_base)

    settled = EV.relevant_events(events)
    if settle == "arrival":
        settled = EV.debounce_stream(settled, gap, grace)
    elif settle == "event":
        settled = EV.debounce_by_watermark(settled, gap, delay)
    return (
        settled.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .foreachBatch(each)
        .start()
    )


def outdated_batch(
    spark: SparkSession, folders_base: str, events: DataFrame, batch_id: int, stream: str = tables.BY_HAND
) -> None:
    """foreachBatch body that marks the folders around a batch of events, where no catalogue
    is kept by the same stream."""
    with tables.writing(folders_base), staging(spark) as folder:
        if tables.delivered(spark, folders_base, batch_id, stream):
            return
        marked = changed_folders(tables.read_folders(spark, folders_base), event_marks(events, "path"))
        tables.write_folder_delta(stage(marked, "folders", folder), folders_base, batch_id, stream)
