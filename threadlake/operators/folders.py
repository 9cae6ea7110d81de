"""Folder roll-ups and the folder status machine (J2, J13, A4, A12, A13, X6-X9, X11,
X12, X14, O5, P9, P10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import paths as P
from threadlake.functions import scalars as S
from threadlake.operators.containment import count_under
from threadlake.operators.dml import dedupe_paths
from threadlake.operators.ordered import keep_latest

# File systems and mount prefixes that hold no user files.
SKIPPED_FS = (
    "nsfs", "fuse.portal", "fuse.gvfsd-fuse", "fuse.snapfuse", "squashfs",
    "iso9660", "tmpfs", "devtmpfs", "sysfs", "proc",
)
SKIPPED_PREFIXES = ("/run/snapd", "/run/user", "/snap", "/proc", "/sys", "/dev")


def _epoch(now: Column | int | None) -> Column:
    if now is None:
        return F.unix_timestamp(F.current_timestamp()).cast("long")
    return now if isinstance(now, Column) else F.lit(now).cast("long")


def _set(folders: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Applies the changes to the columns the table has."""
    return folders.select(
        *[changes[c].alias(c) if c in changes else F.col(c) for c in folders.columns]
    )


# -- counts ----------------------------------------------------------------


def recount_folders(folders: DataFrame, catalog: DataFrame, now: Column | int | None = None) -> DataFrame:
    """indexed_files of every folder = catalogue rows strictly below it."""
    counted = count_under(catalog, folders, out="_n")
    changes = {"indexed_files": F.col("_n").cast(folders.schema["indexed_files"].dataType)}
    if "updated_at" in folders.columns:
        changes["updated_at"] = _epoch(now)
    return counted.select(
        *[changes[c].alias(c) if c in changes else F.col(c) for c in folders.columns]
    )


def refresh_containing(
    folders: DataFrame, catalog: DataFrame, files: DataFrame, now: Column | int | None = None
) -> DataFrame:
    """Recount only folders that contain one of ``files``; here a row at the folder's
    own path counts too."""
    hit = _containing(files)
    counted = count_under(catalog, folders.join(hit, "path", "left_semi"), include_self=True, out="_n")
    flagged = folders.join(counted.select("path", "_n"), "path", "left")
    changes = {"indexed_files": F.coalesce("_n", "indexed_files").cast(folders.schema["indexed_files"].dataType)}
    if "updated_at" in folders.columns:
        changes["updated_at"] = F.when(F.col("_n").isNotNull(), _epoch(now)).otherwise(F.col("updated_at"))
    return flagged.select(
        *[changes[c].alias(c) if c in changes else F.col(c) for c in folders.columns]
    )


def count_deltas(gone: DataFrame, added: DataFrame, path: str = "file_path") -> DataFrame:
    """J2 kept up with a batch: by how much the rows that went and the rows that came change the
    count of each folder above them (path, delta). Costs what the batch costs: signs are
    summed per directory before its ancestors are spelled out."""
    signed = gone.select(P.dirname(path).alias("dir"), F.lit(-1).cast("long").alias("delta")).unionAll(
        added.select(P.dirname(path), F.lit(1).cast("long"))
    )
    per_dir = signed.groupBy("dir").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    above = per_dir.select(F.explode(P.ancestors("dir", include_self=True)).alias("path"), "delta")
    return above.groupBy("path").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def changed_folders(folders: DataFrame, deltas: DataFrame, now: Column | int | None = None) -> DataFrame:
    """The rows of ``folders`` that a batch changes, as they are after it.

    ``deltas``: path, delta, and outdated where an event marks the folder. A marked folder is
    Outdated; a full one in a waiting state becomes Completed.
    """
    hit = deltas.groupBy("path").agg(F.sum("delta").alias("_delta"), F.coalesce(F.max("outdated"), F.lit(False)).alias("_old"))
    joined = folders.join(hit, "path")
    count = F.greatest(F.lit(0), F.col("indexed_files") + F.col("_delta")).cast(folders.schema["indexed_files"].dataType)
    changes = {
        "indexed_files": count,
        "status": F.when(F.col("_old"), F.lit(S.OUTDATED)).otherwise(F.col("status")),
        "needs_rescan": F.col("_old") | F.col("needs_rescan"),
    }
    if "updated_at" in folders.columns:
        changes["updated_at"] = _epoch(now)
    after = joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in folders.columns])
    return fix_completed(after, now)


def event_marks(files: DataFrame, path: str = "file_path") -> DataFrame:
    """T7 as deltas: the folders that are or contain one of the files, marked (path, delta, outdated)."""
    return _containing(files, path).select("path", F.lit(0).cast("long").alias("delta"), F.lit(True).alias("outdated"))


def _containing(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Paths of the folders that are one of the files' paths or lie above one."""
    dirs = files.select(P.dirname(path).alias("d")).distinct()
    above = dirs.select(F.explode(P.ancestors("d", include_self=True)).alias("path"))
    return above.unionAll(files.select(F.col(path).alias("path"))).distinct()


def root_overview(roots: DataFrame, catalog: DataFrame, selected: DataFrame) -> DataFrame:
    """A4: per root its item count and the usable / selected flags."""
    counted = count_under(catalog, roots, out="indexed")
    chosen = selected.select("path").distinct().withColumn("_sel", F.lit(True))
    return counted.join(chosen, "path", "left").select(
        "path",
        P.root_label("path").alias("label"),
        "fs_type",
        usable("path", "fs_type").alias("usable"),
        "indexed",
        F.coalesce("_sel", F.lit(False)).alias("selected"),
    )


def folder_summary(folders: DataFrame) -> DataFrame:
    """A12."""
    done = (F.col("status") == S.COMPLETED) | (F.col("indexed_files") > 0)
    return folders.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(done).alias("indexed")
    )


# -- roots -----------------------------------------------------------------


def usable(path: str = "path", fs_type: str = "fs_type") -> Column:
    """Real storage, not the system root, no virtual file system or mount."""
    virtual = F.lit(False)
    for prefix in SKIPPED_PREFIXES:
        virtual = virtual | F.col(path).startswith(prefix)
    fs = F.coalesce(F.col(fs_type), F.lit(""))
    return (F.col(path) != "/") & ~fs.isin(*SKIPPED_FS) & ~virtual


def usable_roots(roots: DataFrame) -> DataFrame:
    return roots.where(usable())


def set_roots(paths: DataFrame) -> DataFrame:
    """Replace the selection; blank entries and repeats are dropped."""
    return (
        paths.select(F.trim("path").alias("path")).where("path <> ''").distinct()
    )


def add_root(selected: DataFrame, path: str) -> DataFrame:
    """Add one root unless it is blank or already selected."""
    one = selected.sparkSession.range(1).select(F.trim(F.lit(path)).alias("path"))
    return selected.select("path").unionAll(one.where("path <> ''")).distinct()


def request_paths(requested: DataFrame, default: DataFrame, pos: str = "pos") -> DataFrame:
    """Requested paths trimmed, blanks and repeats dropped, first position kept;
    the default set when nothing valid was requested. Columns path, pos."""
    def clean(df: DataFrame) -> DataFrame:
        named = df.select(F.trim("path").alias("path"), pos).where("path <> ''")
        return named.groupBy("path").agg(F.min(pos).alias(pos))

    asked = clean(requested)
    # an uncorrelated EXISTS: evaluated once, the default branch is then kept or dropped
    fallback = clean(default).where(~asked.exists())
    return asked.unionByName(fallback)


# -- state machine ---------------------------------------------------------


def upsert_folders(
    folders: DataFrame, batch: DataFrame, now: Column | int | None = None, order: str | None = None
) -> DataFrame:
    """Insert or replace folder rows by path.

    A total of 0 keeps the stored total. Scouting... and Pending never replace another
    stored status (letter case ignored); everything else is taken from the batch.
    """
    if order is not None:
        batch = keep_latest(batch, "path", [order])
    provisional = [S.SCOUTING.lower(), S.PENDING.lower()]
    cols = [c for c in folders.columns if c != "path"]
    old = folders.select("path", *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("o_has"))
    new = batch.select("path", *[F.col(c).alias(f"n_{c}") for c in cols if c in batch.columns], F.lit(True).alias("n_has"))
    both = old.join(new, "path", "full_outer")
    settled = (F.coalesce("o_status", F.lit("")) != "") & ~F.lower("o_status").isin(*provisional)
    merged = {
        "total_files": F.when(
            F.col("n_total_files") == 0, F.coalesce("o_total_files", F.lit(0))
        ).otherwise(F.col("n_total_files")),
        "status": F.when(
            settled & F.lower("n_status").isin(*provisional), F.col("o_status")
        ).otherwise(F.col("n_status")),
        "updated_at": _epoch(now),
    }
    out = [F.col("path")]
    for c in cols:
        if c in merged:
            value = merged[c]
        elif c in batch.columns:
            value = F.col(f"n_{c}")
        else:
            value = F.col(f"o_{c}")
        kind = folders.schema[c].dataType
        out.append(F.when(F.col("n_has"), value).otherwise(F.col(f"o_{c}")).cast(kind).alias(c))
    return both.select(*out).select(*folders.columns)


def fix_completed(folders: DataFrame, now: Column | int | None = None) -> DataFrame:
    """Fully indexed folders in a waiting state become Completed; Outdated stays."""
    full = (
        (F.col("total_files") > 0)
        & (F.col("indexed_files") >= F.col("total_files"))
        & F.col("status").isin(S.PENDING, S.STOPPED, S.SCOUTING, S.ERROR)
    )
    return _set(
        folders,
        {
            "status": F.when(full, F.lit(S.COMPLETED)).otherwise(F.col("status")),
            "needs_rescan": F.when(full, F.lit(False)).otherwise(F.col("needs_rescan")),
            "updated_at": F.when(full, _epoch(now)).otherwise(F.col("updated_at") if "updated_at" in folders.columns else F.lit(None)),
        },
    )


def reset_stuck(folders: DataFrame, now: Column | int | None = None) -> DataFrame:
    """In Progress -> Stopped, to be rescanned."""
    stuck = F.col("status") == S.IN_PROGRESS
    return _set(
        folders,
        {
            "status": F.when(stuck, F.lit(S.STOPPED)).otherwise(F.col("status")),
            "needs_rescan": F.when(stuck, F.lit(True)).otherwise(F.col("needs_rescan")),
            "updated_at": F.when(stuck, _epoch(now)).otherwise(F.col("updated_at") if "updated_at" in folders.columns else F.lit(None)),
        },
    )


def set_status(
    folders: DataFrame, paths: DataFrame, status: str, now: Column | int | None = None
) -> DataFrame:
    """Set the status of the named folders."""
    named = paths.select("path").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    joined = folders.join(named, "path", "left")
    changes = {"status": F.when(hit, F.lit(status)).otherwise(F.col("status"))}
    if "updated_at" in folders.columns:
        changes["updated_at"] = F.when(hit, _epoch(now)).otherwise(F.col("updated_at"))
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in folders.columns])


def stop_all(folders: DataFrame, now: Column | int | None = None) -> DataFrame:
    """In Progress -> Stopped, rescan flag untouched."""
    active = F.col("status") == S.IN_PROGRESS
    return _set(
        folders,
        {
            "status": F.when(active, F.lit(S.STOPPED)).otherwise(F.col("status")),
            "updated_at": F.when(active, _epoch(now)).otherwise(F.col("updated_at") if "updated_at" in folders.columns else F.lit(None)),
        },
    )


def mark_outdated(folders: DataFrame, events: DataFrame, path: str = "path") -> DataFrame:
    """Folders containing (or being) an event's path become Outdated."""
    hit = _containing(events.select(F.col(path).alias("file_path"))).withColumn("_hit", F.lit(True))
    joined = folders.join(hit, "path", "left")
    outdated = F.col("_hit").isNotNull()
    changes = {
        "status": F.when(outdated, F.lit(S.OUTDATED)).otherwise(F.col("status")),
        "needs_rescan": outdated | F.col("needs_rescan"),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in folders.columns])


def cleanup(
    catalog: DataFrame, folders: DataFrame, strict: bool = True, now: Column | int | None = None
) -> tuple[DataFrame, DataFrame]:
    """X11: reset stuck folders, deduplicate, recount, complete. Returns (catalog, folders)."""
    clean = dedupe_paths(catalog, strict)
    counted = recount_folders(reset_stuck(folders, now), clean, now)
    return clean, fix_completed(counted, now)


def repair_report(catalog: DataFrame, strict: bool = True) -> DataFrame:
    """Rows before, after and removed. One pass: the rows that stay per path follow
    from the path's counts, so nothing is deduplicated twice."""
    per_path = catalog.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_preview").alias("shown")
    )
    stays = F.lit(True) if not strict else (F.col("n") == 1) | (F.col("shown") > 0)
    return per_path.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count_if(stays).alias("after")
    ).select("before", "after", (F.col("before") - F.col("after")).alias("removed"))


def pending_folders(folders: DataFrame) -> DataFrame:
    """P10."""
    return folders.where(~F.col("status").isin(S.COMPLETED, S.IN_PROGRESS))


def order_folders(folders: DataFrame) -> DataFrame:
    """Scanning first, then outdated, completed last, then by name."""
    scanning = F.col("status") == S.IN_PROGRESS
    outdated = F.col("needs_rescan") | (
        (F.col("indexed_files") < F.col("total_files")) & ~scanning
    )
    completed = F.col("status") == S.COMPLETED
    return folders.orderBy(
        F.when(scanning, 0).otherwise(1),
        F.when(outdated, 0).otherwise(1),
        F.when(completed, 1).otherwise(0),
        F.asc("name"),
        F.asc("path"),
    )
