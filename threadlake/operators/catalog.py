"""Catalogue reads (P3, P6-P8, P11, O1-O3), counts (A1-A3, A18) and scan planning
(J6, J7, A19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import paths as P
from threadlake.operators.containment import count_under
from threadlake.operators.joins import left_lookup

# Page sizes.
PAGE_SIZE, MAX_PAGE_SIZE, LATEST = 48, 200, 50

RESULT_COLUMNS = ("id", "file_path", "file_name", "format", "size_kb")


# -- reads -----------------------------------------------------------------


def lookup(
    catalog: DataFrame, ids: DataFrame | None = None, paths: DataFrame | None = None
) -> DataFrame:
    """Rows with one of the wanted ids and/or paths (semi joins)."""
    out = catalog
    if ids is not None:
        out = out.join(ids.select("id"), "id", "left_semi")
    if paths is not None:
        out = out.join(paths.select("file_path"), "file_path", "left_semi")
    return out


def path_facts(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """For each wanted path (``path``, each once) whether an item has it, and how many items
    lie below it: path, present, below."""
    known = catalog.select(F.col("file_path").alias("path")).join(paths.select("path"), "path", "left_semi").distinct()
    below = count_under(catalog, paths.select("path"), out="below")
    return below.join(known.withColumn("_is", F.lit(True)), "path", "left").select(
        "path", F.coalesce("_is", F.lit(False)).alias("present"), "below"
    )


def thumbnail(media: DataFrame) -> DataFrame:
    """Stored thumbnail, else the preview."""
    return media.select("id", F.coalesce("thumbnail", "preview_png").alias("thumbnail"))


def name_contains(
    df: DataFrame, text: str, col: str = "file_name", wildcards: bool = True
) -> DataFrame:
    """Case-insensitive "contains". With ``wildcards`` '%' and '_' in the text
    match any run and any one character; otherwise they are plain characters.
    Case folding covers all letters, not ASCII alone."""
    if wildcards:
        return df.where(F.col(col).ilike(f"%{text}%"))
    return df.where(F.lower(col).contains(text.lower()))


def filter_results(df: DataFrame, regex: str = r"\.emb$", col: str = "file_name") -> DataFrame:
    """Case-insensitive regex on the file name."""
    return df.where(F.coalesce(F.col(col), F.lit("")).rlike(f"(?i){regex}"))


def latest(catalog: DataFrame, n: int = LATEST, fmt: str = "emb") -> DataFrame:
    """O1: most recently indexed items. ``has_preview`` is reported true unchecked."""
    return (
        catalog.where(F.col("format") == fmt)
        .orderBy(F.desc("indexed_at"), F.asc("id"))
        .limit(n)
        .select(*RESULT_COLUMNS, F.lit(True).alias("has_preview"))
    )


def page_bounds(page: int | None, page_size: int | None) -> tuple[int, int]:
    """Valid page and page size; anything out of range falls back to the default."""
    page = page if page and page > 0 else 1
    size = page_size if page_size and 0 < page_size <= MAX_PAGE_SIZE else PAGE_SIZE
    return page, size


def _browsed(catalog: DataFrame, q: str | None, fmt: str) -> tuple[DataFrame, bool]:
    rows = catalog.where(F.col("format") == fmt)
    text = (q or "").strip()
    return (name_contains(rows, text), True) if text else (rows, False)


def browse(
    catalog: DataFrame,
    q: str | None = None,
    page: int | None = 1,
    page_size: int | None = PAGE_SIZE,
    fmt: str = "emb",
) -> DataFrame:
    """O2: one page, by name when filtered, else newest first; ties by id."""
    page, size = page_bounds(page, page_size)
    rows, filtered = _browsed(catalog, q, fmt)
    order = [F.asc("file_name")] if filtered else [F.desc("indexed_at")]
    return (
        rows.orderBy(*order, F.asc("id"))
        .offset((page - 1) * size)
        .limit(size)
        .select(*RESULT_COLUMNS, "has_preview")
    )


def browse_meta(
    catalog: DataFrame,
    q: str | None = None,
    page: int | None = 1,
    page_size: int | None = PAGE_SIZE,
    fmt: str = "emb",
) -> DataFrame:
    """O3: total, page, page_size, pages."""
    page, size = page_bounds(page, page_size)
    rows, _ = _browsed(catalog, q, fmt)
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).cast("long").alias("page"),
        F.lit(size).cast("long").alias("page_size"),
        F.ceil(F.col("total") / size).cast("long").alias("pages"),
    )


# -- counts ----------------------------------------------------------------


def format_counts(catalog: DataFrame) -> DataFrame:
    """A1."""
    return catalog.groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def format_count_map(catalog: DataFrame) -> DataFrame:
    """A1 as one map, format -> count (formats are few)."""
    return format_counts(catalog).agg(
        F.map_from_entries(F.collect_list(F.struct("format", "n"))).alias("counts")
    )


def library_totals(catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """A2: items indexed and files expected over all folders."""
    items = catalog.select(F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("t"))
    files = folders.select(F.lit(0).cast("long").alias("i"), F.col("total_files").cast("long").alias("t"))
    return items.unionAll(files).agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("global_indexed"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("global_total"),
    )


def discover(files: DataFrame, path: str = "file_path") -> DataFrame:
    """A3: supported files per directory. The discovery test is a plain suffix test and
    does not skip hidden directories."""
    found = files.where(F.lower(path).endswith(".emb"))
    return found.groupBy(P.dirname(path).alias("path")).agg(F.count(F.lit(1)).alias("total_files"))


def discover_total(files: DataFrame, path: str = "file_path") -> DataFrame:
    return discover(files, path).agg(
        F.coalesce(F.sum("total_files"), F.lit(0)).alias("designs"),
        F.count(F.lit(1)).alias("folders"),
    )


def duplicate_paths(catalog: DataFrame, path: str = "file_path") -> DataFrame:
    """Paths with more than one row."""
    return catalog.groupBy(path).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# -- scan planning ---------------------------------------------------------


def split_unchanged(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files with ``unchanged`` and the id known for the path.

    A file is unchanged when path, mtime and size match a catalogue row. Paths are
    unique on both sides, so one lookup yields the skipped and the open files.
    """
    known = catalog.select(
        "file_path",
        F.col("file_mtime").alias("_mtime"),
        F.col("size_kb").alias("_kb"),
        F.col("id").alias("known_id"),
    )
    same = (F.col("_mtime") == F.col("file_mtime")) & (F.col("_kb") == F.col("size_kb"))
    return (
        left_lookup(files, known, "file_path")
        .withColumn("unchanged", F.coalesce(same, F.lit(False)))
        .drop("_mtime", "_kb")
    )


def detect_moves(files: DataFrame, catalog: DataFrame, order: str = "seq") -> DataFrame:
    """Known content at another path; of several copies the last one wins.

    Copies are reduced to one row per id before the join, so content that fills a
    third of the files does not make a hot key.
    """
    # an aggregate with map-side reduction, see keep_latest
    rest = [c for c in files.columns if c != "id"]
    last = files.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_r"))
    last = last.select("id", *[F.col(f"_r.{c}").alias(c) for c in rest])
    old = catalog.select("id", F.col("file_path").alias("old_path"))
    return last.join(old, "id").where(F.col("file_path") != F.col("old_path"))


def plan_scan(files: DataFrame, catalog: DataFrame, force: bool = False, again: str | None = None, by_id: DataFrame | None = None) -> DataFrame:
    """Outcome of each scanned file, as if files were handled one by one in ``seq`` order.

    ``files`` (seq, file_path, file_mtime, size_kb, id) has one row per path; ``id`` may
    be null where the caller left the hash of an unchanged file out. Adds ``outcome``
    in skipped / moved / indexed, and ``wins``: the row that ends up in the catalogue,
    i.e. the last operation on its id that no later operation on its path replaced.

    With ``again``, a boolean column of ``files``, ids are those of contents read just now: a
    file is unchanged only if its id is the known one as well, and is not asked for again.

    ``by_id``: catalogue rows of the ids that the files have or replace, where ``catalog`` has
    those of their paths alone.

    Rules: an unchanged file is skipped unless an earlier file of this scan has taken
    its content away; an operation is a move if its content is known at another path
    at that moment; otherwise it is indexed.

    Paths are unique within a scan, so per content id it is enough to know the first and
    the last operation, the one unchanged file, and when another content replaced it at
    its stored path. One aggregate gives all of them; no files of one id meet each other.
    """
    flagged = split_unchanged(files, catalog)
    skip = F.lit(False) if force else F.col("unchanged")
    if again is not None:
        skip = skip & F.coalesce(F.col("id") == F.col("known_id"), F.lit(False)) & ~F.col(again)
    flagged = flagged.withColumn("_skip", skip).withColumn(
        "id", F.when(F.col("_skip"), F.col("known_id")).otherwise(F.col("id"))
    )
    act = F.when(~F.col("_skip"), F.col("seq"))
    home_is_own = F.col("known_id") == F.col("id")
    empty = F.lit(None).cast(files.schema["seq"].dataType)
    # a file speaks for its own content and, if it replaced another one, for that as well
    own = F.struct(
        "id",
        act.alias("act"),
        F.when(F.col("_skip"), F.col("seq")).alias("still"),
        F.when(home_is_own, act).alias("home"),
        empty.alias("over"),
    )
    replaced = F.struct(
        F.col("known_id").alias("id"), empty.alias("act"), empty.alias("still"), empty.alias("home"), act.alias("over")
    )
    voices = F.when(act.isNotNull() & ~home_is_own, F.array(own, replaced)).otherwise(F.array(own))
    per_id = (
        flagged.select(F.explode(voices).alias("v"))
        .groupBy(F.col("v.id").alias("id"))
        .agg(
            F.min("v.act").alias("_first"),
            F.max("v.act").alias("_last_act"),
            F.max("v.still").alias("_still"),
            F.min("v.home").alias("_at_home"),
            F.min("v.over").alias("_over"),
        )
        .where("_first is not null")
    )
    known = (catalog if by_id is None else by_id).select("id", F.lit(True).alias("_known"))
    first_at_home = F.coalesce(F.col("_at_home") == F.col("_first"), F.lit(False))
    replaced_before = F.coalesce(F.col("_over") < F.col("_first"), F.lit(False))
    start = left_lookup(per_id, known, "id").select(
        "id",
        "_first",
        # an unchanged file after the first operation is an operation itself
        F.when(F.col("_still") > F.col("_first"), F.greatest("_last_act", "_still"))
        .otherwise(F.col("_last_act"))
        .alias("_last"),
        (F.coalesce("_known", F.lit(False)) & ~first_at_home & ~replaced_before).alias("_moved_first"),
    )
    skipped = F.col("_skip") & (F.col("_first").isNull() | (F.col("_first") > F.col("seq")))
    moved = (F.col("seq") > F.col("_first")) | F.col("_moved_first")
    return flagged.join(start, "id", "left").select(
        *[F.col(c) for c in files.columns],
        F.when(skipped, F.lit("skipped"))
        .when(moved, F.lit("moved"))
        .otherwise(F.lit("indexed"))
        .alias("outcome"),
        (~skipped & (F.col("seq") == F.col("_last"))).alias("wins"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """A19."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
