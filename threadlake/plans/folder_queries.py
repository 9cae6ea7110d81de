"""Folder roll-ups and states: J2, J13, A4, A12, A13, X6-X9, X11, X12, X14, O5, P9, P10, F13, S13, T7."""

from pyspark.sql import functions as F

from threadlake.functions import scalars as S
from threadlake.operators import folders as FO

from .registry import query
from .views import Views


@query("j2_recount_folders", ("catalog", "folders"), """
    select f.path, f.status, count(c.file_path) as indexed_files, 7::bigint as updated_at
    from folders f left join catalog c on starts_with(c.file_path, f.path || '/') group by all""")
def j2(v: Views):
    counted = FO.recount_folders(v.folders(), v.catalog(), now=7)
    return counted.select("path", "status", "indexed_files", "updated_at")


@query("j2_refresh_containing", ("catalog", "folders", "stored"), """
    with h as (select distinct f.path from folders f join stored s
               on (starts_with(s.file_path, f.path || '/') or s.file_path = f.path) where not s.has_preview),
    n as (select h.path, count(c.file_path) as n from h left join catalog c on starts_with(c.file_path, h.path || '/') or c.file_path = h.path group by all)
    select f.path, coalesce(n.n, f.indexed_files) as indexed_files, case when n.n is null then f.updated_at else 7 end as updated_at
    from folders f left join n using (path)""")
def j2_refresh(v: Views):
    changed = v.stored().where("not has_preview")
    out = FO.refresh_containing(v.folders(), v.catalog(), changed, now=7)
    return out.select("path", "indexed_files", "updated_at")


@query("j13_mark_outdated", ("ev", "folders"), """
    with e as (select distinct '/src' || (user_id % 7)::varchar || '/en/x.emb' as path from ev)
    select f.path, case when count(e.path) > 0 then 'Outdated' else f.status end as status,
           f.needs_rescan or count(e.path) > 0 as needs_rescan
    from folders f left join e on starts_with(e.path, f.path || '/') or e.path = f.path
    group by f.path, f.status, f.needs_rescan""")
def j13(v: Views):
    path = F.concat(F.lit("/src"), (F.col("user_id") % 7).cast("string"), F.lit("/en/x.emb"))
    marked = FO.mark_outdated(v.folders(), v.events().select(path.alias("path")))
    return marked.select("path", "status", "needs_rescan")


@query("a4_root_overview", ("catalog", "roots", "folders"), """
    with n as (select r.path, count(c.file_path) as n from roots r left join catalog c on starts_with(c.file_path, r.path || '/') group by all)
    select r.path, r.path as label, r.fs_type, r.fs_type not in ('tmpfs', 'squashfs') as usable, n.n as indexed,
           r.path in (select path from folders where status = 'Completed') as selected
    from roots r join n using (path)""")
def a4(v: Views):
    return FO.root_overview(v.roots(), v.catalog(), v.folders().where("status = 'Completed'"))


@query("a12_folder_summary", ("folders",), """
    select count(*) as discovered, count(*) filter (status = 'Completed' or indexed_files > 0) as indexed from folders""")
def a12(v: Views):
    return FO.folder_summary(v.folders())


@query("a13_repair_report", ("duplicated",), """
    with c as (select file_path, count(*) as n, count(*) filter (has_preview) as shown from duplicated group by file_path),
    r as (select sum(n)::bigint as before, count(*) filter (n = 1 or shown > 0) as after from c)
    select before, after, before - after as removed from r""")
def a13(v: Views):
    return FO.repair_report(v.duplicated())


@query("p9_usable_roots", ("mounts",), """
    select path, fs_type from mounts
    where path <> '/' and fs_type not in ('tmpfs', 'squashfs') and not starts_with(path, '/dev') and not starts_with(path, '/snap')""")
def p9(v: Views):
    return FO.usable_roots(v.mounts())


@query("p10_pending_folders", ("folders",), """
    select path, status from folders where status not in ('Completed', 'In Progress')""")
def p10(v: Views):
    return FO.pending_folders(v.folders()).select("path", "status")


@query("o5_folder_order", ("folders",), """
    select path, name, status from folders
    order by status <> 'In Progress', not (needs_rescan or (indexed_files < total_files and status <> 'In Progress')),
             status = 'Completed', name, path""")
def o5(v: Views):
    return FO.order_folders(v.folders()).select("path", "name", "status")


@query("x6_upsert_folders", ("folders", "incoming_folders"), """
    select coalesce(o.path, n.path) as path,
           case when n.path is null then o.total_files when n.total_files = 0 then coalesce(o.total_files, 0) else n.total_files end as total_files,
           case when n.path is null then o.indexed_files else n.indexed_files end as indexed_files,
           case when n.path is null then o.status
                when coalesce(o.status, '') <> '' and lower(o.status) not in ('scouting...', 'pending')
                     and lower(n.status) in ('scouting...', 'pending') then o.status
                else n.status end as status,
           case when n.path is null then o.needs_rescan else n.needs_rescan end as needs_rescan,
           case when n.path is null then o.updated_at else 7 end as updated_at
    from folders o full join incoming_folders n on o.path = n.path""")
def x6(v: Views):
    out = FO.upsert_folders(v.folders(), v.incoming_folders(), now=7)
    return out.select("path", "total_files", "indexed_files", "status", "needs_rescan", "updated_at")


_FULL = "total_files > 0 and indexed_files >= total_files and status in ('Pending', 'Stopped', 'Scouting...', 'Error')"


@query("x7_fix_completed", ("folders",), f"""
    select path, case when {_FULL} then 'Completed' else status end as status,
           case when {_FULL} then false else needs_rescan end as needs_rescan,
           case when {_FULL} then 7 else updated_at end as updated_at
    from folders""")
def x7(v: Views):
    return FO.fix_completed(v.folders(), now=7).select("path", "status", "needs_rescan", "updated_at")


@query("x8_reset_stuck", ("folders",), """
    select path, case when status = 'In Progress' then 'Stopped' else status end as status,
           needs_rescan or status = 'In Progress' as needs_rescan
    from folders""")
def x8(v: Views):
    return FO.reset_stuck(v.folders()).select("path", "status", "needs_rescan")


@query("x9_set_status", ("folders", "roots"), """
    select path, case when path in (select path from roots where fs_type = 'tmpfs') then 'Error'
                      when status = 'In Progress' then 'Stopped' else status end as status, needs_rescan
    from folders""")
def x9(v: Views):
    named = FO.set_status(v.folders(), v.roots().where("fs_type = 'tmpfs'"), S.ERROR)
    return FO.stop_all(named).select("path", "status", "needs_rescan")


_CLEAN = """
    with c as (select *, count(*) over (partition by file_path) as n from duplicated),
    d as (select * from c where n = 1 or has_preview qualify row_number() over (partition by file_path order by rowid desc) = 1),
    f as (select f.path, f.total_files, case when f.status = 'In Progress' then 'Stopped' else f.status end as status,
                 f.needs_rescan or f.status = 'In Progress' as needs_rescan, count(d.file_path) as indexed_files
          from folders f left join d on starts_with(d.file_path, f.path || '/') group by f.path, f.total_files, f.status, f.needs_rescan)"""


@query("x11_cleanup_folders", ("duplicated", "folders"), _CLEAN + f"""
    select path, indexed_files, case when {_FULL} then 'Completed' else status end as status,
           case when {_FULL} then false else needs_rescan end as needs_rescan
    from f""")
def x11(v: Views):
    _, folders = FO.cleanup(v.duplicated(), v.folders())
    return folders.select("path", "indexed_files", "status", "needs_rescan")


@query("x11_cleanup_catalog", ("duplicated", "folders"), _CLEAN + " select rowid, file_path from d")
def x11_catalog(v: Views):
    clean, _ = FO.cleanup(v.duplicated(), v.folders())
    return clean.select("rowid", "file_path")


@query("x12_request_paths", ("folders",), """
    select trim(path) as path, min(pos) as pos from (
      select case when doc_id % 4 = 0 then '  ' else ' /' || source || ' ' end as path, doc_id as pos from documents)
    where trim(path) <> '' group by trim(path)""")
def x12(v: Views):
    asked = v.table("documents").select(
        F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" /"), "source", F.lit(" "))).alias("path"),
        F.col("doc_id").alias("pos"),
    )
    default = v.folders().select("path", F.length("path").cast("long").alias("pos"))
    return FO.request_paths(asked, default)


@query("x12_request_default", ("folders",), "select path, length(path)::bigint as pos from folders")
def x12_default(v: Views):
    """Only blank paths are requested, so the default set is taken."""
    asked = v.table("documents").select(F.lit(" ").alias("path"), F.col("doc_id").alias("pos"))
    default = v.folders().select("path", F.length("path").cast("long").alias("pos"))
    return FO.request_paths(asked, default)


@query("x14_roots", ("roots",), """
    select path from roots union select '/extra' as path""")
def x14(v: Views):
    padded = v.roots().select(F.concat(F.lit(" "), "path", F.lit(" ")).alias("path"))
    return FO.add_root(FO.add_root(FO.set_roots(padded), " /extra "), "  ")


@query("f13_folder_state", ("folders",), """
    select path, case when status = 'In Progress' then 'scanning'
                      when status = 'Completed' or (total_files > 0 and indexed_files >= total_files) then 'ok'
                      when needs_rescan or indexed_files < total_files then 'outdated' else 'pending' end as state
    from folders""")
def f13(v: Views):
    return v.folders().select(
        "path", S.folder_state("status", "needs_rescan", "indexed_files", "total_files").alias("state")
    )


@query("s13_folder_totals", ("folders",), "select path, total_files, status from folders")
def s13(v: Views):
    """Folder table written and read back."""
    import os

    from threadlake.session import shared_dir
    from threadlake.sources import tables

    base = os.path.join(shared_dir(v.spark), f"folders-{os.urandom(4).hex()}")
    tables.write_snapshot(v.folders().select(*[F.col(f.name).cast(f.dataType) for f in tables.FOLDER_SCHEMA]), base)
    return tables.read_folders(v.spark, base).select("path", "total_files", "status")
