"""Catalogue reads, counts, scan planning and changes: P3-P8, P11, O1-O3, A1-A3, A18, A19,
J6, J7, J12, W3, X1-X5, X10, S3, S5-S7."""

import os

from pyspark.sql import functions as F

from threadlake.operators import catalog as C
from threadlake.operators import dml
from threadlake.operators import folders as FO
from threadlake.operators.ordered import keep_latest
from threadlake.session import shared_dir, stage
from threadlake.sources import progress_table, tables
from threadlake.streaming.ingest import plan_changes

from .registry import query
from .views import Views


@query("a1_format_counts", ("catalog",), "select format, count(*) as n from catalog group by format")
def a1(v: Views):
    return C.format_counts(v.catalog())


@query("a2_library_totals", ("catalog", "folders"), """
    select (select count(*) from catalog) as global_indexed, (select sum(total_files)::bigint from folders) as global_total""")
def a2(v: Views):
    return C.library_totals(v.catalog(), v.folders())


@query("a3_discovery", ("catalog",), """
    select regexp_extract(file_path, '^(.*)/[^/]*$', 1) as path, count(*) as total_files
    from catalog where ends_with(lower(file_path), '.emb') group by all""")
def a3(v: Views):
    return C.discover(v.catalog())


@query("a3_discovery_total", ("catalog",), """
    select count(*) as designs, count(distinct regexp_extract(file_path, '^(.*)/[^/]*$', 1)) as folders
    from catalog where ends_with(lower(file_path), '.emb')""")
def a3_total(v: Views):
    return C.discover_total(v.catalog())


@query("a18_duplicate_paths", ("duplicated",), """
    select file_path, count(*) as n from duplicated group by file_path having count(*) > 1""")
def a18(v: Views):
    return C.duplicate_paths(v.duplicated())


@query("p6_lookup_ids", ("catalog", "stored"), """
    select rowid, id, file_path from catalog
    where id in (select id from stored) and file_path in (select file_path from stored)""")
def p6(v: Views):
    stored = v.stored()
    return C.lookup(v.catalog(), ids=stored, paths=stored).select("rowid", "id", "file_path")


@query("p6_path_facts", ("catalog", "stored", "folders"), """
    with p as (select path from folders union select file_path from stored)
    select p.path, p.path in (select file_path from catalog) as present,
           count(c.file_path) as below
    from p left join catalog c on starts_with(c.file_path, p.path || '/') group by p.path""")
def p6_facts(v: Views):
    """Existence and count of every folder and stored path."""
    paths = v.folders().select("path").union(v.stored().select("file_path")).distinct()
    return C.path_facts(v.catalog(), paths)


@query("p7_thumbnail", (), """
    select vec_id as id, upper(hex(encode(case when vec_id % 3 = 0 then 'p' || label::varchar else 't' || vec_id::varchar end))) as thumbnail
    from embeddings""")
def p7(v: Views):
    media = v.table("embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("t"), F.col("vec_id").cast("string")).cast("binary")).alias("thumbnail"),
        F.concat(F.lit("p"), F.col("label").cast("string")).cast("binary").alias("preview_png"),
    )
    return C.thumbnail(media).select("id", F.hex("thumbnail").alias("thumbnail"))


@query("p8_name_contains", (), """
    select p_partkey, p_name from part where p_name ilike '%R_d%'""")
def p8(v: Views):
    return C.name_contains(v.table("part").select("p_partkey", "p_name"), "R_d", col="p_name")


@query("p8_name_contains_literal", ("catalog",), """
    select rowid, file_name from catalog where contains(lower(file_name), '1.emb')""")
def p8_literal(v: Views):
    rows = v.catalog().select("rowid", "file_name")
    return C.name_contains(rows, "1.EMB", wildcards=False)


@query("p11_name_regex", ("catalog",), """
    select rowid, file_name from catalog where regexp_matches(file_name, '\\.emb$', 'i')""")
def p11(v: Views):
    return C.filter_results(v.catalog().select("rowid", "file_name"))


@query("o1_latest", ("catalog",), """
    select id, file_path, file_name, format, size_kb, true as has_preview from catalog where format = 'emb'
    order by indexed_at desc, id limit 50""")
def o1(v: Views):
    return C.latest(v.catalog())


@query("o2_browse_page", ("catalog",), """
    select id, file_path, file_name, format, size_kb, has_preview from catalog where format = 'emb'
    order by indexed_at desc, id limit 48 offset 48""")
def o2(v: Views):
    return C.browse(v.catalog(), page=2)


def _part_names(v: Views):
    """Parts as browsable rows."""
    return v.table("part").select(
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"),
        F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string")).alias("file_path"),
        F.col("p_name").alias("file_name"),
        F.lit("emb").alias("format"),
        "p_retailprice",
    ).withColumn("size_kb", F.col("p_retailprice")).withColumn("has_preview", F.lit(True))


@query("o2_browse_filtered", (), """
    select lpad(p_partkey::varchar, 9, '0') as id, '/parts/' || p_partkey::varchar as file_path, p_name as file_name,
           'emb' as format, p_retailprice as size_kb, true as has_preview
    from part where p_name ilike '%ring%' order by p_name, id limit 48 offset 48""")
def o2_filtered(v: Views):
    return C.browse(_part_names(v), q=" RING ", page=2, page_size=900)


@query("o3_browse_meta", (), """
    select count(*) as total, 1::bigint as page, 30::bigint as page_size, ceil(count(*) / 30.0)::bigint as pages
    from part where p_name ilike '%ring%'""")
def o3(v: Views):
    return C.browse_meta(_part_names(v), q="ring", page=-3, page_size=30)


@query("w3_keep_latest", ("catalog",), """
    select id, rowid, file_path, indexed_at from catalog
    qualify row_number() over (partition by id order by indexed_at desc, rowid desc) = 1""")
def w3(v: Views):
    rows = v.catalog().select("id", "rowid", "file_path", "indexed_at")
    return keep_latest(rows, "id", ["indexed_at", "rowid"])


@query("j6_unchanged_files", ("files", "stored"), """
    select f.seq, f.file_path, coalesce(s.file_mtime = f.file_mtime and s.size_kb = f.size_kb, false) as unchanged, s.id as known_id
    from files f left join stored s using (file_path)""")
def j6(v: Views):
    return C.split_unchanged(v.files(), v.stored()).select("seq", "file_path", "unchanged", "known_id")


@query("j7_moves", ("files", "stored"), """
    with l as (select * from files qualify row_number() over (partition by id order by seq desc) = 1)
    select l.id, l.seq, l.file_path, s.file_path as old_path
    from l join stored s using (id) where l.file_path <> s.file_path""")
def j7(v: Views):
    return C.detect_moves(v.files(), v.stored()).select("id", "seq", "file_path", "old_path")


# One file after the other, as set logic: an operation is a file that is not skipped.
_PLAN = """
    with m as (
      select f.seq, f.file_path, s.id as known_id, f.id as own_id,
             coalesce(s.file_mtime = f.file_mtime and s.size_kb = f.size_kb, false) as same
      from files f left join stored s using (file_path)),
    t as (select own_id as id, min(seq) as touch from m where not same group by own_id),
    k as (select m.*, case when same then known_id else own_id end as id,
                 same and coalesce(t.touch > m.seq, true) as skip
          from m left join t on t.id = case when m.same then m.known_id else m.own_id end),
    o as (select seq, file_path, id, row_number() over (partition by id order by seq) as nth,
                 row_number() over (partition by id order by seq desc) as back from k where not skip),
    l as (select o.*, case when nth > 1 then 'moved'
                 when s.id is not null and s.file_path <> o.file_path
                      and not exists (from o x where x.file_path = s.file_path and x.seq < o.seq and x.id <> o.id) then 'moved'
                 else 'indexed' end as outcome
          from o left join stored s on s.id = o.id),
    plan as (select seq, file_path, id, outcome, back = 1 as wins from l
             union all select seq, file_path, id, 'skipped', false from k where skip)"""


@query("t6_scan_outcomes", ("files", "stored"), _PLAN + " select seq, file_path, id, outcome, wins from plan")
def t6(v: Views):
    plan = C.plan_scan(v.files(), v.stored())
    return plan.select("seq", "file_path", "id", "outcome", "wins")


@query("t6_applied_catalog", ("files", "stored"), _PLAN + """,
    touched as (select * from plan where outcome <> 'skipped'),
    rest as (select id, file_path, file_mtime, indexed_at, 1.0::double as v from stored
             where id not in (select id from touched) and file_path not in (select file_path from touched)),
    fresh as (select distinct id from plan where outcome = 'indexed')
    select * from rest
    union all
    select w.id, w.file_path, f.file_mtime,
           case when w.id in (from fresh) then 7 else s.indexed_at end,
           case when w.id in (from fresh) then length(d.text) else 1.0 end::double
    from plan w join files f using (seq) join documents d on d.doc_id = w.seq left join stored s on s.id = w.id
    where w.wins""")
def t6_applied(v: Views):
    """The whole scan applied: new content is embedded (here: its length), moved content
    keeps its vector."""
    one = F.array(F.lit(1.0)).cast("array<float>")
    before = v.stored().withColumn("embedding", one).withColumn("sidecar_embedding", F.lit(None).cast("array<float>"))
    texts = v.table("documents").select(F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("content"))

    def embedder(contents):
        size = F.length(F.col("content").cast("string")).cast("float")
        return contents.select("id", F.array(size).alias("embedding"))

    changes = plan_changes(before, v.files().join(texts, "seq"), embedder, 7)
    after = changes.applied_to(before.drop("rowid"))
    return after.select(
        "id", "file_path", "file_mtime", "indexed_at", F.col("embedding")[0].cast("double").alias("v")
    )


@query("j2_counts_after_scan", ("files", "stored", "folders"), _PLAN + """,
    touched as (select * from plan where outcome <> 'skipped'),
    now as (select file_path from stored where id not in (select id from touched) and file_path not in (select file_path from touched)
            union all select file_path from plan where wins)
    select f.path, count(n.file_path) as indexed_files from folders f left join now n on starts_with(n.file_path, f.path || '/') group by f.path""")
def j2_counts(v: Views):
    """Folder counts kept up with a scan by signed deltas, without a recount of the catalogue."""
    before = v.stored()
    plan = stage(C.plan_scan(v.files(), before).where("outcome <> 'skipped'"), "plan")
    gone = before.join(plan.select("id").distinct(), "id", "left_semi").select("id", "file_path").unionByName(
        before.join(plan.select("file_path").distinct(), "file_path", "left_semi").select("id", "file_path")
    )
    deltas = FO.count_deltas(gone.distinct(), plan.where("wins")).withColumn("outdated", F.lit(False))
    folders = FO.recount_folders(v.folders(), before, now=1)
    changed = FO.changed_folders(folders, deltas, now=2)
    rest = folders.join(changed, "path", "left_anti")
    return rest.unionByName(changed).select("path", "indexed_files")


@query("a19_outcome_counts", ("files", "stored"), _PLAN + " select outcome, count(*) as n from plan group by outcome")
def a19(v: Views):
    return C.outcome_counts(C.plan_scan(v.files(), v.stored()))


# -- changes -----------------------------------------------------------------


def _upsert_parts(v: Views):
    """The stored library with a thumbnail text, and a batch: all documents
    again, last copy of each content, every third one with a new thumbnail."""
    thumb = F.concat(F.lit("old"), F.col("rowid").cast("string"))
    before = v.stored().withColumn("thumbnail", thumb)
    batch = v.catalog().withColumn(
        "thumbnail", F.when(F.col("rowid") % 3 == 0, F.concat(F.lit("new"), F.col("rowid").cast("string")))
    )
    return before, batch


_UPSERT = """
    with b as (select *, case when rowid % 3 = 0 then 'new' || rowid::varchar end as thumbnail from catalog
               qualify row_number() over (partition by id order by rowid desc) = 1),
    s as (select *, 'old' || rowid::varchar as thumbnail from stored),
    u as (select rowid, id, file_path, file_mtime, indexed_at, thumbnail from s
          where file_path not in (select file_path from b) and id not in (select id from b)
          union all
          select b.rowid, b.id, b.file_path, b.file_mtime, 99, coalesce(b.thumbnail, s.thumbnail)
          from b left join s using (file_path))"""


@query("x1_upsert", ("catalog", "stored"), _UPSERT + " select rowid, id, file_path, file_mtime, indexed_at, thumbnail from u")
def x1(v: Views):
    before, batch = _upsert_parts(v)
    after = dml.upsert(before, batch, now=99, order="rowid")
    return after.select("rowid", "id", "file_path", "file_mtime", "indexed_at", "thumbnail")


@query("x2_delete_paths", ("catalog", "stored"), """
    select rowid, file_path from catalog where file_path not in (select file_path from stored)""")
def x2(v: Views):
    return dml.delete_paths(v.catalog(), v.stored()).select("rowid", "file_path")


@query("x3_delete_under", ("catalog", "folders"), """
    select rowid, file_path from catalog c
    where not exists (from folders f where f.status in ('Error', 'Pending')
                      and (starts_with(c.file_path, f.path || '/') or c.file_path = f.path))""")
def x3(v: Views):
    gone = v.folders().where("status in ('Error', 'Pending')")
    return dml.delete_under(v.catalog(), gone).select("rowid", "file_path")


@query("x4_clear", ("catalog",), "select rowid, file_path from catalog where false")
def x4(v: Views):
    return dml.clear(v.catalog()).select("rowid", "file_path")


@query("x5_apply_moves", ("files", "stored"), """
    with l as (select * from files qualify row_number() over (partition by id order by seq desc) = 1),
    mv as (select l.id, l.file_path, l.file_mtime, l.size_kb from l join stored s using (id) where l.file_path <> s.file_path)
    select s.id, coalesce(m.file_path, s.file_path) as file_path,
           case when m.id is not null then regexp_extract(m.file_path, '([^/]*)$', 1) else s.file_name end as file_name,
           coalesce(m.file_mtime, s.file_mtime) as file_mtime
    from stored s left join mv m using (id)
    where not exists (from mv x where x.file_path = s.file_path and x.id <> s.id)""")
def x5(v: Views):
    moves = C.detect_moves(v.files(), v.stored())
    after = dml.apply_moves(v.stored(), moves)
    return after.select("id", "file_path", "file_name", "file_mtime")


_DEDUPE = """
    with c as (select *, count(*) over (partition by file_path) as n,
                      count(*) filter (has_preview) over (partition by file_path) as shown from duplicated),
    k as (select * from c where n = 1 or has_preview {loose})
    select rowid, id, file_path, has_preview from k
    qualify row_number() over (partition by file_path order by rowid desc) = 1"""


@query("x10_dedupe_strict", ("duplicated",), _DEDUPE.format(loose=""))
def x10(v: Views):
    return dml.dedupe_paths(v.duplicated()).select("rowid", "id", "file_path", "has_preview")


@query("x10_dedupe_keep_one", ("duplicated",), _DEDUPE.format(loose="or shown = 0"))
def x10_loose(v: Views):
    return dml.dedupe_paths(v.duplicated(), strict=False).select("rowid", "id", "file_path", "has_preview")


# -- tables --------------------------------------------------------------------

_STORED_COLUMNS = ("rowid", "id", "file_path", "file_mtime")


@query("s5_snapshot_and_deltas", ("catalog", "stored"), """
    with s as (select rowid, id, file_path, file_mtime from stored),
    b as (select rowid, id, file_path, file_mtime from catalog
          qualify row_number() over (partition by id order by rowid desc) = 1)
    select * from s where file_path not in (select file_path from b) and id not in (select id from b)
    union all select * from b""")
def s5(v: Views):
    """Stored library as a snapshot, the current files as a delta, read back merged."""
    base = os.path.join(shared_dir(v.spark), f"catalog-{v.spark.sparkContext.applicationId}-{os.urandom(4).hex()}")
    before = v.stored().select(*_STORED_COLUMNS)
    rows = keep_latest(
        v.catalog().select(*_STORED_COLUMNS), "id", ["rowid"]
    )
    tables.write_catalog(before, base)
    tables.write_delta(rows, rows, rows, base, 1)
    return tables.read_catalog(v.spark, base, before.schema)


@query("s6_backup_copy", ("catalog",), "select rowid, id, file_path from catalog")
def s6(v: Views):
    base = os.path.join(shared_dir(v.spark), f"backup-{os.urandom(4).hex()}")
    return v.spark.read.parquet(
        tables.snapshot(v.catalog().select("rowid", "id", "file_path"), base, "2024-01-01_00-00-00")
    )


@query("s7_scan_checkpoints", ("catalog",), """
    with c as (select '/' || source as drive_path, lang, count(*) as processed, max(doc_id)::varchar as last_file,
                      dense_rank() over (order by lang) as updated_at
               from documents group by source, lang)
    select drive_path, case when updated_at = (select max(updated_at) from c) then '' else last_file end as last_file, processed, updated_at
    from c qualify row_number() over (partition by drive_path order by updated_at desc) = 1""")
def s7(v: Views):
    """Checkpoints of each source after the files of one language after the other; the last
    language is scanned to its end."""
    done = v.table("documents").groupBy(F.concat(F.lit("/"), "source").alias("drive_path"), "lang").agg(
        F.count(F.lit(1)).alias("processed"), F.max("doc_id").cast("string").alias("last_file")
    )
    stored = v.spark.createDataFrame([], progress_table.PROGRESS_SCHEMA)
    langs = ("de", "en", "es", "fr")
    for step, lang in enumerate(langs, 1):
        now = done.where(F.col("lang") == lang)
        if lang == langs[-1]:
            now = now.withColumn("last_file", F.lit(""))
        stored = progress_table.save_progress(stored, now, now=step)
    return stored


@query("s7_source_totals", (), """
    select '/' || source as drive_path, count(*) as processed, max(doc_id)::varchar as last_file from documents group by source""")
def s7_totals(v: Views):
    """Files and last file of each source, of every language."""
    return v.table("documents").groupBy(F.concat(F.lit("/"), "source").alias("drive_path")).agg(
        F.count(F.lit(1)).alias("processed"), F.max("doc_id").cast("string").alias("last_file")
    )


@query("s7_load_and_clear", ("folders",), """
    select path, case when needs_rescan then '' else name end as last_file,
           case when needs_rescan then 0 else indexed_files end as processed, not needs_rescan as found
    from folders""")
def s7_load(v: Views):
    folders = v.folders()
    progress = folders.select(
        F.col("path").alias("drive_path"), F.col("name").alias("last_file"),
        F.col("indexed_files").alias("processed"), F.lit(1).cast("long").alias("updated_at"),
    )
    left, _ = progress_table.clear_progress(progress, folders, folders.where("needs_rescan"))
    return progress_table.load_progress(left, folders)
