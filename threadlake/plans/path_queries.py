"""Paths, containment joins, companions: F1-F3, P1, P12, J1, J3-J5, J8, J9, J15, A11, E1, E4, O6, S2, S10, S12."""

from pyspark.sql import functions as F

from threadlake.functions import paths as P
from threadlake.operators import companions, containment
from threadlake.sources import files as file_source
from threadlake.sources import roots as root_source

from .registry import query
from .views import Views


@query("f1_path_parts", (), """
    with p as (select page_id, url, regexp_extract(url, '([^/]*)$', 1) as file_name from pages),
    q as (select *, regexp_extract(file_name, '(\\.[^.]*)$', 1) as raw from p)
    select page_id, left(url, length(url) - length(file_name) - 1) as dir, file_name,
           left(file_name, length(file_name) - length(raw)) as stem, lower(raw) as ext
    from q""")
def f1(v: Views):
    return v.table("pages").select("page_id", *P.path_parts("url"))


@query("f2_folder_label", (), """
    with p as (select page_id, string_split(url, '/') as s from pages)
    select page_id, case when len(s) < 3 or s[-2] = '' then '' when s[-3] <> '' and s[-3] <> s[-2]
                         then s[-3] || ' › ' || s[-2] else s[-2] end as label
    from p""")
def f2(v: Views):
    return v.table("pages").select("page_id", P.folder_label("url").alias("label"))


@query("f3_root_label", ("mounts",), """
    select path, case when path = '/' then 'Root (/)' when path = '/home' then 'Home (/home)'
                      when starts_with(path, '/media/') or starts_with(path, '/mnt/') or starts_with(path, '/run/media/')
                      then regexp_extract(path, '([^/]*)$', 1) else path end as label,
           regexp_extract(path, '([^/]*)$', 1) as short
    from mounts""")
def f3(v: Views):
    return v.mounts().select("path", P.root_label("path").alias("label"), P.short_root_label("path").alias("short"))


@query("p1_supported_suffix", ("catalog",), """
    select lower(right(file_path, 4)) = '.emb' as supported, count(*) as n from catalog group by all""")
def p1(v: Views):
    flags = v.catalog().select(P.is_supported("file_path").alias("supported"))
    return flags.groupBy("supported").agg(F.count(F.lit(1)).alias("n"))


@query("s1_excluded_dirs", (), """
    with p as (select page_id, '/lib' || replace(replace(substr(url, 8), 'blog.', '.blog'), 'm.', 'node_modules/') as path from pages)
    select page_id, path from p
    where not list_bool_or(list_transform(list_slice(string_split(path, '/'), 1, -2),
              lambda d: starts_with(d, '.') or d in ('node_modules', '.git', '.cache', '__pycache__')))""")
def s1(v: Views):
    """The directory exclusion of a scan, on paths made from the page addresses."""
    url = F.substring("url", 8, F.length("url"))
    path = F.concat(
        F.lit("/lib"), F.replace(F.replace(url, F.lit("blog."), F.lit(".blog")), F.lit("m."), F.lit("node_modules/"))
    )
    paths = v.table("pages").select("page_id", path.alias("path"))
    return paths.where(~P.hidden_or_tool_dir("path", F.lit("/lib")))


@query("s2_root_totals", ("catalog", "roots"), """
    select r.path, r.fs_type, count(c.file_path) as total_files
    from roots r left join catalog c on starts_with(c.file_path, r.path || '/') or c.file_path = r.path
    group by all""")
def s2(v: Views):
    return file_source.root_totals(v.catalog().select("file_path"), v.roots())


@query("s10_parse_roots", (), """
    select distinct trim(e) as path from (
      select unnest(string_split(' /' || source || ' ; ;/' || lang || ';', ';')) as e from documents)
    where trim(e) <> ''""")
def s10(v: Views):
    text = F.concat(F.lit(" /"), "source", F.lit(" ; ;/"), "lang", F.lit(";"))
    return root_source.parse_roots(v.table("documents").select(text.alias("t")), "t")


@query("s11_many_roots", ("items", "pictures"), """
    select file_path from items union all select file_path from pictures""")
def s11(v: Views):
    """Union of the file feeds of several roots."""
    return file_source.one_feed([v.items(), v.pictures()])


@query("s12_eval_folder", ("items",), """
    select file_path from items
    where regexp_extract(file_path, '^(.*)/[^/]*$', 1) = '/src1' and right(file_path, 4) in ('.emb', '.EMB')""")
def s12(v: Views):
    return file_source.scan_eval_set(v.items(), "/src1")


@query("j1_containment_join", ("catalog", "folders"), """
    select c.rowid, c.file_path, f.path as folder
    from catalog c join folders f on starts_with(c.file_path, f.path || '/')""")
def j1(v: Views):
    files = v.catalog().select("rowid", "file_path")
    return containment.containment_join(files, v.folders())


@query("j1_containment_with_self", ("catalog", "folders"), """
    with f as (select path from folders union all select file_path from catalog where ends_with(file_path, '.EMB'))
    select c.rowid, f.path as folder from catalog c join f on starts_with(c.file_path, f.path || '/') or c.file_path = f.path""")
def j1_self(v: Views):
    files = v.catalog().select("rowid", "file_path")
    own = files.where(F.col("file_path").endswith(".EMB")).select(F.col("file_path").alias("path"))
    folders = v.folders().select("path").unionByName(own)
    return containment.containment_join(files, folders, include_self=True).select("rowid", "folder")


@query("j3_deepest_root", ("catalog", "folders"), """
    select c.rowid, c.file_path, arg_max(f.path, length(f.path)) as root
    from catalog c left join folders f on (starts_with(c.file_path, f.path || '/') or c.file_path = f.path) and f.needs_rescan
    group by all""")
def j3(v: Views):
    return containment.deepest_root(
        v.catalog().select("rowid", "file_path"), v.folders().where("needs_rescan")
    )


@query("j4_under_roots", ("catalog", "folders"), """
    select rowid, file_path from catalog c
    where exists (from folders f where f.status = 'Completed' and (starts_with(c.file_path, f.path || '/') or c.file_path = f.path))""")
def j4(v: Views):
    return containment.under_roots(
        v.catalog().select("rowid", "file_path"), v.folders().where("status = 'Completed'")
    )


@query("p12_selected_root_guard", ("catalog", "mounts"), """
    with s as (select distinct '/' || regexp_extract(path, '([^/]*)$', 1) || '/en' as path from mounts where fs_type = 'ext4')
    select rowid, file_path from catalog c
    where exists (from s where starts_with(c.file_path, s.path || '/') or c.file_path = s.path)""")
def p12(v: Views):
    """Queued files are kept while their root is selected."""
    selected = v.mounts().where("fs_type = 'ext4'").select(
        F.concat(F.lit("/"), P.basename("path"), F.lit("/en")).alias("path")
    )
    return containment.under_roots(v.catalog().select("rowid", "file_path"), selected)


@query("j5_outside_roots", ("catalog", "folders"), """
    select rowid, file_path from catalog c
    where not exists (from folders f where f.status = 'Completed' and starts_with(c.file_path, f.path || '/'))""")
def j5(v: Views):
    return containment.outside_roots(
        v.catalog().select("rowid", "file_path"), v.folders().where("status = 'Completed'")
    )


_PLACED = """
    with i as (select file_path, regexp_extract(file_path, '^(.*)\\.[^.]*$', 1) as key, right(file_path, 4) as ext from items),
    p as (select file_path, regexp_extract(file_path, '^(.*)\\.[^.]*$', 1) as key,
                 regexp_extract(file_path, '(\\.[^.]*)$', 1) as ext from pictures),
    r as (select i.file_path as item_path, p.file_path as image_path,
                 list_position(['.jpg', '.JPG', '.jpeg', '.JPEG', '.png', '.PNG'], p.ext) as rank
          from i join p using (key) where p.ext in ('.jpg', '.JPG', '.jpeg', '.JPEG', '.png', '.PNG'))"""


@query("j8_pair_companions", ("items", "pictures"), _PLACED + """
    select p.file_path as image_path, arg_min(i.file_path, i.ext <> '.emb') as item_path
    from p join i using (key) where lower(p.ext) in ('.jpg', '.jpeg', '.png') group by p.file_path""")
def j8(v: Views):
    return companions.pair_companions(v.items(), v.pictures())


@query("j9_inventory", ("items", "pictures"), _PLACED + """
    select i.file_path as item_path,
           nullif(regexp_extract(i.file_path, '\\((\\d+)\\)[^/]*$', 1), '') as num,
           regexp_extract(i.file_path, '([^/])[^/]*$', 1) as prefix,
           coalesce(g.images, '') as images, g.images is not null as paired
    from i left join (select item_path, string_agg(image_path, '|' order by rank) as images from r group by item_path) g
      on g.item_path = i.file_path""")
def j9(v: Views):
    inv = companions.inventory(v.items(), v.pictures())
    return inv.withColumn("images", F.array_join("images", "|"))


@query("j15_first_companion", ("items", "pictures"), _PLACED + """
    select item_path, arg_min(image_path, rank) as image_path from r group by item_path""")
def j15(v: Views):
    return companions.first_companion(v.items(), v.pictures())


@query("a11_inventory_summary", ("items", "pictures"), _PLACED + """
    select count(*) as items, count(*) filter (n > 0) as paired, count(*) filter (n = 0) as unpaired, sum(n)::bigint as images
    from (select i.file_path, count(r.image_path) as n from i left join r on r.item_path = i.file_path group by all)""")
def a11(v: Views):
    return companions.inventory_summary(companions.inventory(v.items(), v.pictures()))


@query("e4_unpaired_items", ("items", "pictures"), _PLACED + """
    select file_path as item_path from i where file_path not in (select item_path from r)""")
def e4_unpaired(v: Views):
    return companions.unpaired(companions.inventory(v.items(), v.pictures())).select("item_path")


@query("e1_build_pairs", ("items", "pictures"), _PLACED + """
    select image_path as query, regexp_extract(item_path, '([^/]*)$', 1) as expected, item_path,
           regexp_extract(item_path, '\\((\\d+)\\)[^/]*$', 1) as num, regexp_extract(item_path, '([^/])[^/]*$', 1) as prefix,
           lower(regexp_extract(image_path, '(\\.[^.]*)$', 1)) as ext
    from r where regexp_matches(item_path, '\\(\\d+\\)[^/]*$')""")
def e1(v: Views):
    return companions.build_pairs(v.items(), v.pictures())


@query("o6_ordered_pairs", ("items", "pictures"), _PLACED + """
    select image_path as query, regexp_extract(item_path, '\\((\\d+)\\)[^/]*$', 1) as num
    from r where regexp_matches(item_path, '\\(\\d+\\)[^/]*$')
    order by lower(regexp_extract(item_path, '([^/])[^/]*$', 1)), num::bigint,
             lower(regexp_extract(image_path, '(\\.[^.]*)$', 1)), image_path""")
def o6(v: Views):
    return companions.order_pairs(companions.build_pairs(v.items(), v.pictures())).select("query", "num")
