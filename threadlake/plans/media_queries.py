"""Stitch records, pictures and embedding jobs: W4-W6, A14-A16, F18-F20, U1-U7."""

from pyspark.sql import functions as F

from threadlake.operators import designs, embedding, images

from .registry import query
from .views import Views


@query("w4_color_index", ("stitches",), """
    select design_id, seq, cmd, sum((cmd = 'COLOR_CHANGE')::bigint) over (partition by design_id order by seq)::bigint as color_index
    from stitches""")
def w4(v: Views):
    out = designs.with_color_index(v.stitches(), segment_rows=2000)
    return out.select("design_id", "seq", "cmd", "color_index")


@query("w5_until_end", ("ended_stitches",), """
    with e as (select design_id, min(seq) as stop from ended_stitches where cmd in ('END', 'STOP') group by all)
    select s.design_id, s.seq, s.cmd from ended_stitches s left join e using (design_id) where stop is null or seq < stop""")
def w5(v: Views):
    return designs.until_end(v.ended_stitches()).select("design_id", "seq", "cmd")


_SEGMENTS = """
    with p as (select *, lag(x) over w as x0, lag(y) over w as y0, lag(cmd) over w as before,
                      sum((cmd = 'COLOR_CHANGE')::bigint) over w as color_index
               from stitches window w as (partition by design_id order by seq)),
    s as (select design_id, seq, x0, y0, x as x1, y as y1, color_index::bigint as color_index from p
          where cmd = 'STITCH' and before not in ('COLOR_CHANGE', 'TRIM'))"""


@query("w6_segments", ("stitches",), _SEGMENTS + " select * from s")
def w6(v: Views):
    return designs.segments(v.stitches(), segment_rows=2000)


_BOX = """
    select design_id, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y,
           coalesce(nullif(max(x) - min(x), 0), 1) as width, coalesce(nullif(max(y) - min(y), 0), 1) as height
    from stitches group by design_id"""


@query("a15_bounding_box", ("stitches",), _BOX)
def a15(v: Views):
    return designs.design_bbox(v.stitches())


@query("f19_canvas_lines", ("stitches",), _SEGMENTS + f""",
    b as ({_BOX}),
    k as (select *, 432.0::double / greatest(width, height) as scale from b)
    select design_id, seq, trunc((x0 - min_x) * scale)::int + 40 as px0, trunc((max_y - y0) * scale)::int + 40 as py0,
           trunc((x1 - min_x) * scale)::int + 40 as px1, trunc((max_y - y1) * scale)::int + 40 as py1
    from s join k using (design_id)""")
def f19(v: Views):
    lines = designs.to_canvas(designs.segments(v.stitches(), segment_rows=2000), v.stitches())
    return lines.drop("rgb")


@query("a14_design_stats", ("ended_stitches",), """
    select design_id, count(*) filter (cmd = 'STITCH') as stitch_count, count(*) filter (cmd in ('TRIM', 'JUMP')) as trim_count,
           greatest(1, count(*) filter (cmd = 'COLOR_CHANGE') + 1)::bigint as color_count
    from ended_stitches group by design_id""")
def a14(v: Views):
    return designs.design_stats(v.ended_stitches())


_META = """
    with f as (select doc_id as design_id, octet_length(encode(text)) as n, sha256(text) as x from documents),
    a as (select user_id as design_id, count(*) filter (event_type not in ('purchase', 'signup', 'error')) as st,
                 count(*) filter (event_type in ('error', 'purchase')) as tr, count(*) filter (event_type = 'signup') + 1 as co
          from events group by user_id),
    h as (select f.*, a.st, a.tr, a.co,
                 ('0x' || substr(x, 31, 2) || substr(x, 29, 2) || substr(x, 27, 2) || substr(x, 25, 2))::bigint as h1,
                 ('0x' || substr(x, 23, 2) || substr(x, 21, 2) || substr(x, 19, 2) || substr(x, 17, 2))::bigint as h2,
                 ('0x' || substr(x, 39, 2) || substr(x, 37, 2) || substr(x, 35, 2) || substr(x, 33, 2))::bigint as h3,
                 ('0x' || substr(x, 47, 2) || substr(x, 45, 2) || substr(x, 43, 2) || substr(x, 41, 2))::bigint as h4,
                 ('0x' || substr(x, 55, 2) || substr(x, 53, 2) || substr(x, 51, 2) || substr(x, 49, 2))::bigint as h5,
                 ('0x00' || substr(x, 1, 2))::bigint as hc
          from f left join a using (design_id)),
    p as (select *, case when h1 between 100 and 5000000 then h1 when h2 between 100 and 5000000 then h2 when h3 between 100 and 5000000 then h3
                         when h4 between 100 and 5000000 then h4 when h5 between 100 and 5000000 then h5 end as hs from h),
    m as (select design_id, n, round_even(n / 1024.0::double, 1) as size_kb, coalesce(st, hs) as stitch_count, tr as trim_count,
                 case when st is not null then co when hc between 1 and 100 then hc end as color_count,
                 coalesce(st, hs) is null as approximate,
                 case when st is not null then 'records' when hs is not null then 'header' else 'unknown' end as source
          from p)"""


def _meta(v: Views, estimate: bool):
    docs = v.table("documents")
    files = docs.select(
        F.col("doc_id").alias("design_id"), F.lit("-").alias("file_name"), F.octet_length("text").cast("long").alias("size_bytes")
    )
    digest = F.unhex(F.sha2("text", 256))
    # the colour word: first byte of the hash, then a zero byte
    aux = F.concat(F.substring(digest, 1, 1), F.unhex(F.lit("000000")))
    headers = docs.select(F.col("doc_id").alias("design_id"), digest.alias("info"), aux.alias("aux"))
    return designs.design_metadata(files, v.stitches(), headers, estimate).drop("file_name")


@query("u6_design_metadata", (), _META + """
    select design_id, size_kb, stitch_count, trim_count, color_count, approximate, source from m""")
def u6(v: Views):
    return _meta(v, False)


@query("u6_metadata_estimated", (), _META + """
    select design_id, size_kb, coalesce(stitch_count, floor(n / 0.6::double)::bigint) as stitch_count,
           coalesce(trim_count, greatest(0, round_even(coalesce(stitch_count, floor(n / 0.6::double)::bigint) / 500.0::double, 0))::bigint) as trim_count,
           coalesce(color_count, greatest(1, least(50, round_even(size_kb / 3.0::double, 0)))::bigint) as color_count, approximate, source
    from m""")
def u6_estimated(v: Views):
    return _meta(v, True)


# -- pictures --------------------------------------------------------------------

_FLAGGED = """
    with c as (select img_id, floor(sum(r) / 4)::int as bg_r, floor(sum(g) / 4)::int as bg_g, floor(sum(b) / 4)::int as bg_b
               from pixels where x in (0, 7) and y in (0, 7) group by img_id),
    f as (select p.*, c.* exclude (img_id), a >= 128 and abs(r - bg_r) + abs(g - bg_g) + abs(b - bg_b) > 30 as foreground
          from pixels p join c using (img_id))"""


@query("f20_foreground", ("pixels",), _FLAGGED + " select img_id, x, y, foreground from f")
def f20(v: Views):
    return images.with_foreground(v.pixels()).select("img_id", "x", "y", "foreground")


_PROFILE = _FLAGGED + """,
    m as (select img_id, count(*) as n_fg, list_sort(list(r)) as rs, list_sort(list(g)) as gs, list_sort(list(b)) as bs
          from f where foreground group by img_id)
    select c.img_id, bg_r, bg_g, bg_b, coalesce(n_fg, 0) as n_fg, coalesce(rs[n_fg // 2 + 1], 60) as fg_r,
           coalesce(gs[n_fg // 2 + 1], 60) as fg_g, coalesce(bs[n_fg // 2 + 1], 60) as fg_b
    from c left join m using (img_id)"""


@query("a16_color_profile", ("pixels",), _PROFILE)
def a16(v: Views):
    return images.color_profile(v.pixels())


@query("a16_image_profile", ("pixels",), _PROFILE)
def a16_packed(v: Views):
    return images.image_profile(v.images_rgba())


@query("u7_content_box", ("pixels",), """
    with h as (select *, greatest(r - b, 0) < 130 and r - g > 5 and r > 130 as hit from pixels),
    s as (select img_id, min(x) filter (hit) as lx, max(x) filter (hit) as hx, min(y) filter (hit) as ly, max(y) filter (hit) as hy,
                 count(distinct x) filter (hit) as nx, count(distinct y) filter (hit) as ny from h group by img_id)
    select img_id, (case when nx >= 4 and ny >= 4 then greatest(0, lx - 1) else 0 end)::int as x0,
           (case when nx >= 4 and ny >= 4 then greatest(0, ly - 1) else 0 end)::int as y0,
           (case when nx >= 4 and ny >= 4 then hx else 8 end)::int as x1, (case when nx >= 4 and ny >= 4 then hy else 8 end)::int as y1,
           nx >= 4 and ny >= 4 as found
    from s""")
def u7(v: Views):
    hit = (F.greatest(F.col("r") - F.col("b"), F.lit(0)) < 130) & (F.col("r") - F.col("g") > 5) & (F.col("r") > 130)
    return images.content_box(v.pixels(), hit, margin=1, min_lines=4)


@query("u7_canvas_box", ("pixels",), """
    with h as (select *, greatest(r - g, 0) < 30 and r - b > 5 and r > 180 as hit from pixels),
    s as (select img_id, min(x) filter (hit) as lx, max(x) filter (hit) as hx, min(y) filter (hit) as ly, max(y) filter (hit) as hy,
                 count(distinct x) filter (hit) as nx, count(distinct y) filter (hit) as ny from h group by img_id)
    select img_id, (case when nx >= 2 and ny >= 2 then greatest(0, lx - 1) else 0 end)::int as x0,
           (case when nx >= 2 and ny >= 2 then greatest(0, ly - 1) else 0 end)::int as y0,
           (case when nx >= 2 and ny >= 2 then hx else 8 end)::int as x1, (case when nx >= 2 and ny >= 2 then hy else 8 end)::int as y1,
           nx >= 2 and ny >= 2 as found
    from s""")
def u7_canvas(v: Views):
    """The crop to a beige canvas."""
    hit = images.is_canvas(F.col("r"), F.col("g"), F.col("b"))
    return images.content_box(v.pixels(), hit, margin=1, min_lines=2)


_ENCODE = """
    c as (select {keys}, x // {half} + 2 * (y // {half}) as cell, avg(r) as r, avg(g) as g, avg(b) as b from {src} group by all),
    d as (select {keys}, cell * 3 + k as i, case k when 0 then r when 1 then g else b end as e from c, (values (0), (1), (2)) as t(k)),
    n as (select {keys}, sqrt(sum(e * e)) as len from d group by all),
    u as (select {keys}, i, (e / len)::float::double as e from d join n using ({keys}))"""


@query("u1_embed", ("pixels",), "with " + _ENCODE.format(keys="img_id", src="pixels", half=4) + """
    select img_id, i::int as i, round(e, 6) as x from u""")
def u1(v: Views):
    """Batched encoder over all pictures."""
    out = embedding.embed(v.images(), embedding.grid_encoder(), keys=["img_id"])
    return out.select("img_id", F.posexplode("embedding").alias("i", "x")).withColumn(
        "x", F.round(F.col("x").cast("double"), 6)
    )


@query("u2_expand_views", ("pixels",), """
    with t as (select *, x // 4 + 2 * (y // 4) as view_id from pixels union all select *, 4 from pixels)
    select img_id, view_id::int as view_id, (case when view_id = 4 then 8 else 4 end)::int as height,
           sum(r)::bigint as r, sum(g)::bigint as g, sum(b)::bigint as b
    from t group by img_id, view_id""")
def u2(v: Views):
    return _sums(images.expand_views(v.images()), ["img_id", "view_id", "height"])


def _sums(views, keys):
    """Channel sums of pictures; the pixel position weights keep the order visible."""
    px = images.pixel_table(
        views.withColumn("k", F.struct(*keys)), "k"
    )
    return px.groupBy("k").agg(*[F.sum(c).alias(c) for c in "rgb"]).select("k.*", "r", "g", "b")


_AUGMENTED = """
    with g as (select img_id, x, y, r, g, b from pixels),
    o as (select distinct x, y from pixels),
    t as (select v, x, y, floor(cos(a) * (x + 0.5 - 4) + sin(a) * (y + 0.5 - 4) + 4)::int as u,
                 floor(-sin(a) * (x + 0.5 - 4) + cos(a) * (y + 0.5 - 4) + 4)::int as w
          from o, (values (2, radians(-5.0)), (3, radians(5.0))) as r(v, a)),
    s as (
      select img_id, 0 as view_id, x, y, r, g, b from g
      union all select img_id, 1, 7 - x, y, r, g, b from g
      union all select i.img_id, t.v, t.x, t.y, coalesce(g.r, 255), coalesce(g.g, 255), coalesce(g.b, 255)
                from (select distinct img_id from g) i cross join t left join g on g.img_id = i.img_id and g.x = t.u and g.y = t.w
      union all select img_id, 4, x, y, least(255, floor(r * 1.15::double))::int, least(255, floor(g * 1.15::double))::int, least(255, floor(b * 1.15::double))::int from g
      union all select img_id, 5, x, y, floor(r * 0.85::double)::int, floor(g * 0.85::double)::int, floor(b * 0.85::double)::int from g)"""


@query("u3_augment_views", ("pixels",), _AUGMENTED + """
    select img_id, view_id::int as view_id, x::int as x, y::int as y, r::int as r, g::int as g, b::int as b from s""")
def u3(v: Views):
    views = images.augment_views(v.images())
    px = images.pixel_table(views.withColumn("k", F.struct("img_id", "view_id")), "k")
    return px.select("k.*", "x", "y", "r", "g", "b")


@query("u5_companion_vectors", ("pixels",), _AUGMENTED + "," + _ENCODE.format(keys="img_id, view_id", src="s", half=4) + """,
    m as (select label, i, avg(e) as e from u join embeddings on vec_id = img_id group by all),
    l as (select label, sqrt(sum(e * e)) as len from m group by label)
    select label as item_id, i::int as i, round(e / len, 6) as x from m join l using (label)""")
def u5(v: Views):
    """Six views of every picture, encoded, pooled per label."""
    out = embedding.companion_vectors(v.images(), embedding.grid_encoder())
    return out.select("item_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("u4_prepare_images", ("pixels",), """
    with l as (select *, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 as luma from pixels),
    m as (select img_id, trunc(avg(luma) + 0.5)::double as mean from l group by img_id),
    c as (select img_id, x, y, trunc(least(255, greatest(0, mean + 1.4::double * (r - mean))))::bigint as r,
                 trunc(least(255, greatest(0, mean + 1.4::double * (g - mean))))::bigint as g,
                 trunc(least(255, greatest(0, mean + 1.4::double * (b - mean))))::bigint as b
          from pixels join m using (img_id)),
    k as (select *, ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16)::double as luma from c),
    p as (select img_id, x + 2 as x, y + 2 as y, trunc(least(255, greatest(0, luma + 1.3::double * (r - luma))))::int as r,
                 trunc(least(255, greatest(0, luma + 1.3::double * (g - luma))))::int as g,
                 trunc(least(255, greatest(0, luma + 1.3::double * (b - luma))))::int as b from k)
    select i.img_id, (n % 12)::int as x, (n // 12)::int as y, coalesce(p.r, 255)::int as r, coalesce(p.g, 255)::int as g, coalesce(p.b, 255)::int as b
    from (select distinct img_id from pixels) i cross join range(144) t(n)
    left join p on p.img_id = i.img_id and p.x = n % 12 and p.y = n // 12""")
def u4(v: Views):
    """Contrast and colour gain, then centred on a 12 x 12 white square."""
    ready = images.prepare_images(v.images(), size=12)
    return images.pixel_table(ready).select("img_id", "x", "y", "r", "g", "b")
