"""Scalar functions: F4, F5, F8-F12, F14-F19, F21, F22."""

from pyspark.sql import functions as F

from threadlake.functions import scalars as S

from .registry import query
from .views import Views


@query("f5_content_id", (), """
    select doc_id, sha256(octet_length(encode(text))::varchar || text) as id, octet_length(encode(text)) / 1024.0::double as size_kb
    from documents""")
def f5(v: Views):
    """F4 and F5 over whole texts."""
    size = F.octet_length("text")
    return v.table("documents").select(
        "doc_id", S.content_id(size, "text").alias("id"), S.size_kb(size).alias("size_kb")
    )


@query("f8_clip_bytes", (), """
    select page_id, least(octet_length(encode(html)), 131072)::int as n from pages""")
def f8(v: Views):
    clipped = S.clip_bytes(F.col("html").cast("binary"))
    return v.table("pages").select("page_id", F.octet_length(clipped).alias("n"))


@query("f9_score_text", (), """
    select event_id, case when value / 100 >= 0.6 then 'high' when value / 100 >= 0.3 then 'mid' else 'low' end as band,
           repeat('█', trunc(value / 100 * 12)::int) || repeat('░', greatest(0, 12 - trunc(value / 100 * 12)::int)) as bar
    from events""")
def f9(v: Views):
    """F9 and F11 on the event values as scores."""
    score = F.col("value") / 100
    return v.table("events").select(
        "event_id", S.score_band(score).alias("band"), S.score_bar(score).alias("bar")
    )


@query("f10_percent_text", (), """
    select user_id, count(*) filter (value > 50)::varchar || '/' || count(*)::varchar || ' = ' ||
           printf('%.1f', count(*) filter (value > 50) / greatest(count(*), 1) * 100.0::double) || '%' as hits,
           -- ties go up here, to even above
           printf('%.1f', floor(count(*) filter (value > 50) / count(*) * 100.0::double * 10 + 0.5) / 10) || '%' as pct
    from events group by user_id""")
def f10(v: Views):
    per_user = v.table("events").groupBy("user_id").agg(
        F.count_if(F.col("value") > 50).alias("h"), F.count(F.lit(1)).alias("t")
    )
    return per_user.select(
        "user_id", S.hits_text("h", "t").alias("hits"), S.pct_text(F.col("h") / F.col("t")).alias("pct")
    )


@query("f12_name_parts", (), """
    with n as (select p_partkey, case when p_size % 5 = 0 then p_name else p_name || ' (' || p_size::varchar || ') (7).EMB' end as name from part)
    select p_partkey, nullif(regexp_extract(name, '\\((\\d+)\\)', 1), '') as num, substr(name, 1, 1) as prefix from n""")
def f12(v: Views):
    name = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(") (7).EMB"))
    )
    return v.table("part").select(
        "p_partkey", S.name_number(name).alias("num"), S.name_prefix(name).alias("prefix")
    )


@query("f14_verdict", (), """
    with u as (select user_id, count(*) filter (value > 12) / count(*) * 100.0::double as a1, count(*) filter (value > 6) / count(*) * 100.0::double as a5,
                      count(*) filter (value > 4) / count(*) * 100.0::double as a10 from events group by user_id)
    select user_id, case when a10 = 100 and a5 = 100 and a1 >= 90 then 'EXCELLENT' when a10 >= 95 and a1 >= 80 then 'GOOD'
                         when a10 >= 85 then 'ACCEPTABLE' else 'POOR' end as verdict
    from u""")
def f14(v: Views):
    def share(limit):
        return F.count_if(F.col("value") > limit) / F.count(F.lit(1)) * 100.0

    per_user = v.table("events").groupBy("user_id").agg(
        share(12).alias("a1"), share(6).alias("a5"), share(4).alias("a10")
    )
    return per_user.select("user_id", S.verdict("a1", "a5", "a10").alias("verdict"))


@query("f15_estimate_meta", (), """
    with s as (select doc_id, octet_length(encode(text)) as n from documents),
    t as (select doc_id, floor(n / 0.6::double)::bigint as st, round_even(n / 1024.0::double, 1) as kb from s)
    select doc_id, st as stitch_count, greatest(1, least(50, round_even(kb / 3.0::double, 0)))::bigint as color_count,
           greatest(0, round_even(st / 500.0::double, 0))::bigint as trim_count
    from t""")
def f15(v: Views):
    meta = S.estimate_meta(F.octet_length("text"))
    return v.table("documents").select("doc_id", meta.alias("m")).select("doc_id", "m.*")


@query("f16_header_probe", (), """
    with h as (select doc_id, sha256(text) as x from documents),
    g as (select doc_id, string_agg(substr(x, 8 * k + 1, 4) || '0' || substr(x, 8 * k + 6, 1)
                                    || case when (doc_id + k) % 3 = 0 then 'ff' else '00' end, '' order by k) as x
          from h, range(8) as t(k) group by doc_id),
    b as (select doc_id, case when doc_id % 4 = 3 then left(x, 28) else x end as x from g),
    r as (select doc_id, x, length(x) // 2 as n, unnest([12, 8, 16, 20, 24]) as o, generate_subscripts([12, 8, 16, 20, 24], 1) as k from b),
    p as (select doc_id, k, ('0x' || substr(x, 2 * o + 7, 2) || substr(x, 2 * o + 5, 2) || substr(x, 2 * o + 3, 2) || substr(x, 2 * o + 1, 2))::bigint as v
          from r where n >= o + 4),
    f as (select doc_id, arg_min(v, k) as stitches from p where v between 100 and 5000000 group by doc_id),
    c as (select doc_id, ('0x' || substr(x, 3, 2) || substr(x, 1, 2))::bigint as v from b)
    select b.doc_id, coalesce(f.stitches, -1) as stitches, case when c.v between 1 and 30000 then c.v end as colors
    from b left join f using (doc_id) join c using (doc_id)""")
def f16(v: Views):
    """Header values probed in blobs made from the hash of each text: every third value is
    out of range, one in four blobs is short."""
    x, doc = F.sha2("text", 256), F.col("doc_id")
    words = [
        F.concat(F.substring(x, 8 * k + 1, 4), F.lit("0"), F.substring(x, 8 * k + 6, 1), F.when((doc + k) % 3 == 0, "ff").otherwise("00"))
        for k in range(8)
    ]
    whole = F.unhex(F.concat(*words))
    blob = F.when(doc % 4 == 3, F.substring(whole, 1, 14)).otherwise(whole)
    return v.table("documents").select(
        "doc_id", F.coalesce(S.probe_u32(blob), F.lit(-1).cast("long")).alias("stitches"), S.probe_u16(blob, hi=30000).alias("colors")
    )


@query("f17_strategy_chain", (), """
    select event_id, coalesce(case when event_type = 'click' then user_id end, case when value > 50 then event_id end) as value,
           case when event_type = 'click' then 'records' when value > 50 then 'header' else 'unknown' end as source,
           not (event_type = 'click' or value > 50) as approximate
    from events""")
def f17(v: Views):
    chain = S.first_of(
        [
            ("records", F.when(F.col("event_type") == "click", F.col("user_id"))),
            ("header", F.when(F.col("value") > 50, F.col("event_id"))),
        ]
    )
    return v.table("events").select("event_id", *chain)


_PALETTE_SQL = "[" + ", ".join(str((r << 16) + (g << 8) + b) for r, g, b in S.PALETTE) + "]"


@query("f18_colors", (), f"""
    select event_id, (event_id * 7919 % 16777216 >> 16)::int as r, ((event_id * 7919 % 16777216) >> 8 & 255)::int as g,
           (event_id * 7919 % 16777216 & 255)::int as b,
           ({_PALETTE_SQL})[event_id % 16 + 1]::int as palette
    from events""")
def f18(v: Views):
    rgb = S.unpack_rgb(F.col("event_id") * 7919 % 16777216)
    return v.table("events").select(
        "event_id", rgb.alias("c"), S.palette_color("event_id").alias("p")
    ).select(
        "event_id", "c.r", "c.g", "c.b",
        (F.col("p.r") * 65536 + F.col("p.g") * 256 + F.col("p.b")).alias("palette"),
    )


@query("f21_base64_json", (), """
    select page_id, base64(encode(html)) as preview, json_object('page_id', page_id, 'url', url)::varchar as body from pages""")
def f21(v: Views):
    """Base64 in one piece, and a JSON body that is parsed and written again."""
    whole = F.regexp_replace(S.preview_base64(F.col("html").cast("binary")), "[\r\n]", "")
    body = F.to_json(F.struct("page_id", "url"))
    again = F.to_json(F.from_json(body, "page_id long, url string"))
    return v.table("pages").select("page_id", whole.alias("preview"), again.alias("body"))


@query("f22_progress_pct", ("folders",), """
    select path, round(case when total_files - 3 > 0 then least(100.0::double, indexed_files / (total_files - 3) * 100.0::double) else 0 end, 6) as pct
    from folders""")
def f22(v: Views):
    return v.folders().select(
        "path", F.round(S.progress_pct("indexed_files", F.col("total_files") - 3), 6).alias("pct")
    )
