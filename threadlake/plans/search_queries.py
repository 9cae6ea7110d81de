"""Vector search and pooling: V1-V5, W1, A5, A6, P2-P5, O4, J10, J14, X13, S4, F6, F7."""

from pyspark.sql import functions as F

from threadlake.functions import vectors as V
from threadlake.operators import pooling, search

from .registry import query
from .views import Views

_SCORED = """
    with s as (
      select q.query_id, q.view_id, v.*, round(list_inner_product(v.embedding, q.qv), 6) as score
      from vectors v, view_queries q {where})"""


@query("v1_knn", ("vectors", "view_queries"), _SCORED.format(where="") + """
    select query_id, view_id, id, score from s
    qualify row_number() over (partition by query_id, view_id order by score desc, id) <= 20""")
def v1(v: Views):
    return search.knn(v.vectors(), v.view_queries(), 20)


@query("w1_topk_format_filter", ("vectors", "view_queries"), _SCORED.format(where="where lower(v.format) = 'jpg'") + """
    select query_id, view_id, id, file_path, score from s
    qualify row_number() over (partition by query_id, view_id order by score desc, id) <= 5""")
def w1(v: Views):
    return search.knn(v.vectors(), v.view_queries(), 5, fmt="JPG", keep=["file_path"])


_POOLED = _SCORED.format(where="where lower(v.format) = 'emb'") + """,
    d as (select * from s qualify row_number() over (partition by query_id, view_id order by score desc, id) <= {depth}),
    p as (select query_id, id, any_value(file_path) as file_path, any_value(file_name) as file_name,
                 any_value(format) as format, any_value(size_kb) as size_kb, any_value(has_preview) as has_preview,
                 max(score) as score
          from d where has_preview group by query_id, id having max(score) > 0)"""


@query("v2_multiview_search", ("vectors", "view_queries"), _POOLED.format(depth=1000) + """
    select query_id, id, file_path, file_name, format, size_kb, score, has_preview from p
    qualify row_number() over (partition by query_id order by score desc, id) <= 100""")
def v2(v: Views):
    return search.to_results(search.search(v.vectors(), v.view_queries()))


@query("v2_depth_before_preview", ("vectors", "view_queries"), _POOLED.format(depth=12) + """
    select query_id, id, score, has_preview from p
    qualify row_number() over (partition by query_id order by score desc, id) <= 10""")
def v2_depth(v: Views):
    hits = search.search(v.vectors(), v.view_queries(), top=10, depth=12)
    return hits.select("query_id", "id", "score", "has_preview")


@query("v3_dual_vector_search", ("vectors", "view_queries"), """
    with s as (
      select q.query_id, q.view_id, v.id, v.has_preview,
             round(greatest(list_inner_product(v.embedding, q.qv), list_inner_product(v.companion, q.qv)), 6) as score
      from vectors v, view_queries q where lower(v.format) = 'emb'),
    d as (select * from s qualify row_number() over (partition by query_id, view_id order by score desc, id) <= 1000),
    p as (select query_id, id, max(score) as score from d where has_preview group by all having max(score) > 0)
    select query_id, id, score from p qualify row_number() over (partition by query_id order by score desc, id) <= 50""")
def v3(v: Views):
    found = search.search(v.vectors(), v.view_queries(), top=50, dual="companion")
    return found.select("query_id", "id", "score")


@query("v4_similar_to", ("vectors", "view_queries"), """
    with b as (
      select distinct id from (
        select v.id from vectors v, view_queries q
        qualify row_number() over (partition by q.query_id, q.view_id
                                   order by round(list_inner_product(v.embedding, q.qv), 6) desc, v.id) <= 1)),
    s as (
      select q.id as query_id, v.id, v.has_preview, round(list_inner_product(v.embedding, q.embedding), 6) as score
      from vectors v, vectors q where q.id in (from b) and lower(v.format) = 'emb'),
    d as (select * from s qualify row_number() over (partition by query_id order by score desc, id) <= 1000)
    select query_id, id, score from d where has_preview and score > 0
    qualify row_number() over (partition by query_id order by score desc, id) <= 25""")
def v4(v: Views):
    """Search by catalogue items: the ones nearest to each query view."""
    nearest = search.knn(v.vectors(), v.view_queries(), 1).select("id")
    return search.similar_to(v.vectors(), nearest, top=25).select("query_id", "id", "score")


@query("v5_every_item_as_query", ("vectors",), """
    select q.id as query_id, v.id, round(list_inner_product(v.embedding, q.embedding), 6) as score
    from vectors v, vectors q
    qualify row_number() over (partition by q.id order by round(list_inner_product(v.embedding, q.embedding), 6) desc, v.id) <= 3""")
def v5(v: Views):
    """Blocked scoring of a query set as large as the catalogue."""
    queries = v.vectors().select(
        F.col("id").alias("query_id"), F.lit(0).alias("view_id"), F.col("embedding").alias("qv")
    )
    return search.knn(v.vectors(), queries, 3).select("query_id", "id", "score")


@query("o4_ranked_results", ("vectors", "view_queries"), _POOLED.format(depth=1000) + """
    select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as position
    from p qualify position <= 10""")
def o4(v: Views):
    found = search.with_position(search.search(v.vectors(), v.view_queries(), top=10))
    return found.select("query_id", "id", "score", "position")


@query("a6_centroids", (), """
    with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
    m as (select label, i, avg(x) as x from e group by all),
    n as (select label, sqrt(sum(x * x)) as len from m group by all)
    select label, i::int as i, round(x / len, 6) as x from m join n using (label)""")
def a6(v: Views):
    mean = pooling.centroid(v.table("embeddings"), ["label"])
    return mean.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("x13_union_of_views", ("vectors",), """
    with u as (select label, embedding as v from vectors union all select label, companion from vectors where companion is not null),
    e as (select label, unnest(v) as x, generate_subscripts(v, 1) - 1 as i from u),
    m as (select label, i, avg(x) as x from e group by all),
    n as (select label, sqrt(sum(x * x)) as len from m group by all)
    select label, i::int as i, round(x / len, 6) as x from m join n using (label)""")
def x13(v: Views):
    items = v.vectors()
    views = pooling.union_views(
        items.select("label", F.col("embedding").alias("v")),
        items.where("companion is not null").select("label", F.col("companion").alias("v")),
    )
    mean = pooling.centroid(views, ["label"], "v")
    return mean.select("label", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("s4_vector_codec", (), """
    select vec_id, len(embedding)::int as n, (len(embedding) * 4)::int as bytes,
           round(list_sum(embedding::double[]), 6) as total, embedding[1]::double as first
    from embeddings""")
def s4(v: Views):
    blobs = V.encode_vectors(v.table("embeddings").select("vec_id", "embedding"), "embedding").drop("embedding")
    back = V.decode_vectors(blobs, "blob", "vector")
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    return back.select(
        "vec_id",
        F.size("vector").alias("n"),
        F.octet_length("blob").alias("bytes"),
        F.round(total, 6).alias("total"),
        F.col("vector")[0].cast("double").alias("first"),
    )


@query("f6_dot", ("vectors",), """
    select id, coalesce(round(list_sum(list_transform(list_zip(embedding, companion), lambda z: z[1] * z[2])), 6), 0.0) as folded,
           0.0::double as unequal
    from vectors""")
def f6(v: Views):
    cut = F.slice("companion", 1, F.size("companion") - 1)
    return v.vectors().select(
        "id",
        F.round(V.dot("embedding", "companion"), 6).alias("folded"),
        V.dot("embedding", cut).alias("unequal"),
    )


@query("f7_l2_normalize", ("vectors",), """
    with e as (select id, unnest(embedding) * 3 + 0.25 as x, generate_subscripts(embedding, 1) as i from vectors),
    n as (select id, sqrt(sum(x * x)) as len from e group by id)
    select id, round(sum(x / len), 6) as total, round(max(x / len), 6) as top,
           0.0::double as zero
    from e join n using (id) group by id""")
def f7(v: Views):
    moved = F.transform("embedding", lambda x: x.cast("double") * 3 + 0.25)
    zeros = F.transform("embedding", lambda x: F.lit(0.0))
    return v.vectors().select("id", V.l2_normalize(moved).alias("u"), V.l2_normalize(zeros).alias("z")).select(
        "id",
        F.round(F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
        F.round(F.array_max("u"), 6).alias("top"),
        F.array_max("z").alias("zero"),
    )
