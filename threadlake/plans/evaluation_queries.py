"""Retrieval evaluation: J11, W2, W7, A7-A10, O7, E2-E5, S8, F9-F12, F14."""

import os

from pyspark.sql import functions as F

from threadlake.operators import companions
from threadlake.operators import evaluation as E
from threadlake.operators import search
from threadlake.session import shared_dir
from threadlake.sources import report

from .registry import query
from .views import Views


def _results(v: Views):
    found = search.search(v.vectors(), v.eval_queries(), top=10)
    return search.with_position(found)


def _rows(v: Views):
    return E.evaluate(v.vectors(), v.eval_queries(), v.truth(), top=10)


@query("e2_evaluate", ("eval_rows",), "select * from eval_rows")
def e2(v: Views):
    return _rows(v)


@query("j11_results_truth", ("found", "truth"), """
    select f.query_id, f.id, f.position from found f join truth t on f.query_id = t.query_id
      and regexp_extract(f.file_name, '\\((\\d+)\\)', 1) = t.num and lower(substr(f.file_name, 1, 1)) = lower(t.prefix)""")
def j11(v: Views):
    return E.join_truth(_results(v), v.truth()).select("query_id", "id", "position")


@query("w2_expected_rank", ("eval_rows",), "select query_id, num, rank from eval_rows")
def w2(v: Views):
    return E.expected_rank(_results(v), v.truth()).select("query_id", "num", "rank")


@query("w7_top_match", ("found",), "select query_id, file_name as top_match, score from found where position = 1")
def w7(v: Views):
    return E.top_match(_results(v))


_HITS = ", ".join(f"count(*) filter (rank <= {k}) as hits_{k}" for k in E.KS)


@query("a7_hits_at", ("eval_rows",), f"select count(*) as total, {_HITS} from eval_rows")
def a7(v: Views):
    return E.hits_at(_rows(v))


@query("a8_accuracy_by_slice", ("eval_rows",), f"""
    select case when grouping(ext) = 0 then 'ext' when grouping(num) = 0 then 'num' else 'overall' end as slice,
           coalesce(ext, num) as value, count(*) as total, {_HITS}
    from eval_rows group by grouping sets ((), (ext), (num))""")
def a8(v: Views):
    return E.accuracy_by(_rows(v))


@query("a9_false_positives", ("eval_rows",), """
    select top_match, count(*) as n from eval_rows where has_results and coalesce(rank, 0) <> 1 group by top_match""")
def a9(v: Views):
    return E.false_positives(_rows(v))


@query("o7_top_false_positives", ("eval_rows",), """
    select top_match, count(*) as n from eval_rows where has_results and coalesce(rank, 0) <> 1
    group by top_match order by n desc, top_match limit 5""")
def o7(v: Views):
    return E.false_positives(_rows(v), n=5)


_CLASSES = """
    with c as (select num, count(*) as total, count(*) filter (rank <= 1) as hits_1 from eval_rows group by num),
    k as (select *, case when hits_1 = total then 'perfect' when hits_1 > 0 then 'partial' else 'missed' end as class from c)"""


@query("a10_per_item_class", ("eval_rows",), _CLASSES + " select num, total, hits_1, class from k")
def a10(v: Views):
    return E.per_item_class(_rows(v))


@query("e3_summary", ("eval_rows",), _CLASSES + f""",
    h as (select count(*) as total, {_HITS} from eval_rows),
    s as (select *, hits_1 / greatest(total, 1) * 100.0::double as a1, hits_3 / greatest(total, 1) * 100.0::double as a3,
                 hits_5 / greatest(total, 1) * 100.0::double as a5, hits_10 / greatest(total, 1) * 100.0::double as a10 from h)
    select total, hits_1, hits_3, hits_5, hits_10, round(a1, 1) as at_1, round(a3, 1) as at_3, round(a5, 1) as at_5, round(a10, 1) as at_10,
           case when a10 = 100 and a5 = 100 and a1 >= 90 then 'EXCELLENT' when a10 >= 95 and a1 >= 80 then 'GOOD'
                when a10 >= 85 then 'ACCEPTABLE' else 'POOR' end as verdict,
           (select count(*) from k where class = 'perfect') as perfect,
           (select count(*) from k where class = 'partial') as partial,
           (select count(*) from k where class = 'missed') as missed
    from s""")
def e3(v: Views):
    return E.summarize(_rows(v))


@query("e4_failures", ("eval_rows",), "select query_id, expected from eval_rows where rank is null")
def e4(v: Views):
    return E.failures(_rows(v)).select("query_id", "expected")


@query("e5_gate", ("eval_rows",), "select count(*) filter (rank <= 10) = count(*) as passed from eval_rows")
def e5(v: Views):
    return E.gate(_rows(v))


@query("s8_report_details", ("eval_rows",), "select query_id, expected, num, rank, score, top_match from eval_rows")
def s8(v: Views):
    """Report written as JSON and its details read back."""
    path = os.path.join(shared_dir(v.spark), f"report-{os.urandom(4).hex()}")
    rows = _rows(v)
    report.write_report(rows, companions.inventory(v.items(), v.pictures()), path, dataset="embeddings", ts="-")
    schema = "query_id long, expected string, num string, rank long, score double, top_match string"
    return v.spark.read.schema(schema).json(os.path.join(path, "details"))


@query("s8_report_header", ("eval_rows", "items", "pictures"), """
    with i as (select file_path, regexp_extract(file_path, '^(.*)\\.[^.]*$', 1) as key from items),
    p as (select distinct regexp_extract(file_path, '^(.*)\\.[^.]*$', 1) as key from pictures
          where regexp_extract(file_path, '(\\.[^.]*)$', 1) in ('.jpg', '.JPG', '.jpeg', '.JPEG', '.png', '.PNG'))
    select (select count(*) from i) as total_emb, (select count(*) from i where key in (select key from p)) as paired_emb,
           count(*) as total_queries, round(count(*) filter (rank <= 1) / count(*) * 100.0::double, 1) as at_1,
           round(count(*) filter (rank <= 10) / count(*) * 100.0::double, 1) as at_10,
           count(*) filter (ext = '.jpg' and rank <= 3) as jpg_hits_3
    from eval_rows""")
def s8_header(v: Views):
    header = report.report_header(_rows(v), companions.inventory(v.items(), v.pictures()), "embeddings", "-")
    return header.select(
        "total_emb", "paired_emb", "total_queries",
        F.col("accuracy")["@1"].alias("at_1"), F.col("accuracy")["@10"].alias("at_10"),
        F.col("by_format")[".jpg"]["hits_3"].alias("jpg_hits_3"),
    )
