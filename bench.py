"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadlake.operators import search
from threadlake.plans import QUERIES
from threadlake.plans.views import Views
from threadlake.session import get_spark

HEADLINE = (
    "v1_knn",
    "v2_multiview_search",
    "v3_dual_vector_search",
    "v5_every_item_as_query",
    "a6_centroids",
    "e2_evaluate",
    "j1_containment_join",
    "j2_recount_folders",
    "j3_deepest_root",
    "j6_unchanged_files",
    "f5_content_id",
    "t6_scan_outcomes",
    "x1_upsert",
    "x5_apply_moves",
    "x10_dedupe_strict",
    "x6_upsert_folders",
    "t2_debounce",
    "t5_rename_cleanup",
    "t9_stalled",
    "w6_segments",
    "a16_color_profile",
    "u1_embed",
    "u5_companion_vectors",
)


def one_query(spark, sf_dir: str) -> float:
    """Latency of one search with five views over a catalogue held in memory."""
    views = Views(spark, sf_dir)
    catalog = views.vectors().cache()
    catalog.count()
    vectors = views.view_queries().where("query_id = 0").collect()
    query = spark.createDataFrame(vectors, "query_id long, view_id long, qv array<double>")
    best = None
    for _ in range(4):
        start = time.perf_counter()
        search.search(catalog, query, top=10).collect()
        took = time.perf_counter() - start
        best = took if best is None else min(best, took)
    catalog.unpersist()
    return best


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        best = None
        # first run warms code generation and Python workers
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    if not only or "search_one_query" in only:
        times["search_one_query"] = round(one_query(spark, sf_dir), 3)
    items = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {}
    for name, work in (
        ("v5_every_item_as_query", items * items),
        ("v2_multiview_search", 50 * items),
        ("j1_containment_join", files),
        ("x1_upsert", files),
        ("t2_debounce", events),
        ("w6_segments", events),
    ):
        if name in times:
            rates[name] = round(work / times[name])
    print(
        json.dumps(
            {
                "metric": "headline queries, best of 3, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
