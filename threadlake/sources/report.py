"""Evaluation report (S8) as a folder of JSON tables.

The header is one document; queries, failures and false positives are JSON lines beside
it, so the report of any number of queries is written by all tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators import evaluation as E


def report_header(rows: DataFrame, inventory: DataFrame, dataset: str, ts: str) -> DataFrame:
    """One row: totals, accuracy per cut-off and hits per format."""
    ks = E.KS
    hits = [f"hits_{k}" for k in ks]
    # extensions are a closed list, so the array behind the map is short
    total = (
        rows.groupBy("ext")
        .agg(F.count(F.lit(1)).alias("total"), *E._hits(ks))
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("ext", F.struct("total", *hits)))
            ).alias("by_format"),
            F.coalesce(F.sum("total"), F.lit(0)).alias("total_queries"),
            *[F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in hits],
        )
    )
    accuracy = F.create_map(
        *[
            part
            for k in ks
            for part in (
                F.lit(f"@{k}"),
                F.bround(F.col(f"hits_{k}") / F.greatest("total_queries", F.lit(1)) * 100.0, 1),
            )
        ]
    )
    items = inventory.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if("paired").alias("paired")).alias("i")
    )
    return total.select(
        F.lit(ts).alias("timestamp"),
        F.lit(dataset).alias("dataset"),
        "total_queries",
        accuracy.alias("accuracy"),
        "by_format",
        items.scalar().alias("i"),
    ).select("*", F.col("i.n").alias("total_emb"), F.col("i.paired").alias("paired_emb")).drop("i")


def write_report(
    rows: DataFrame, inventory: DataFrame, path: str, dataset: str = "", ts: str = ""
) -> None:
    """Header, details, failures and false positives below ``path``."""
    parts = {
        "header": report_header(rows, inventory, dataset, ts),
        "details": rows,
        "failures": E.failures(rows),
        "false_positives": E.false_positives(rows),
    }
    for name, part in parts.items():
        part.write.mode("overwrite").json(os.path.join(path, name))
