"""Retrieval evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import scalars as S
from threadlake.operators.search import search, with_position

# Cut-offs of the accuracy table.
KS = (1, 3, 5, 10)


def _matched(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results with the truth of their query and whether they are the expected item."""
    wanted = truth.select(
        "query_id", F.col("num").alias("_num"), F.lower("prefix").alias("_pfx")
    )
    same = (S.name_number("file_name") == F.col("_num")) & (
        F.lower(S.name_prefix("file_name")) == F.col("_pfx")
    )
    return results.join(wanted, "query_id").withColumn("_match", F.coalesce(same, F.lit(False)))


def join_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results whose (number, first letter ignoring case) match the expected item."""
    return _matched(results, truth).where("_match").select(*results.columns)


def expected_rank(results: DataFrame, truth: DataFrame) -> DataFrame:
    """1-based rank of the first matching result per query, null if absent."""
    best = join_truth(results, truth).groupBy("query_id").agg(F.min("position").alias("rank"))
    return truth.join(best, "query_id", "left")


def top_match(results: DataFrame) -> DataFrame:
    """Name and score of the first result per query (queries with results only)."""
    return results.where("position = 1").select(
        "query_id", F.col("file_name").alias("top_match"), F.col("score")
    )


def score_results(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Evaluation rows: rank, top score (0.0 if no result) and top match ('?').

    Rank and top match come from one aggregate, so the search behind ``results`` runs once.
    """
    per_query = (
        _matched(results, truth)
        .groupBy("query_id")
        .agg(
            F.min(F.when(F.col("_match"), F.col("position"))).alias("rank"),
            F.min_by("score", "position").alias("_score"),
            F.min_by("file_name", "position").alias("_top"),
        )
    )
    return truth.join(per_query, "query_id", "left").select(
        *truth.columns,
        "rank",
        F.coalesce("_score", F.lit(0.0)).alias("score"),
        F.coalesce("_top", F.lit("?")).alias("top_match"),
        F.col("_score").isNotNull().alias("has_results"),
    )


def evaluate(
    catalog: DataFrame, queries: DataFrame, truth: DataFrame, top: int = 10, **options
) -> DataFrame:
    """Search all queries in one job and score them against the truth
    (query_id, expected, num, prefix, ext)."""
    results = with_position(search(catalog, queries, top, **options))
    return score_results(results, truth)


def _hits(ks: Sequence[int]):
    return [F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks]


def hits_at(rows: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Number of queries and hits within each cut-off."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *_hits(ks))


def accuracy_by(
    rows: DataFrame, slices: Sequence[str] = ("ext", "num"), ks: Sequence[int] = KS
) -> DataFrame:
    """The same overall and for each slice column, in one aggregation."""
    cols = [F.col(c) for c in slices]
    sets = [[], *[[c] for c in cols]]
    width = len(slices)
    counted = rows.groupingSets(sets, *cols).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("total"), *_hits(ks)
    )
    label = F.lit("overall")
    value = F.lit(None).cast("string")
    for i, c in enumerate(slices):
        alone = F.col("_gid") == (2**width - 1) - 2 ** (width - 1 - i)
        label = F.when(alone, F.lit(c)).otherwise(label)
        value = F.when(alone, F.col(c).cast("string")).otherwise(value)
    return counted.select(
        label.alias("slice"), value.alias("value"), "total", *[f"hits_{k}" for k in ks]
    )


def false_positives(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Wrong first results (also when the expected item is absent), counted."""
    wrong = rows.where(F.col("has_results") & (F.coalesce("rank", F.lit(0)) != 1))
    counts = wrong.groupBy("top_match").agg(F.count(F.lit(1)).alias("n"))
    if n is None:
        return counts
    return counts.orderBy(F.desc("n"), F.asc("top_match")).limit(n)


def per_item_class(rows: DataFrame, ks: Sequence[int] = (1,)) -> DataFrame:
    """A10: each number is perfect, partial or missed at rank 1."""
    return (
        rows.groupBy("num")
        .agg(F.count(F.lit(1)).alias("total"), *_hits(ks))
        .withColumn(
            "class",
            F.when(F.col("hits_1") == F.col("total"), "perfect")
            .when(F.col("hits_1") > 0, "partial")
            .otherwise("missed"),
        )
    )


def summarize(rows: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Totals, accuracy in percent, verdict and the sizes of the three classes.

    The totals are sums over the per-number rows, so the evaluation runs once.
    """
    names = ["total", *[f"hits_{k}" for k in ks]]
    report = per_item_class(rows, ks).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        *[F.count_if(F.col("class") == c).alias(c) for c in ("perfect", "partial", "missed")],
    )
    share = {k: F.col(f"hits_{k}") / F.greatest(F.col("total"), F.lit(1)) * 100.0 for k in ks}
    return report.select(
        *names,
        *[F.round(share[k], 1).alias(f"at_{k}") for k in ks],
        S.verdict(share[1], share[5], share[10]).alias("verdict"),
        "perfect",
        "partial",
        "missed",
    )


def failures(rows: DataFrame) -> DataFrame:
    """Queries whose expected item is not among the results."""
    return rows.where("rank is null")


def gate(rows: DataFrame, top: int = 10) -> DataFrame:
    """E5: every expected item is within ``top``."""
    return rows.agg(
        (F.count_if(F.col("rank") <= top) == F.count(F.lit(1))).alias("passed")
    )
