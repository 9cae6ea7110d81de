"""Ordered per-key computations whose tasks never hold a whole key.

A plain window over a key sorts all rows of that key in one task. These helpers
cut each key into segments along the order, run the window inside a segment, and
carry one summary row per segment across, so a key with a third of all rows is
spread over as many tasks as it has segments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS = 1_000_000


def with_segment(df: DataFrame, order: Column | str, width: int = SEGMENT_ROWS) -> DataFrame:
    """Adds ``_seg``: the order value divided by the segment width."""
    order = F.col(order) if isinstance(order, str) else order
    return df.withColumn("_seg", F.floor(order / F.lit(width)).cast("long"))


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column] | None = None,
    previous: Mapping[str, Sequence[str]] | None = None,
    following: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Adds running sums and neighbouring rows per key; ``df`` carries ``_seg``.

    ``totals``: name -> value, its inclusive running sum. ``previous`` / ``following``:
    name -> columns, a struct of them from the row before / after, null at the ends.
    ``order`` is a total order within a key. All results share one window pass over the
    segments, one row of carry per segment, and one join back.
    """
    totals, previous, following = totals or {}, previous or {}, following or {}
    parts = [*keys, "_seg"]
    inside = Window.partitionBy(*parts).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_seg")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    local, edges, carry, final = {}, [], [], {}
    for name, value in totals.items():
        local[name] = F.sum(value).over(upto)
        edges.append(F.sum(value).alias(f"_e_{name}"))
        carry.append(F.coalesce(F.sum(f"_e_{name}").over(before), F.lit(0)).alias(f"_c_{name}"))
        final[name] = F.col(name) + F.col(f"_c_{name}")
    for step, pick, wanted in ((F.lag, F.max_by, previous), (F.lead, F.min_by, following)):
        for name, cols in wanted.items():
            local[name] = step(F.struct(*cols)).over(inside)
            edges.append(pick(F.struct(*cols), place).alias(f"_e_{name}"))
            carry.append(step(f"_e_{name}").over(across).alias(f"_c_{name}"))
            final[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))
    carried = df.groupBy(*parts).agg(*edges).select(*parts, *carry)
    joined = df.withColumns(local).join(carried, parts)
    return joined.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Column | None = None,
    salts: int = 1,
    cluster: Sequence[str] | None = None,
) -> DataFrame:
    """First ``k`` rows per key. With ``salts`` > 1 each key is cut first by a hash
    of ``spread``, so the last window sees at most ``salts * k`` rows of a key.

    ``cluster`` names some of the keys to partition by, so that later steps per those
    keys need no further shuffle.
    """
    if salts > 1 and spread is not None:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        local = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= k)
        df = df.drop("_rn", "_salt")
    if cluster:
        df = df.repartition(*cluster)
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= k).drop("_rn")


def keep_latest(df: DataFrame, key: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` per key.

    An aggregate, not a window: copies of a key are reduced before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
