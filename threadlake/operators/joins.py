"""Joins between a small batch and a large table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def left_lookup(batch: DataFrame, table: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """``batch`` left join ``table`` on ``key`` that does not shuffle the table for a
    broadcastable batch.

    A left join can only broadcast its right side, here the large one. The table is first
    cut to the batch's keys by a semi join, which may broadcast the batch; what is left
    is no larger than the batch.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return batch.join(table.join(batch.select(*keys), keys, "left_semi"), keys, "left")
