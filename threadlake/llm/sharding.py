"""Minimax contiguous sharding of atomic groups.

Rows with equal texts are one group that is never cut. Groups are ordered by their smallest
doc_id and cut into contiguous shards whose largest size is as small as possible: a binary
search over the capacity, each tried greedily. The search needs the places where a cut is
possible, the running sizes of all groups; the driver holds a table of at most about
``CELLS`` of them. Between two held places the others are unknown, which bounds the answer
from both sides; the stretches in which a cut of a capacity between the bounds can fall are
looked up in more detail until none is left unknown, so the cut is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.session import stage

from .common import table, whole

SHARDS = 16
CELLS = 50_000


class Cuts:
    """Known cut places 0 .. total and, for each stretch before the next, whether unknown
    ones lie inside."""

    def __init__(self, places: np.ndarray, open_: np.ndarray):
        self.places, self.open = places, open_

    def greedy(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """Ends of the first ``shards`` shards, each as full as possible; None if that is not
        all. ``hopeful``: a cut may lie anywhere in an open stretch, else nowhere."""
        at, ends, total = 0, [], int(self.places[-1])
        for _ in range(shards):
            reach = at + capacity
            i = int(np.searchsorted(self.places, reach, side="right")) - 1
            to = int(self.places[i])
            if hopeful and i < len(self.open) and self.open[i]:
                to = reach
            if to <= at and at < total:
                return None
            ends.append(min(to, total))
            at = ends[-1]
            if at >= total:
                return ends
        return None

    def least(self, shards: int, hopeful: bool) -> int:
        """Binary search for the smallest feasible capacity."""
        lo, hi = -(-int(self.places[-1]) // shards), int(self.places[-1])
        while lo < hi:
            mid = (lo + hi) // 2
            if self.greedy(mid, shards, hopeful) is None:
                lo = mid + 1
            else:
                hi = mid
        return lo


def prefix(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` in a global order with the running total before each row, ``sums`` naming
    the summed column of each new one. Range partitions are summed on their own; only one
    row per partition meets on the driver."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged, name)
    parts = ranged.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).orderBy("_part").collect()
    base, at = [], dict.fromkeys(sums, 0)
    for p in parts:
        base.append((p["_part"], *at.values()))
        at = {k: at[k] + p[k] for k in at}
    spark = rows.sparkSession
    bases = spark.createDataFrame(base, ", ".join(["_part int", *(f"_base_{k} long" for k in sums)]))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(bases), "_part")
    running = [(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_base_{k}")).alias(k) for k, c in sums.items()]
    return out.select(*rows.columns, *running)


def find_cuts(groups: DataFrame, total: int, shards: int) -> list[int]:
    """Ends of the shards but the last, of groups (_at: running size, _size)."""
    places, open_ = np.array([0, total], dtype=np.int64), np.array([True])
    while True:
        cuts = Cuts(places, open_)
        low, high = cuts.least(shards, True), cuts.least(shards, False)
        first, last = cuts.greedy(low, shards, False) or [], cuts.greedy(high, shards, True)
        # the i-th end of any capacity between is never before what the smallest one reaches
        # without unknown cuts, and never after what the largest one reaches with them
        early = _floor(cuts, low, shards)
        wide = []
        for a, b in zip(early, last):
            i, j = np.searchsorted(places, [a, b], side="right") - 1
            wide += [x for x in range(max(i, 0), min(j, len(open_) - 1) + 1) if open_[x]]
        wide = sorted(set(wide))
        if not wide:
            return (cuts.greedy(high, shards, False) or [])[:-1] if total else []
        spans = merged([(int(places[i]), int(places[i + 1])) for i in wide])
        step = max(1, sum(b - a for a, b in spans) // CELLS)
        span = F.lit(None).cast("long")  # where the stretch starts; at most one per shard
        for a, b in spans:
            span = F.when((F.col("_at") >= a) & (F.col("_at") < b), F.lit(a)).otherwise(span)
        found = (
            groups.select("_at", span.alias("_span"))
            .where("_span is not null")
            .groupBy("_span", F.floor((F.col("_at") - F.col("_span")) / step).alias("_cell"))
            .agg(F.min("_at").alias("a"), F.max("_at").alias("z"), F.count("*").alias("n"))
            .collect()
        )
        # in a cell the first and the last place are known, and open between them
        new = sorted({p for r in found for p in (r["a"], r["z"])})
        loose = {r["a"] for r in found if r["n"] > 2}
        closed = [int(p) for i, p in enumerate(places[:-1]) if i not in set(wide)]
        all_ = np.array(sorted({*closed, *new, 0, total}), dtype=np.int64)
        still = {int(p) for i, p in enumerate(places[:-1]) if open_[i] and i not in set(wide)}
        open_ = np.array([int(p) in loose or int(p) in still for p in all_[:-1]])
        places = all_


def _floor(cuts: Cuts, capacity: int, shards: int) -> list[int]:
    """Ends that every capacity from this one on reaches for sure, shard by shard."""
    at, ends = 0, []
    for _ in range(shards):
        i = int(np.searchsorted(cuts.places, at + capacity, side="right")) - 1
        at = max(at, int(cuts.places[i]))
        ends.append(at)
    return ends


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, size
    (UTF-8 bytes and 1), text_crc32, shard, slot (place within the shard, from 0, without
    gaps, ordered by group and then doc_id).

    Rows with equal texts stay together; null texts are one group apart from the empty one.
    A group larger than a fair share makes its shard larger; trailing shards may be empty,
    as they are for tables with fewer groups than shards. A null id sorts first.
    """
    text = whole("text").cast("binary")
    key = F.when(F.col("text").isNull(), F.lit("")).otherwise(F.md5(text)).alias("_key")
    rows = stage(docs.select("doc_id", F.length(text).cast("long").alias("_bytes"), F.crc32(text).alias("text_crc32"), key), "rows")
    rows = rows.select("doc_id", (F.col("_bytes") + 1).alias("size"), "text_crc32", "_key")
    groups = rows.groupBy("_key").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("_size"))
    groups = stage(prefix(groups, [F.col("_first"), F.col("_key")], {"_at": "_size"}, "groups"), "placed")
    total = groups.agg(F.sum("_size")).first()[0] or 0
    cuts = find_cuts(groups, total, shards) if total else []
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("_at") >= c).cast("int")
    placed = rows.join(groups.select("_key", "_at", shard.alias("shard")), "_key").withColumn("_one", F.lit(1))
    # a group may be a third of all rows: places are counted per range of (group, id)
    ranked = stage(prefix(placed, [F.col("_at"), F.col("doc_id"), F.rand(1)], {"_row": "_one"}, "ranked"), "numbered")
    starts = ranked.groupBy("shard").agg(F.min("_row").alias("_start"))  # one row per shard
    return ranked.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_start")).alias("slot"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
