"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit for each bit of a 64-bit hash: 1 if more than half of the
hashes of its word shingles (repeats included) have it. Documents whose fingerprints differ in
at most ``RADIUS`` bits are linked.

Distinct fingerprints are sorted by their population count, then by the counts of their four
quarters, and packed into blocks of about ``BLOCK``. Two fingerprints differ in at least as many
bits as their population counts do, and in at least the sum of the differences of the quarters'
counts. So pairs of blocks, and within them pairs of tiles of ``TILE`` fingerprints, whose ranges
of counts lie further apart than the radius are skipped; all others are compared in full with
exclusive-or and bit counts. A pair of blocks hands on a spanning forest of its links, so large
groups cost a row per member and no link is lost. The work that remains grows with the square
of the number of distinct fingerprints, with the factor the skipping leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import stage, staging

from .common import table
from .graph import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCK = 32_768  # fingerprints of a block: 256 KB
TILE = 256
STRIDE = 65_536  # shingles whose bits are counted at a time
QUARTERS = [0xFFFF << s for s in (0, 16, 32, 48)]


def fingerprint(text: bytes | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a whole text; bytes.lower() and bytes.split() know A-Z and the
    six ASCII space characters only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(n, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), STRIDE):
        part = zip(starts[lo : lo + STRIDE].tolist(), ends[lo : lo + STRIDE].tolist())
        hashes = np.array([digest(flat[a:b], seed) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``_fp`` (the fingerprint's bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), n, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "_fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, _fp long")


def _blocks(prints: DataFrame, rows: int, block: int) -> DataFrame:
    """Sorted blocks of distinct fingerprints: ``block`` (ascending in the order), least and
    greatest counts of the whole and of the quarters, ``_data``."""
    signed = [q - (1 << 64) if q >> 63 else q for q in QUARTERS]
    counts = [F.bit_count("_fp")] + [F.bit_count(F.col("_fp").bitwiseAND(F.lit(q).cast("long"))) for q in signed]
    keys = [c.cast("int").alias(f"_c{i}") for i, c in enumerate(counts)]
    names = [f"_c{i}" for i in range(5)]
    spread = prints.select("_fp", *keys).repartitionByRange(-(-rows // block), *names, "_fp").sortWithinPartitions(*names, "_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, count, made = [], 0, TaskContext.get().partitionId() << 32

        def packed(whole: np.ndarray) -> pa.RecordBatch:
            least, most = whole[1:].min(axis=1), whole[1:].max(axis=1)
            row = {"block": [made], "_lo": [least.tolist()], "_hi": [most.tolist()], "_data": [whole[0].tobytes()]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("block", pa.int64()), ("_lo", pa.list_(pa.int32())), ("_hi", pa.list_(pa.int32())), ("_data", pa.binary())]))

        for b in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in b.columns]))
            count += b.num_rows
            while count >= 2 * block:
                whole = np.concatenate(held, axis=1)
                yield packed(whole[:, :block])
                held, count, made = [whole[:, block:]], count - block, made + 1
        if count:
            yield packed(np.concatenate(held, axis=1))

    return spread.mapInArrow(run, "block long, _lo array<int>, _hi array<int>, _data binary")


def _distance(lo1, hi1, lo2, hi2) -> np.ndarray:
    """Least sum of differences between counts of tiles, for every pair of tiles."""
    gap = np.maximum(lo1[:, None] - hi2[None], lo2[None] - hi1[:, None])
    return np.maximum(gap, 0).sum(axis=2)


def tile_links(one: np.ndarray, two: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of fingerprints, of the links within ``one``, or between
    ``one`` and ``two``. Both are sorted as blocks are."""
    base = 0 if two is None else len(one)
    every = one if two is None else np.concatenate((one, two))
    above = list(range(len(every)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def ranges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = np.stack([np.bitwise_count(x & np.uint64(m)) for m in QUARTERS], axis=1).astype(np.int16)
        at = np.arange(0, len(x), tile)
        return np.minimum.reduceat(q, at, axis=0), np.maximum.reduceat(q, at, axis=0)

    lo1, hi1 = ranges(one)
    lo2, hi2 = (lo1, hi1) if two is None else ranges(two)
    near = _distance(lo1, hi1, lo2, hi2) <= radius
    if two is None:
        near = np.triu(near)
    other = one if two is None else two
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        left, right = one[i * tile : (i + 1) * tile], other[j * tile : (j + 1) * tile]
        close = np.bitwise_count(left[:, None] ^ right[None]) <= radius
        if two is None and i == j:
            close = np.triu(close, 1)
        a, b = np.nonzero(close)
        if not len(a):
            continue
        a, b = a + i * tile, b + j * tile + base
        if len(a) > 2 * tile:
            a, b = _forest(a, b)
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                above[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(every))])
    child = np.flatnonzero(roots != np.arange(len(every)))
    return every[child], every[roots[child]]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b between numbered nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        after = least.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == least).all():
            return nodes, nodes[least]
        least = after


def _edges(blocks: DataFrame, radius: int, tile: int) -> DataFrame:
    """Links (a, b) that connect all components, from the pairs of blocks that may hold links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two in zip(b.column(0), b.column(1)):
                left = np.frombuffer(one.as_py(), "<u8")
                right = np.frombuffer(two.as_py(), "<u8") if two.is_valid else None
                x, y = tile_links(left, right, radius, tile)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    # blocks ascend in the count of the whole, so a block's partners start between its own
    # least count and its greatest plus the radius
    bounds = blocks.select("block", "_lo", "_hi")
    left = bounds.select(F.col("block").alias("_i"), F.col("_lo").alias("_ilo"), F.col("_hi").alias("_ihi"), F.explode(F.sequence(F.col("_lo")[0], F.col("_hi")[0] + radius)).alias("_p"))
    right = bounds.select(F.col("block").alias("_j"), "_lo", "_hi", F.col("_lo")[0].alias("_p"))
    gap = F.expr("aggregate(sequence(1, 4), 0, (s, q) -> s + greatest(0, _ilo[q] - _hi[q], _lo[q] - _ihi[q]))")
    pairs = left.join(right, "_p").where("_i <= _j").where(gap <= radius).select("_i", "_j")
    first = blocks.select(F.col("block").alias("_i"), F.col("_data").alias("_one"))
    second = blocks.select(F.col("block").alias("_j"), F.col("_data").alias("_two"))
    tasks = pairs.join(first, "_i").join(second, "_j").select("_one", F.when(F.col("_i") != F.col("_j"), F.col("_two")).alias("_two"), "_i", "_j")
    return tasks.repartition(F.xxhash64("_i", "_j")).select("_one", "_two").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (the smallest
    doc_id reachable over links, itself included) for each row of ``docs``; other columns are
    ignored.

    Null, empty and wordless texts have fingerprint zero and are linked like any other; texts of
    fewer than ``n`` words are one shingle. Repeated rows are returned each. A null doc_id is
    returned as such and counts as no smallest one: the component_id of a group without any ids
    is null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with staging(spark) as folder:
        rows = stage(fingerprints(docs, n, seed), "fingerprints", folder)
        nodes = stage(rows.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "nodes", folder)
        count = nodes.count()
        if count:
            blocks = stage(_blocks(nodes, count, block), "blocks", folder)
            edges = stage(_edges(blocks, radius, tile), "links", folder)
            roots = components(edges, folder)
            nodes = nodes.join(roots.select(F.col("node").alias("_fp"), "root"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp"))
            # components of one fingerprint need no further join
            linked = roots.select(F.col("root").alias("_root")).distinct()
            least = nodes.join(linked, "_root", "left_semi").groupBy("_root").agg(F.min("_least").alias("_all"))
            nodes = nodes.join(least, "_root", "left").select("_fp", F.coalesce("_all", "_least").alias("component_id"))
        else:
            nodes = nodes.select("_fp", F.col("_least").alias("component_id"))
        digits = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
        return stage(rows.join(nodes, "_fp", "left").select("doc_id", digits, "component_id"), "simhash")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
