"""Exhaustive vector search.

The catalogue is scanned once, in place. Each task multiplies its vectors with the
query matrix in Arrow batches and keeps a running top-k per query view; only those
candidates are shuffled, to be cut again per (query, view). Nothing the size of
"queries x items" is ever built. A small query set is broadcast. A larger one never passes through
the driver: it is written to the shared folder in blocks, and each task scores its vectors, a
chunk at a time, against every block it reads from there, so the catalogue is still read once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from threadlake.operators.ordered import top_k
from threadlake.session import salt_count, shared_dir, stage
from threadlake.sources.files import open_store

# Candidates one task may hold over all queries of a block (about 24 bytes each).
HELD_CANDIDATES = 8_000_000
# Query views that are broadcast, and their size; larger sets are written in blocks.
BROADCAST_VIEWS = 2_000
# Query views of a block, and bytes of its matrix.
BLOCK_QUERIES = 4_000
BLOCK_BYTES = 64 * 1024 * 1024
# Bytes of vectors and attributes a task scores against one block after the other.
CHUNK_BYTES = 64 * 1024 * 1024
# Scores computed at a time.
CELLS = 4_000_000
# Rows of one batch a task hands on.
OUT_ROWS = 65_536


def _matrix(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Lengths of the vectors of a batch, and one float64 matrix per length."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    dims = np.unique(sizes[sizes > 0])
    if len(dims) == 1:
        return sizes, {int(dims[0]): flat.reshape(-1, dims[0])}
    owner = np.repeat(sizes, sizes)
    return sizes, {int(d): flat[owner == d].reshape(-1, d) for d in dims}


def _scores(column: pa.Array, queries: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Dot products (queries x rows); 0 where the lengths differ."""
    sizes, mats = _matrix(column)
    if len(queries) == 1 and len(mats) == 1:
        (dim, (at, q)), (own, rows) = *queries.items(), *mats.items()
        if dim == own and len(at) == n and len(rows) == len(column):
            return q @ rows.T
    out = np.zeros((n, len(column)))
    for dim, (at, q) in queries.items():
        if dim in mats:
            out[np.ix_(at, sizes == dim)] = q @ mats[dim].T
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score desc, id asc), ties cut by id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _candidates(catalog: DataFrame, blocks, keys, qvec: str, k: int, id_col: str, keep, vec: str, companion, digits, out):
    """Per task: the k best rows for each query view of each block; ``blocks`` is a broadcast
    block, or the names of the files that hold one each."""

    def best_of(batches, block):
        owned, queries, n = block
        pool: list[pa.RecordBatch] = []
        base = 0
        held: list = [None] * n
        floors = np.full(n, -np.inf)

        def compact():
            nonlocal pool, base, held
            used = np.unique(np.concatenate([h[2] for h in held if h]))
            pool = pa.Table.from_batches(pool).take(pa.array(used)).combine_chunks().to_batches()
            base = len(used)
            held = [h and (h[0], h[1], np.searchsorted(used, h[2])) for h in held]

        step = max(1, CELLS // max(1, n))
        for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            score = _scores(batch.column(vec), queries, n)
            if companion:
                other = batch.column(companion)
                second = _scores(other, queries, n)
                has = other.is_valid().to_numpy(zero_copy_only=False)
                score[:, has] = np.maximum(score[:, has], second[:, has])
            if digits is not None:
                score = np.round(score, digits)
            # not a number never beats anything
            score = np.where(np.isnan(score), -np.inf, score)
            ids = batch.column(id_col).to_numpy(zero_copy_only=False)
            picked = []
            for q in range(n):
                at = np.flatnonzero(score[q] >= floors[q])
                if len(at) > k:
                    at = at[_best(score[q, at], ids[at], k)]
                picked.append(at)
            rows = np.unique(np.concatenate(picked)) if picked else np.empty(0, "int64")
            if len(rows) == 0:
                continue
            pool.append(batch.select([id_col, *keep]).take(pa.array(rows)))
            for q, at in enumerate(picked):
                if len(at) == 0:
                    continue
                s, i, r = score[q, at], ids[at], base + np.searchsorted(rows, at)
                if held[q]:
                    s, i, r = (np.concatenate(pair) for pair in zip(held[q], (s, i, r)))
                if len(s) > k:
                    top = _best(s, i, k)
                    s, i, r = s[top], i[top], r[top]
                if len(s) == k:
                    floors[q] = s.min()
                held[q] = (s, i, r)
            base += len(rows)
            if base > 4 * sum(len(h[0]) for h in held if h) + 100_000:
                compact()

        if not pool:
            return
        table = pa.Table.from_batches(pool).combine_chunks()
        owners = [pa.array(key, t) for key, t in owned]
        full = [q for q in range(n) if held[q]]
        # several views per batch, up to OUT_ROWS rows
        start = 0
        while start < len(full):
            stop, size = start, 0
            while stop < len(full) and (stop == start or size + len(held[full[stop]][0]) <= OUT_ROWS):
                size += len(held[full[stop]][0])
                stop += 1
            part = [held[q] for q in full[start:stop]]
            owner = pa.array(np.repeat(full[start:stop], [len(h[0]) for h in part]))
            rows = table.take(pa.array(np.concatenate([h[2] for h in part]))).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    *[o.take(owner) for o in owners],
                    *[rows.column(c).chunk(0) for c in (id_col, *keep)],
                    pa.array(np.concatenate([h[0] for h in part])),
                ],
                names=out.names,
            )
            start = stop

    def run(batches):
        if not isinstance(blocks, list):
            yield from best_of(batches, blocks.value)
            return
        chunk, size = [], 0
        for batch in batches:
            chunk.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                for name in blocks:
                    yield from best_of(chunk, _read_block(name, keys, qvec))
                chunk, size = [], 0
        for name in blocks if chunk else ():
            yield from best_of(chunk, _read_block(name, keys, qvec))

    return catalog.mapInArrow(run, out)


def _pack(table: pa.Table, key_cols: Sequence[str], vec: str):
    """Keys and per-length matrices of one bounded block of queries."""
    keys = [(table.column(c).to_pylist(), table.schema.field(c).type) for c in key_cols]
    column = pa.concat_arrays(table.column(vec).chunks) if table.num_rows else pa.array([], pa.list_(pa.float32()))
    sizes, mats = _matrix(column)
    return keys, {d: (np.flatnonzero(sizes == d), m) for d, m in mats.items()}, table.num_rows


def _read_block(name: str, keys: Sequence[str], vec: str):
    system, inner = open_store(name)
    with system.open_input_file(inner) as source:
        return _pack(pq.read_table(source, columns=[*keys, vec]), keys, vec)


def _small_set(queries: DataFrame, k: int) -> pa.Table | None:
    """The queries if they are few enough to be broadcast: one bounded read."""
    rows = max(1, min(BROADCAST_VIEWS, HELD_CANDIDATES // k))
    first = queries.limit(rows + 1).toArrow()
    return first if first.num_rows <= rows and first.nbytes <= BLOCK_BYTES else None


def _block_files(queries: DataFrame, keys: Sequence[str], vec: str, k: int) -> list[str]:
    """The queries as files in the shared folder, each of a block within the bounds. The driver
    knows their number, their width and the names of the files."""
    staged = stage(queries, "queries")
    size = staged.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dims")).first()
    rows = max(1, min(BLOCK_QUERIES, HELD_CANDIDATES // k, BLOCK_BYTES // (8 * max(1, size.dims or 1))))
    path = f"{shared_dir(queries.sparkSession)}/query-blocks-{uuid.uuid4().hex}"
    spread = staged.repartition(max(1, -(-size.n // rows)), F.xxhash64(*keys))
    spread.write.option("maxRecordsPerFile", rows).parquet(path)
    return sorted(queries.sparkSession.read.schema(queries.schema).parquet(path).inputFiles())


def knn(
    catalog: DataFrame,
    queries: DataFrame,
    k: int,
    fmt: str | None = None,
    vec: str = "embedding",
    id_col: str = "id",
    keep: Sequence[str] = (),
    companion: str | None = None,
    digits: int | None = 6,
    qvec: str = "qv",
    keys: Sequence[str] = ("query_id", "view_id"),
    cluster: Sequence[str] | None = None,
) -> DataFrame:
    """V1 / V5: the ``k`` best items for each query view, by dot product.

    ``fmt`` keeps one format before scoring (any letter case); vectors of another
    length score 0; ``companion`` names a second vector column whose score counts
    if higher (V3). Scores are rounded to ``digits`` and ties go to the smaller id,
    so the result does not depend on how the catalogue is partitioned. ``cluster`` is
    handed to ``top_k``.
    """
    keys = list(keys)
    pool = catalog
    if fmt is not None:
        pool = pool.where(F.lower("format") == fmt.lower())
    columns = list(dict.fromkeys([id_col, *keep, vec, *([companion] if companion else [])]))
    pool = pool.select(*columns)
    keep = [c for c in keep if c != id_col]
    out = StructType(
        [queries.schema[c] for c in keys]
        + [catalog.schema[c] for c in (id_col, *keep)]
        + [StructField("score", DoubleType())]
    )
    queries = queries.select(*keys, qvec)
    table = _small_set(queries, k)
    if table is not None:
        blocks = catalog.sparkSession.sparkContext.broadcast(_pack(table, keys, qvec))
    else:
        blocks = _block_files(queries, keys, qvec, k)
    found = _candidates(pool, blocks, keys, qvec, k, id_col, keep, vec, companion, digits, out)
    return top_k(
        found,
        keys,
        [F.desc("score"), F.asc(id_col)],
        k,
        spread=F.col(id_col),
        salts=salt_count(pool, k),
        cluster=cluster,
    )


def search(
    catalog: DataFrame,
    queries: DataFrame,
    top: int = 100,
    depth: int = 1000,
    fmt: str | None = "emb",
    vec: str = "embedding",
    id_col: str = "id",
    keep: Sequence[str] = ("file_path", "file_name", "format", "size_kb", "has_preview"),
    dual: str | None = None,
    preview_only: bool = True,
    digits: int | None = 6,
) -> DataFrame:
    """V2: multi-view search.

    Each view is cut at ``depth`` before items without a preview are dropped; an
    item's score is its best view; scores that are not positive vanish; the best
    ``top`` items per query remain. ``dual`` names a companion vector column (V3).
    """
    keep = list(keep)
    # one shuffle, by query: the cut per view, the pooling and the ranking all fit on it
    hits = knn(
        catalog, queries, depth, fmt, vec, id_col, keep, companion=dual, digits=digits, cluster=["query_id"]
    )
    if preview_only:
        hits = hits.where("has_preview")
    # attributes depend on the id, so pooling needs no join back to the catalogue
    pooled = (
        hits.groupBy("query_id", id_col)
        .agg(F.max("score").alias("score"), *[F.first(c).alias(c) for c in keep])
        .where("score > 0")
    )
    ranked = top_k(pooled, ["query_id"], [F.desc("score"), F.asc(id_col)], top)
    return ranked.select("query_id", id_col, *keep, "score")


def similar_to(
    catalog: DataFrame,
    ids: DataFrame,
    top: int = 100,
    vec: str = "embedding",
    id_col: str = "id",
    **options,
) -> DataFrame:
    """V4: search by items already in the catalogue (``ids`` has the id column)."""
    wanted = ids.select(id_col).distinct()
    queries = catalog.join(wanted, id_col, "left_semi").select(
        F.col(id_col).alias("query_id"), F.lit(0).alias("view_id"), F.col(vec).alias("qv")
    )
    return search(catalog, queries, top, vec=vec, id_col=id_col, **options)


def to_results(df: DataFrame) -> DataFrame:
    """The published columns of a search result."""
    return df.select(
        "query_id", "id", "file_path", "file_name", "format", "size_kb", "score", "has_preview"
    )


def with_position(df: DataFrame, id_col: str = "id") -> DataFrame:
    """1-based position of each result within its query; at most ``top`` rows per query."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return df.withColumn("position", F.row_number().over(w).cast("long"))
