"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds the documents in blocks of similar size. A block is a table of bits: a column for
each document, a row for each position of a Bloom signature, stored row by row, so that the rows
of a term's positions, joined by *and*, are a bitmap of all documents of the block that may hold
it. A signature takes a term once for each level of its frequency (once, twice, 3-4, 5-8, ...),
so bitmaps overestimate the presence of a term and of its levels, and never miss one.

For an item, the weights of its terms summed over the bitmaps of a level, times what that level
adds to a score in a document of the given length, summed over the levels, bound each score from
above. The documents with the highest bounds are scored exactly from their texts; the k-th of
these scores excludes every document whose bound is lower, or equal with a larger id. All
documents that are left are scored exactly, from whole texts, in whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.session import stage, staging

from .common import small, table

TOP = 10
FIRST = 16  # documents an item is first scored on
PER_TERM = 16  # bits of a signature for each term and level
HASHES = 5
DOCS = 1024  # documents of a block
CELLS = 1 << 24  # bits of a block
HELD = 3_000_000  # positions of documents that wait for their block to fill
ITEMS = 256  # items that are searched for at once
TERM_BYTES = 1 << 20  # of their texts, unless a single one is longer
KNOWN_TERMS = 500_000
NO_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a whole text in order: bytes of letters, digits and all beyond ASCII, A-Z in
    lower case."""
    return (text or b"").translate(_LETTERS).split()


class TermHash(dict):
    def __missing__(self, term: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(term)
        if len(self) >= KNOWN_TERMS:
            self.clear()
        self[term] = h
        return h


def _level_hashes(hashes: np.ndarray, level: int) -> np.ndarray:
    h = hashes + np.uint64(level * int(_MIX) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Rows of a signature of ``bits`` rows, HASHES for each hash."""
    step = (h * _MIX) | np.uint64(1)
    every = h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return ((every >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def signature(counts: Counter, known: TermHash) -> tuple[np.ndarray, int]:
    """Hashes of a document's terms and levels, and its highest level."""
    hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
    times = np.fromiter(counts.values(), np.int64, len(counts))
    top = int(times.max() - 1).bit_length()
    return np.concatenate([_level_hashes(hashes[2 * times > 1 << level] if level else hashes, level) for level in range(top + 1)]), top


def _size_class(entries: int) -> int:
    return max(8, math.ceil(2 * math.log2(entries)))


def build_index(docs: DataFrame) -> DataFrame:
    """One row per block: ``bits`` (rows of its signatures), ``levels``, ``ids``, ``lens`` (terms
    of each document with repeats), ``rows`` (the table of bits), ``n`` and ``total`` (documents
    and their terms). Documents without terms are in no block."""
    schema = pa.schema([("bits", pa.int64()), ("levels", pa.int32()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("rows", pa.binary()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_, held = TermHash(), {}, 0

        def bits_of(kind: int) -> int:
            return int(PER_TERM * 2 ** (kind / 2)) + 8

        def flush(kind: int) -> pa.RecordBatch:
            docs, bits = open_.pop(kind), bits_of(kind)
            cells = np.zeros((bits, len(docs)), dtype=bool)
            for at, (_, _, hashes, _) in enumerate(docs):
                cells[_positions(hashes, bits).ravel(), at] = True
            packed = np.packbits(cells, axis=1, bitorder="little")
            lens = [d[1] for d in docs]
            row = {"bits": [bits], "levels": [max(d[3] for d in docs)], "ids": [[d[0] for d in docs]], "lens": [lens], "rows": [packed.tobytes()], "n": [len(docs)], "total": [sum(lens)]}
            return pa.RecordBatch.from_pydict(row, schema)

        for b in batches:
            for number, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                hashes, top = signature(Counter(words), known)
                kind = _size_class(len(hashes))
                mine = open_.setdefault(kind, [])
                mine.append((number, len(words), hashes, top))
                held += len(hashes)
                if len(mine) == DOCS or (len(mine) + 1) * bits_of(kind) > CELLS:
                    held -= sum(len(d[2]) for d in mine)
                    yield flush(kind)
                while held > HELD:
                    widest = max(open_, key=lambda k: sum(len(d[2]) for d in open_[k]))
                    held -= sum(len(d[2]) for d in open_[widest])
                    yield flush(widest)
        for kind in list(open_):
            yield flush(kind)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "bits long, levels int, ids array<long>, lens array<long>, rows binary, n long, total long")


def document_counts(docs: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each of a bounded list of terms."""
    every = frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for b in batches:
            for text in b.column(0):
                seen.update(every.intersection(terms_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "df"])

    found = docs.select(F.col("text").cast("binary")).mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in found.collect()}


class Plan:
    """A bounded block of items with the weights of their terms; numbers of the whole corpus."""

    def __init__(self, items: list[Counter], counts: dict[bytes, int], n: int, total: int):
        self.items, self.n, self.total = items, n, total
        self.terms = sorted({t for item in items for t in item})
        self.weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in self.terms}

    def m(self, length):
        return 25 + 75 * length * self.n // self.total

    def score(self, item: int, counts: Counter, length: int) -> int:
        m = 8 * self.m(length)
        found = ((t, times, counts[t]) for t, times in self.items[item].items() if t in counts)
        return sum(self.weight[t] * times * (1_000_000_000 * tf // (1000 * tf + m)) for t, times, tf in found)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the terms, and weight times repeats by item and term."""
        place = {t: i for i, t in enumerate(self.terms)}
        weights = np.zeros((len(self.items), len(self.terms)))
        for i, item in enumerate(self.items):
            for t, times in item.items():
                weights[i, place[t]] = times * self.weight[t]
        single = weights.sum(axis=1).max(initial=0) < 1 << 24  # sums are whole numbers, exact in either type
        return np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], dtype=np.uint64), weights.astype(np.float32 if single else np.float64)


def _bounds(plan: Plan, hashes: np.ndarray, weights: np.ndarray, bits: int, levels: int, lens: np.ndarray, rows: bytes) -> np.ndarray:
    """Upper bounds of the scores, by item and document of a block."""
    table, out = np.frombuffer(rows, np.uint8).reshape(bits, -1), np.zeros((len(plan.items), len(lens)), np.int64)
    m, before = 8 * plan.m(lens), 0
    for level in range(levels + 1):
        at = _positions(_level_hashes(hashes, level), bits)
        maps = table[at[:, 0]]
        for j in range(1, HASHES):
            maps &= table[at[:, j]]
        some = np.flatnonzero(maps.any(axis=1))
        now = 1_000_000_000 * (1 << level) // (1000 * (1 << level) + m)
        if len(some):
            present = np.unpackbits(maps[some], axis=1, count=len(lens), bitorder="little").astype(weights.dtype)
            out += (weights[:, some] @ present).astype(np.int64) * (now - before)
        before = now
    return out


def _numbers(ids: pa.ListScalar) -> np.ndarray:
    return ids.values.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _candidate_batch(items: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(items.astype(np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(bounds)], names=["item", "doc_id", "bound"])


def best_bounds(index: DataFrame, plan: Plan, k: int) -> DataFrame:
    """``item``, ``doc_id``, ``bound``: the ``k`` highest bounds of each item over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = plan.arrays()
        best, who = np.zeros((len(plan.items), 0), np.int64), np.zeros((len(plan.items), 0), np.int64)
        for b in batches:
            for bits, levels, ids, lens, rows in zip(*(b.column(i) for i in range(5))):
                found = _bounds(plan, hashes, weights, bits.as_py(), levels.as_py(), lens.values.to_numpy(), rows.as_py())
                best = np.concatenate((best, found), axis=1)
                who = np.concatenate((who, np.broadcast_to(_numbers(ids), found.shape)), axis=1)
                if best.shape[1] > k:
                    keep = np.argpartition(best, best.shape[1] - k, axis=1)[:, -k:]
                    best, who = np.take_along_axis(best, keep, axis=1), np.take_along_axis(who, keep, axis=1)
        i, j = np.nonzero(best)
        yield _candidate_batch(i, who[i, j], best[i, j])

    found = index.mapInArrow(run, "item int, doc_id long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def not_excluded(index: DataFrame, plan: Plan, floors: dict[int, tuple[int, int]]) -> DataFrame:
    """``item``, ``doc_id``, ``bound`` of every document that may be above an item's floor, a
    score and the id that has it, or equal to it; of all with a bound above 0 without a floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = plan.arrays()
        floor = np.array([floors.get(i, (0, -1)) for i in range(len(plan.items))], np.int64).reshape(-1, 2)
        for b in batches:
            for bits, levels, ids, lens, rows in zip(*(b.column(i) for i in range(5))):
                found, who = _bounds(plan, hashes, weights, bits.as_py(), levels.as_py(), lens.values.to_numpy(), rows.as_py()), _numbers(ids)
                score, last = floor[:, :1], floor[:, 1:]
                i, j = np.nonzero((found > score) | ((found == score) & (found > 0) & (who[None] <= last)))
                yield _candidate_batch(i, who[j], found[i, j])

    return index.mapInArrow(run, "item int, doc_id long, bound long")


def exact_scores(docs: DataFrame, candidates: DataFrame, plan: Plan) -> DataFrame:
    """``item``, ``doc_id``, ``score`` above 0 of the candidates (item, doc_id), from whole texts;
    a row for each row of ``docs`` with the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, text, items in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words = terms_of(text.as_py())
                counts = Counter(words)
                out += [(i, number, s) for i in items.as_py() if (s := plan.score(i, counts, len(words)))] if words else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    wanted = candidates.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("item").alias("_items"))
    size = candidates.agg(F.count("*").alias("n")).first().n
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    joined = texts.join(small(wanted, size), texts["doc_id"].eqNullSafe(wanted["_id"]))
    return joined.select("doc_id", "text", "_items").mapInArrow(run, "item int, doc_id long, score long")


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """The items in blocks of bounded size, by hash; each is brought to the driver in turn."""
    rows, size = items.agg(F.count("*"), F.sum(F.length(F.col("text").cast("binary")))).first()
    blocks = max(1, -(-rows // ITEMS), -(-(size or 0) // TERM_BYTES))
    blocks = 1 if blocks == 1 else 2 * blocks
    for block in range(blocks):
        found = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        for lo in range(0, len(found), ITEMS):
            yield found[lo : lo + ITEMS]


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each of ``items`` (item_id,
    text): ``item_id``, ``rank`` (int, from 1), ``doc_id``, ``score``; scores above 0 only, equal
    ones by ascending doc_id, a null id last. Other columns are ignored.

    Null, empty and termless texts are found by nothing and find nothing. Repeated rows of items
    are one item; different texts of one item_id are ranked each on its own. Repeated documents
    have a rank each. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    queries = items.select("item_id", F.col("text").cast("string")).where("text is not null").distinct()
    kind = items.schema["item_id"].dataType
    parts = []
    with staging(spark) as folder:
        index = stage(build_index(docs), "signatures", folder)
        n, total = index.agg(F.sum("n"), F.sum("total")).first()
        for block in _item_blocks(queries) if n else ():
            block = [(r.item_id, c) for r in block if (c := Counter(terms_of(r.text.encode())))]
            if not block:
                continue
            counts = document_counts(docs, list({t for _, c in block for t in c}))
            plan = Plan([c for _, c in block], counts, n, total)
            first = stage(best_bounds(index, plan, max(FIRST, k)), "first", folder)
            at_first = _top(exact_scores(docs, first, plan), k).where(F.col("rank") == k).collect()
            floors = {r.item: (r.score, NO_ID if r.doc_id is None else r.doc_id) for r in at_first}
            left = stage(not_excluded(index, plan, floors), "left", folder)
            ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {kind.simpleString()}")
            best = _top(exact_scores(docs, left, plan), k)
            parts.append(stage(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
u AS (SELECT r, unnest(w) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM u GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
k AS (SELECT item_id, text, term, count(*) AS times FROM q GROUP BY ALL),
w AS (SELECT k.*, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM k JOIN df USING (term), c),
s AS (SELECT w.item_id, w.text, d.r, d.doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score FROM w JOIN tf USING (term) JOIN d USING (r), c GROUP BY w.item_id, w.text, d.r, d.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) <= 10
"""
