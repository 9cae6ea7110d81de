"""Perplexity under an interpolated modified Kneser-Ney word n-gram model of trusted text.

The n-grams are of words, order 3, counted over all trusted documents, so the model grows with
them. Below its unigrams lies a spelling model, by the same rules over the characters of a word,
its end included: it shares out what the unigrams leave to unseen words. Its probabilities are
found with joins by context and looked up in shards.

Of the word model, tables hold counts by n-gram, and as contexts their totals. Keys are hashes and
fall into ranges. A task sums the n-grams of its blocks of texts; Spark deals these by range, where
they are summed again and yield the counts of the order below, which are dealt by their own
range. Scoring is a join: each block of texts sends its distinct n-grams to their ranges, as rows
of packed numbers, where they meet the tables; the answers are dealt by block, and
probabilities are interpolated there. So every n-gram is sent once a block, every table is read once
by each slice of the documents, of which there are at most ``SLICES``, and the time grows with
the documents and the model, not with their product. Counting takes the n-grams in shares and
scoring the documents in slices, so that what is shuffled at once is a part of the whole.
Documents are kept up to a quantile, per language, of the perplexity of trusted documents that
were held out of the counts.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import shared_dir, stage, staging

from .common import arrow_rows, small, table, whole

ORDER = 3  # words
LETTERS = 4  # order of the spelling model
START, END = "\x02", "\x03"
BLOCK_CHARS = 6_000_000
BLOCK_WORDS = 1_000_000  # of a counting task, before it hands its n-grams on
SHARD_ROWS = 1_500_000
SHARES, SHARE_WORDS = 24, 1_500_000  # most shares of the n-grams, and the least words for one more
SLICES, SLICE_CHARS = 16, 50_000_000  # of the documents that are scored
QUANTILE = 0.995
BACKOFF = 64  # tag of interpolation weights among the keys
WORDS = 128  # tag of word n-grams among the keys
BEFORE = 0  # stands for the words before a text's first


def keys_of(codes: np.ndarray, n: int, tag: int) -> np.ndarray:
    """64-bit keys of all windows of ``n`` code points."""
    m = len(codes) - n + 1
    h = np.full(max(m, 0), (tag * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1, dtype=np.uint64)
    for j in range(n if m > 0 else 0):
        h = (h ^ codes[j : j + m].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def keys_at(codes: np.ndarray, ends: np.ndarray, n: int, tag: int) -> np.ndarray:
    """Keys of the windows of ``n`` code points that end before ``ends``."""
    h = np.full(len(ends), (tag * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1, dtype=np.uint64)
    for j in range(n, 0, -1):
        h = (h ^ codes[ends - j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """g, c: the ``order``-grams of all words of ``docs`` (_text)."""
    schema = pa.schema([("g", pa.string()), ("c", pa.int64())])

    def flush(words: Counter) -> pa.RecordBatch:
        text = "".join([START * (order - 1) + w + END for w in words])
        codes, pads = points(text), np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + order
        word = np.repeat(np.arange(len(words)), pads)
        at = np.flatnonzero(np.arange(len(codes)) - (np.cumsum(pads) - pads)[word] >= order - 1)
        counts = np.fromiter(words.values(), dtype=np.int64, count=len(words))[word[at]]
        ranks, first, _ = grouped(keys_at(codes, at + 1, order, order))
        grams = [text[i - order + 1 : i + 1] for i in at[ranks[first]].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(summed(counts, ranks, first), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Counter(), 0
        for texts in blocks(batches, BLOCK_CHARS):
            block = Block.of(whole_column(texts, "_text"))
            words.update(dict(zip(block.words, np.bincount(block.ids, minlength=len(block.words)).tolist())))
            held += len(block.ids)
            if held > BLOCK_CHARS // 4:
                yield flush(words)
                words, held = Counter(), 0
        if words:
            yield flush(words)

    return docs.select("_text").mapInArrow(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(grams: DataFrame) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from the counts of counts 1 to 4."""
    n = {r["c"]: r["count"] for r in grams.where("c <= 4").groupBy("c").count().collect()}
    return discounts_of(*(n.get(i, 0) for i in range(1, 5)))


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def model_table(grams: DataFrame, order: int) -> DataFrame:
    """tag, g, v: log probabilities of the n-grams of each order n (tag n), and log
    interpolation weights of their contexts (tag BACKOFF + n)."""
    levels = {order: stage(grams, f"grams-{order}")}
    for n in range(order - 1, 0, -1):
        shorter = levels[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.sum("c").alias("_s"), F.count("*").alias("_k"))
        # before a word's first letter there is one left neighbour only: such n-grams keep their counts
        levels[n] = stage(shorter.select("g", F.when(F.col("g").startswith(START), F.col("_s")).otherwise(F.col("_k")).alias("c")), f"grams-{n}")
    letters = levels[1].count() + 1  # and one for all others
    lower, out = None, []
    for n in range(1, order + 1):
        d1, d2, d3 = discounts(levels[n])
        own = levels[n].withColumn("x", F.substring("g", 1, n - 1) if n > 1 else F.lit(""))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = own.groupBy("x").agg(F.sum("c").alias("_t"), F.sum(cut).alias("_d"))
        weight = context.select("x", "_t", (F.col("_d") / F.col("_t")).alias("_w"))
        seen = own.join(weight, "x").withColumn("_a", (F.col("c") - cut) / F.col("_t"))
        if n == 1:
            p = seen.select("g", (F.col("_a") + F.col("_w") / letters).alias("p"))
        else:
            seen = seen.withColumn("_y", F.substring("g", 2, n - 1))
            p = seen.join(lower.select(F.col("g").alias("_y"), F.col("p").alias("_q")), "_y").select("g", (F.col("_a") + F.col("_w") * F.col("_q")).alias("p"))
        lower = stage(p, f"level-{n}")
        out.append(lower.select(F.lit(n).alias("tag"), "g", F.log("p").alias("v")))
        out.append(weight.select(F.lit(BACKOFF + n).alias("tag"), F.col("x").alias("g"), F.log("_w").alias("v")))
    # a letter that was never seen, after its interpolation weight
    out.append(grams.sparkSession.createDataFrame([(0, "", -math.log(letters))], "tag int, g string, v double"))
    table_ = out[0]
    for part in out[1:]:
        table_ = table_.unionByName(part)
    return table_


def write_shards(model: DataFrame) -> tuple[str, int]:
    """Hashes the table and writes it in shards of about ``SHARD_ROWS``; returns where."""

    @F.arrow_udf("long")
    def key(tag: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array([int(keys_of(points(x), len(x), t)[0]) for t, x in zip(tag.to_pylist(), g.to_pylist())], pa.int64())

    spark = model.sparkSession
    keyed = stage(model.select(key("tag", "g").alias("k"), F.col("v").cast("float").alias("v")), "keyed")
    shards = max(1, -(-keyed.count() // SHARD_ROWS))
    folder = os.path.join(shared_dir(spark), f"model-{uuid.uuid4().hex}")
    keyed.withColumn("shard", F.pmod("k", F.lit(shards))).repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    return folder, shards


class Shards:
    """Looks keys up in the shards; holds the shard it used last."""

    def __init__(self, folder: str, count: int):
        self.folder, self.count, self.at = folder, count, -1

    def load(self, shard: int) -> None:
        if self.at == shard:
            return
        self.k, self.v = self.read(shard, "k", "v")
        self.at = shard

    def read(self, shard: int, *columns: str) -> list[np.ndarray]:
        """Columns of a shard in the order of the first one."""
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(f"{root}/shard={shard}", allow_not_found=True))
        parts = [pq.read_table(f.path, filesystem=store, columns=list(columns), partitioning=None) for f in found if f.path.endswith(".parquet")]
        out = [np.concatenate([p[c].to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for c in columns]
        if np.any(out[0][1:] < out[0][:-1]):
            order = np.argsort(out[0])
            out = [c[order] for c in out]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, NaN where there is none."""
        out = np.full(len(keys), np.nan)
        home = np.mod(keys, self.count)
        turn = [self.at] if self.at >= 0 else []
        for shard in [*turn, *(s for s in range(self.count) if s not in turn)]:
            mine = np.flatnonzero(home == shard) if self.count > 1 else np.arange(len(keys))
            if not len(mine):
                continue
            self.load(shard)
            if len(self.k):
                at = np.minimum(np.searchsorted(self.k, keys[mine]), len(self.k) - 1)
                hit = self.k[at] == keys[mine]
                out[mine[hit]] = self.v[at[hit]]
        return out


def score_words(words: list[str], model: Shards, order: int) -> np.ndarray:
    """Log probability of each word, its end included."""
    pad = START * (order - 1)
    codes = points("".join([pad + w + END for w in words]))
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + order
    ends = np.cumsum(lens)
    starts = ends - lens
    # the last code point of each predicted n-gram: all but the padding
    last = np.ones(len(codes), dtype=bool)
    for j in range(order - 1):
        last[starts + j] = False
    last = np.flatnonzero(last)
    logp, open_ = np.zeros(len(last)), np.arange(len(last))
    for n in range(order, 0, -1):
        at = last[open_] + 1
        grams, places = distinct(keys_at(codes, at, n, n))
        found = model.find(grams)[places]
        hit = ~np.isnan(found)
        logp[open_[hit]] += found[hit]
        open_, at = open_[~hit], at[~hit]
        if not len(open_):
            break
        contexts, places = distinct(keys_at(codes, at - 1, n - 1, BACKOFF + n))
        logp[open_] += np.nan_to_num(model.find(contexts))[places]
    else:
        logp[open_] += model.find(keys_of(codes[:0], 0, 0))[0]
    word = np.searchsorted(ends, last, side="right")
    return np.bincount(word, weights=logp, minlength=len(words))


def word_keys(words: pa.Array) -> np.ndarray:
    data = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, data), dtype=np.uint64, count=len(words)).view(np.int64)


class Block:
    """Texts as numbers of their distinct words."""

    def __init__(self, words: list[str], keys: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.words, self.keys, self.ids, self.counts = words, keys, ids, counts

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        flat, ends = parts.flatten(), parts.offsets.to_numpy()
        full = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        coded = flat.filter(full).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return cls(words, word_keys(coded.dictionary), coded.indices.to_numpy(), np.diff(before[ends]))

    def windows(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all words in order, each text's behind ``order - 1`` BEFOREs; the places of the
        words; and the last place before each text that has words."""
        counts = self.counts[self.counts > 0]
        pad = order - 1
        at = np.arange(len(self.ids)) + np.repeat(np.arange(1, len(counts) + 1) * pad, counts)
        keys = np.full(len(self.ids) + pad * len(counts), BEFORE, dtype=np.int64)
        keys[at] = self.keys[self.ids]
        return keys, at, at[np.cumsum(counts) - counts] - 1


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows, whose first column is a text, in runs of about ``size`` bytes of text."""
    parts, held = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            start = ends[lo - 1] if lo else 0
            hi = min(int(np.searchsorted(ends, start + size - held)) + 1, b.num_rows)
            parts.append(b.slice(lo, hi - lo))
            held += ends[hi - 1] - start
            if held >= size:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts, held = [], 0
            lo = hi
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def whole_column(table_: pa.Table, name: str) -> pa.Array:
    chunks = table_.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], table_.schema.field(name).type)


def gram_keys(level: int, words: list[np.ndarray]) -> np.ndarray:
    """Keys of word n-grams, of which ``words`` are the first, second, ... words."""
    h = np.full(len(words[0]), ((WORDS + level) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1, dtype=np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def ranked(keys: np.ndarray) -> np.ndarray:
    """The order of the keys: upper bits and places are sorted as one number, which takes a fifth
    of an argsort; where lower bits decide, an argsort."""
    bits = max(len(keys) - 1, 1).bit_length()
    order = np.sort(keys >> bits << bits | np.arange(len(keys))) & (1 << bits) - 1
    put = keys[order]
    return np.argsort(keys, kind="stable") if np.any(put[1:] < put[:-1]) else order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys' order, where each new one begins in it, and the distinct keys."""
    order = ranked(keys)
    put = keys[order]
    first = np.flatnonzero(np.concatenate([put[:1] == put[:1], put[1:] != put[:-1]]))
    return order, first, put[first]


def summed(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], first) if len(first) else values[:0]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    order, first, found = grouped(keys)
    places = np.empty(len(keys), dtype=np.int64)
    places[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return found, places


def cuts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of keys begins and ends among keys in order."""
    return np.searchsorted(((keys >> 32) + (1 << 31)) * parts >> 32, np.arange(parts + 1))


def pack(*columns: np.ndarray, ordered: bool = False) -> bytes:
    """Numbers as bytes: how many, which bytes of each column are not all zero, and these, all lowest
    ones first. An ordered first column is held by its differences."""
    columns = [c.astype(np.int64, copy=False) for c in columns]
    if ordered and len(columns[0]):
        columns[0] = np.concatenate([columns[0][:1], np.diff(columns[0])])
    used, out = [], []
    for c in columns:
        span = 8 if ordered and c is columns[0] else (int(np.bitwise_or.reduce(c)) & (1 << 64) - 1).bit_length() + 7 >> 3
        used.append(span)
        out.append(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :span].T.tobytes())
    return b"".join([len(columns[0]).to_bytes(8, "little"), bytes(used), *out])


def planes_of(data: bytes, width: int) -> list[np.ndarray]:
    """The bytes of each packed column, a row for all lowest ones first."""
    n, at, out = int.from_bytes(data[:8], "little"), 8 + width, []
    for span in data[8 : 8 + width]:
        out.append(np.frombuffer(data, dtype=np.uint8, count=span * n, offset=at).reshape(span, n))
        at += span * n
    return out


def numbers(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    for j, p in enumerate(planes):
        out[:, j] = p
    return out.view(np.int64).reshape(-1)


def unpack(data: bytes, width: int, ordered: bool = False) -> list[np.ndarray]:
    columns = [numbers(p) for p in planes_of(data, width)]
    if ordered:
        columns[0] = np.cumsum(columns[0])
    return columns


def joined(columns: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*columns)] if columns else [np.zeros(0, np.int64)] * width


def count_word_grams(docs: DataFrame, order: int) -> DataFrame:
    """words, k, i: blocks of the texts of ``docs`` (_text) with words: how many, the keys of the
    distinct ones, and of all words in order, each text's behind ``order - 1`` BEFOREs, the numbers
    among these. ``WordModel`` counts the n-grams of one share after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in blocks(batches, 8 * BLOCK_WORDS):
            block = Block.of(whole_column(texts, "_text"))
            if not len(block.ids):
                continue
            _, at, last = block.windows(order)
            ids = np.zeros(len(at) + (order - 1) * len(last), dtype=np.int32)
            ids[at] = block.ids + 1
            row = [len(at)], [np.append(BEFORE, block.keys).tobytes()], [ids.view(np.uint8).reshape(-1, 4).T.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], ["words", "k", "i"])

    return docs.select("_text").mapInArrow(run, "words long, k binary, i binary")


ROWS = "part int, shard int, kind string, k binary, n1 long, n2 long, n3 long, n4 long, more long, total long"
GRAMS, CONTEXTS, TABLE = "grams", "contexts", "table"


def rows_of(rows: list[dict]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in map(str.split, ROWS.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def dealt(kind: str, keys: np.ndarray, parts: int, columns: list[np.ndarray], ordered: bool) -> list[dict]:
    """Rows of columns in the order of their keys, cut into the ranges of the keys."""
    edges = cuts_of(keys, parts)
    packed = ((p, [c[lo:hi] for c in columns]) for p, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi)
    return [{"part": p, "shard": -1, "kind": kind, "k": pack(*c, ordered=ordered)} for p, c in packed]


def spread(c: np.ndarray) -> dict[str, int]:
    """How many counts there are of 1 to 4 and of more than 2, and their total."""
    return {f"n{i}": int((c == i).sum()) for i in range(1, 5)} | {"more": int((c > 2).sum()), "total": int(c.sum())}


def share_counter(order: int, parts: int, share: int, shares: int):
    """Counts, block by block, the n-grams whose second word belongs to a share: so do all n-grams
    of their contexts, and all that have the same last words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, i in zip(b.column(0), b.column(1)):
                ids = np.ascontiguousarray(np.frombuffer(i.as_py(), dtype=np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)
                keys, at = np.frombuffer(k.as_py(), dtype=np.int64)[ids], np.flatnonzero(ids)
                at = at[np.mod(keys[at - order + min(order, 2)], shares) == share]
                words = [keys[at - order + j] for j in range(1, order + 1)]
                ranks, first, found = grouped(gram_keys(order, words))
                if len(first):
                    counts = np.diff(np.append(first, len(at)))
                    yield rows_of(dealt(GRAMS, found, parts, [*(w[ranks[first]] for w in words), counts], False))

    return run


def merger(level: int, order: int, parts: int):
    """Sums the n-grams of one range of keys, and the totals of those that are contexts of the order
    above: a row of the model. For the order below, rows of the contexts and of the last words."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        (part,) = (x.as_py() for x in key)
        kinds, data = rows.column("kind").to_pylist(), rows.column("k").to_pylist()
        *words, c = joined([unpack(d, level + 1) for x, d in zip(kinds, data) if x == GRAMS], level + 1)
        ranks, first, keys = grouped(gram_keys(level, words))
        c, words = summed(c, ranks, first), [w[ranks[first]] for w in words]
        columns = [keys, c]
        if level < order:
            above, *sums = joined([unpack(d, 5, True) for x, d in zip(kinds, data) if x == CONTEXTS], 5)
            ranks, first, above = grouped(above)
            both, places = distinct(np.concatenate([keys, above]))
            columns = [both, *np.zeros((5, len(both)), dtype=np.int64)]
            columns[1][places[: len(keys)]] = c
            for column, x in zip(columns[2:], sums):
                column[places[len(keys) :]] = summed(x, ranks, first)
        out = [{"part": part, "shard": part, "kind": TABLE, "k": pack(*columns, ordered=True), **spread(c)}]
        if level > 1 and len(c):
            ranks, first, keys = grouped(gram_keys(level - 1, words[:-1]))
            sums = [summed(x.astype(np.int64), ranks, first) for x in (np.maximum(c - 3, 0), c == 1, c == 2, c > 2)]
            out += dealt(CONTEXTS, keys, parts, [keys, *sums], True)
            ranks, first, keys = grouped(gram_keys(level - 1, words[1:]))
            # as for letters: what begins before the text keeps its counts
            n = np.where(words[1] == BEFORE, c, 1) if level > 2 else np.ones_like(c)
            out += dealt(GRAMS, keys, parts, [*(w[ranks[first]] for w in words[1:]), summed(n, ranks, first)], False)
        return pa.Table.from_batches([rows_of(out)])

    return run


@contextmanager
def freed_shuffles(spark: SparkSession):
    """What jobs in the block shuffle is removed when each of them ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class WordModel:
    """Where the tables of the word model and the shards of its spelling model are, and what is needed
    of each order besides: the discounts, and of all unigrams the total and the share they leave.

    A row of a table holds a range of the keys of an order, packed: each n-gram's count and, as a
    context of the order above, how many n-grams it has with counts of 1, 2 and more, and before
    these what the latter have beyond 3 each."""

    def __init__(self, texts: DataFrame, order: int, spelling: tuple[str, int], letters: int, parts: int = 1):
        """``texts`` as of ``count_word_grams``; at least ``parts`` ranges."""
        spark = texts.sparkSession
        self.order, self.letters, self.spelling = order, letters, spelling
        self.folder = os.path.join(shared_dir(spark), f"words-{uuid.uuid4().hex}")
        sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n1", "n2", "n3", "n4", "more", "total")]
        of = {}
        with arrow_rows(spark, 1_000), freed_shuffles(spark), staging(spark) as scratch:
            texts = stage(texts, "blocks", scratch)
            words = texts.agg(F.sum("words")).first()[0] or 0
            self.shards = max(parts, -(-words // SHARD_ROWS))
            shares = min(SHARES, max(1, -(-words // SHARE_WORDS)))
            # the last words of n-grams with the same second word belong to one share, but for that word
            last = max(order - 1, min(order, 2))
            # and what shares add to the lowest order is summed when they are put together
            last = 1 if last == 2 else last
            self.shares = {n: range(shares if n >= last else 1) for n in range(1, order + 1)}
            for share in range(shares):
                rows = texts.select("k", "i").mapInArrow(share_counter(order, self.shards, share, shares), ROWS)
                for n in range(order, last - 1, -1):
                    self.merge(rows, n, share)
                    rows = self.below(spark, n, share)
                    if n < order:
                        self.remove(spark, n + 1, share, "shard=-1")
            for n in range(last - 1, 0, -1):
                rows = [self.below(spark, n + 1, share) for share in self.shares[n + 1]]
                self.merge(reduce(DataFrame.unionByName, rows), n, 0)
                for share in self.shares[n + 1]:
                    self.remove(spark, n + 1, share, "shard=-1")
        for n in range(1, order + 1):
            self.settle(spark, n)
            found = spark.read.schema(ROWS).parquet(f"{self.folder}/level={n}")
            of[n] = found.where(F.col("kind") == TABLE).agg(*sums).first()
        self.cuts = {n: discounts_of(*(of[n][x] for x in ("n1", "n2", "n3", "n4"))) for n in of}
        self.total = of[1]["total"]
        self.left = sum(d * of[1][x] for d, x in zip(self.cuts[1], ("n1", "n2", "more")))

    def merge(self, rows: DataFrame, level: int, share: int) -> None:
        merged = rows.groupBy("part").applyInArrow(merger(level, self.order, self.shards), ROWS)
        merged.write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.folder}/level={level}/share={share}")

    def below(self, spark: SparkSession, level: int, share: int) -> DataFrame:
        """What a share of a level leaves to the level below."""
        return spark.read.schema(ROWS).parquet(f"{self.folder}/level={level}/share={share}").where("shard = -1")

    def remove(self, spark: SparkSession, level: int, share: int, name: str = "") -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/level={level}/share={share}/{name}".rstrip("/"))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def settle(self, spark: SparkSession, level: int) -> None:
        """Puts the shares of a level together, as one table for each range."""
        if len(self.shares[level]) == 1:
            return
        width = 2 if level == self.order else 6

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b.column(0).to_pylist():
                    tables = [planes_of(data, width) for data in self.tables(level, part)]
                    if tables:
                        ranks, first, keys = grouped(np.concatenate([np.cumsum(numbers(t[0])) for t in tables]))
                        c, *columns = (summed(np.concatenate([numbers(t[j]) for t in tables]), ranks, first) for j in range(1, width))
                        data = pack(keys, c, *columns, ordered=True)
                        yield rows_of([{"part": part, "shard": part, "kind": TABLE, "k": data, **spread(c)}])

        rows = spark.range(0, self.shards, 1, self.shards).mapInArrow(run, ROWS)
        rows.write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.folder}/level={level}/share=-1")
        for share in self.shares[level]:
            self.remove(spark, level, share)
        self.shares[level] = [-1]

    def tables(self, level: int, part: int) -> Iterator[bytes]:
        store, root = fs.FileSystem.from_uri(self.folder)
        for share in self.shares[level]:
            files = store.get_file_info(fs.FileSelector(f"{root}/level={level}/share={share}/shard={part}", allow_not_found=True))
            for f in files:
                if f.path.endswith(".parquet"):
                    yield from (x.as_py() for x in pq.read_table(f.path, filesystem=store, columns=["k"], partitioning=None).column("k"))

    def find(self, level: int, part: int, keys: np.ndarray) -> np.ndarray:
        """Columns of a table for distinct keys in order, all of one range: counts and, but for the
        highest order, what belongs to contexts; 0 where there is none."""
        width = 2 if level == self.order else 6
        out = np.zeros((width - 1, len(keys)), dtype=np.int64)
        for data in self.tables(level, part) if len(keys) else ():
            own, *columns = planes_of(data, width)
            own = np.cumsum(numbers(own))
            if not len(own):
                continue
            # the fewer ones are looked for among the others
            if len(own) < len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == own)
                at = at[hit]
            else:
                hit = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                at = np.flatnonzero(own[hit] == keys)
                hit = hit[at]
            for total, column in zip(out, columns):
                for j, p in enumerate(column):
                    total[at] += p[hit].astype(np.int64) << 8 * j
        return out

    def asked(self, windows: tuple, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all n-grams of a level that a block needs, and which one ends at each word; those
        before them are the contexts of the level above."""
        keys, at, last = windows
        ends, own = at, np.arange(len(at))
        if level < self.order:
            used = np.zeros(len(keys), dtype=bool)
            used[at] = used[last] = True
            ends, own = np.flatnonzero(used), (np.cumsum(used) - 1)[at]
        return gram_keys(level, [keys[ends - level + i] for i in range(1, level + 1)]), own

    def score(self, block: Block, spelled: np.ndarray, find) -> np.ndarray:
        """Log probability of every word of the block in its place. ``spelled`` are those of its
        distinct words by their letters; ``find(level, keys)`` gives columns of distinct keys."""
        windows = block.windows(self.order)
        p, context = np.exp(spelled), None
        for n in range(1, self.order + 1):
            keys, own = self.asked(windows, n)
            found, places = distinct(keys)
            c, *of = find(n, found)
            share = self.share(c, n)[places[own]]
            if n == 1:
                # a word of very many letters has no probability that a float can hold
                p = np.maximum(share / self.total + self.left / self.total * p[block.ids], 1e-300) if self.total else np.maximum(p, 1e-300)[block.ids]
            else:
                total, left = context
                p *= left
                p += share
                p /= total
            if n < self.order:
                # without any n-grams of a context, the order below is taken whole
                rest, *counts = of
                total = rest + sum(k * x for k, x in enumerate(counts, 1))
                left = np.where(total > 0, sum(d * x for d, x in zip(self.cuts[n + 1], counts)), 1.0)
                before = places[own - 1]
                context = np.maximum(total, 1)[before], left[before]
        return np.log(p)

    def share(self, counts: np.ndarray, n: int) -> np.ndarray:
        """Counts without their discounts; 0 where there is no count."""
        d = np.array([0.0, *self.cuts[n]])
        return counts - d[np.minimum(counts, 3)]


def perplexity_of(logp: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> list[float | None]:
    """Per text, from the log probabilities of all words; ``sizes`` are of letters and word ends."""
    sums = np.add.reduceat(logp, (np.cumsum(counts) - counts)[counts > 0]) if len(logp) else logp
    out: list[float | None] = [None] * len(counts)
    for i, s, size in zip(np.flatnonzero(counts), sums, sizes[counts > 0]):
        out[i] = math.exp(min(-s / size, 700.0))
    return out


def sizes_of(block: Block) -> np.ndarray:
    letters = np.fromiter(map(len, block.words), dtype=np.int64, count=len(block.words)) + 1
    before = np.concatenate([[0], np.cumsum(letters[block.ids])])
    ends = np.cumsum(block.counts)
    return before[ends] - before[ends - block.counts]


def perplexities(model: WordModel):
    """An Arrow function text -> perplexity per character and word end; null without words. Every
    block reads the whole model, which suits few texts; ``rate`` joins instead."""

    @F.arrow_udf("double")
    def perplexity(text: pa.Array) -> pa.Array:
        spelling, out = Shards(*model.spelling), []

        def find(level: int, keys: np.ndarray) -> np.ndarray:
            edges = cuts_of(keys, model.shards)
            return np.concatenate([model.find(level, p, keys[lo:hi]) for p, (lo, hi) in enumerate(zip(edges, edges[1:]))], axis=1)

        for texts in blocks(iter([pa.RecordBatch.from_arrays([text], ["t"])]), BLOCK_CHARS):
            block = Block.of(whole_column(texts, "t"))
            logp = model.score(block, score_words(block.words, spelling, model.letters), find) if block.words else np.zeros(0)
            out += perplexity_of(logp, block.counts, sizes_of(block))
        return pa.array(out, pa.float64())

    return perplexity


def joined_perplexities(rows: DataFrame, model: WordModel) -> DataFrame:
    """_id, _lang, perplexity of rows (_text, _id, _lang), by joins of their blocks with the model.

    A block's row without level holds its texts as numbers of its words, with these words' keys and
    spellings; its other rows the distinct keys of a level in a range, later what was found."""
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"block long, part int, level int, k binary, i binary, t binary, ids array<{id_type}>, langs array<string>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, number = Shards(*model.spelling), TaskContext.get().partitionId() << 32
        for texts in blocks(batches, BLOCK_CHARS):
            block = Block.of(whole_column(texts, "_text"))
            spelled = score_words(block.words, spelling, model.letters) if block.words else np.zeros(0)
            head = {
                "k": pack(block.keys, spelled.view(np.int64)),
                "i": block.ids.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(),
                "t": pack(block.counts, sizes_of(block)),
            }
            # blocks pass the tables in groups of their own
            out = [head | {"block": number, "part": -1 - number % 1009, "level": 0}]
            windows = block.windows(model.order)
            for n in range(1, model.order + 1):
                keys = distinct(model.asked(windows, n)[0])[0]
                edges = cuts_of(keys, model.shards)
                out += [{"block": number, "part": p, "level": n, "k": pack(keys[lo:hi], ordered=True)} for p, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi]
            columns = [pa.array([r.get(x) for r in out], t) for x, t in types]
            for name in ("_id", "_lang"):
                values, ends = whole_column(texts, name), np.full(len(out) + 1, texts.num_rows, dtype=np.int32)
                ends[0] = 0
                columns.append(pa.ListArray.from_arrays(pa.array(ends), values))
            yield pa.RecordBatch.from_arrays(columns, [*(x for x, _ in types), "ids", "langs"])
            number += 1

    types = [("block", pa.int64()), ("part", pa.int32()), ("level", pa.int32()), ("k", pa.binary()), ("i", pa.binary()), ("t", pa.binary())]

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part < 0:
            return asked
        levels, data = asked.column("level").to_numpy(), asked.column("k")
        out: list[bytes | None] = [None] * asked.num_rows
        for n in sorted(set(levels.tolist())):
            mine = np.flatnonzero(levels == n)
            wanted = [unpack(data[i].as_py(), 1, True)[0] for i in mine]
            found, places = distinct(np.concatenate(wanted))
            values = model.find(n, part, found)
            hi = 0
            for i, keys in zip(mine, wanted):
                lo, hi = hi, hi + len(keys)
                out[i] = pack(*(x[places[lo:hi]] for x in values))
        return asked.set_column(asked.column_names.index("k"), "k", pa.array(out, pa.binary()))

    def interpolate(key: tuple, found: pa.Table) -> pa.Table:
        levels, parts, data = (found.column(x).to_numpy(zero_copy_only=False) for x in ("level", "part", "k"))
        head = int(np.flatnonzero(levels == 0)[0])
        keys, spelled = unpack(data[head], 2)
        counts, sizes = unpack(found.column("t")[head].as_py(), 2)
        ids = np.ascontiguousarray(np.frombuffer(found.column("i")[head].as_py(), dtype=np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)

        def find(level: int, asked: np.ndarray) -> list[np.ndarray]:
            mine = np.flatnonzero(levels == level)
            width = 1 if level == model.order else 5
            return joined([unpack(data[i], width) for i in mine[np.argsort(parts[mine])]], width)

        block = Block([], keys, ids, counts)
        logp = model.score(block, spelled.view(np.float64), find) if len(ids) else np.zeros(0)
        out = [found.column(x)[head].values for x in ("ids", "langs")]
        return pa.table([*out, pa.array(perplexity_of(logp, counts, sizes), pa.float64())], names=["_id", "_lang", "perplexity"])

    asked = rows.select("_text", "_id", "_lang").mapInArrow(ask, schema)
    answered = asked.groupBy("part").applyInArrow(answer, schema)
    return answered.groupBy("block").applyInArrow(interpolate, f"_id {id_type}, _lang string, perplexity double")


def held_back(key: Column) -> Column:
    """A tenth of the trusted rows sets the thresholds and takes no part in the counts."""
    return F.pmod(F.xxhash64(key, F.lit(4)), F.lit(10)) == 0


def rate(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang; other columns are ignored): doc_id,
    perplexity, threshold, kept.

    Trusted rows have a label of quality 1. A text without words has no perplexity and is not
    kept. A language without held-out trusted rows (null is a language) uses the threshold of
    all held-out rows; without any of those, or without trusted text, every text with words
    is kept (threshold null). Repeated rows are rated each.
    """
    spark = docs.sparkSession
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    trusted = small(trusted.withColumn("_good", F.lit(True)), trusted.count())
    rows = docs.select(F.col("doc_id").alias("_id"), whole("text").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    counted = rows.join(trusted.where(~held_back(F.col("_id"))), "_id")
    folder, scored = os.path.join(shared_dir(spark), f"perplexity-{uuid.uuid4().hex}"), []
    with arrow_rows(spark, 1_000), freed_shuffles(spark):
        size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        slices = min(SLICES, max(1, -(-size // SLICE_CHARS)))
        # as many as there are blocks in a slice, in which its tasks would make smaller ones
        parts = max(1, -(-size // (slices * BLOCK_CHARS)))
        spelling = write_shards(model_table(count_grams(counted, LETTERS), LETTERS))
        model = WordModel(count_word_grams(counted, order), order, spelling, LETTERS, parts)
        for n in range(slices):
            own = rows.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(slices)) == n).coalesce(parts)
            scored.append(stage(joined_perplexities(own, model), f"slice-{n}", folder))
    scored = reduce(DataFrame.unionByName, scored)
    held = scored.where(F.col("perplexity").isNotNull()).join(trusted.where(held_back(F.col("_id"))), "_id")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    everywhere = held.agg(limit.alias("v")).first()["v"]
    found = {r["_lang"]: r["v"] for r in held.groupBy("_lang").agg(limit.alias("v")).collect()}  # one row per language
    threshold = F.lit(everywhere).cast("double")
    for lang, value in found.items():
        threshold = F.when(F.col("_lang").eqNullSafe(F.lit(lang)), value).otherwise(threshold)
    out = scored.select(F.col("_id").alias("doc_id"), "perplexity", threshold.alias("threshold"))
    ok = F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & ok)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
