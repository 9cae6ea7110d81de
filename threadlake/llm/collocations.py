"""Phrase collocations counted by counting quotient filters.

Words that occur often enough in their language are numbered over the corpus; a phrase of ``n``
of them is a key of ``n * width`` bits. An invertible mixing of the key (alternating exclusive-ors
of its two parts) spreads keys evenly over their range. The mixed key's leading bits are its
quotient, the rest its full remainder, so a filter, which stores sorted remainders by quotient
with a counter each, loses nothing: keys are read back by undoing the mixing.

Each task counts the phrases of its texts in filters, one for each length and shard; a shard is
a range of mixed keys, so shards are even however frequent a phrase is. A shard's filters of all
tasks are merged in the order of the keys. Only phrases that reach the threshold leave a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.session import stage, staging

from .common import arrow_rows, table

LONGEST = 4
LEAST = 30
PERCENT = 80
TOP = 2000
BLOCK_TOKENS = 500_000  # words and breaks of a block of texts, unless a single text has more
BLOCK_WORDS = 200_000
BATCH = 4  # blocks that are handed to Python at a time
HELD = 1_000_000  # phrases of a length a task counts before it packs them
SHARD = 4_000_000  # phrase occurrences of a shard

# Pieces end at . , ; : ! ? and \n, \v, \f, \r; words are parted by spaces and tabs.
_BYTES = bytes(10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_EMPTY, _BREAK, _OWN = 0, 1, 2  # numbers in a block; words follow


class _Numbers(dict):
    """Numbers of a block's words in order of their first use."""

    def __init__(self):
        super().__init__({b"": _EMPTY, b"\n": _BREAK})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def numbered_blocks(docs: DataFrame) -> DataFrame:
    """Texts as numbers: ``lang``, ``words`` and ``counts`` of a block, and ``tokens`` (unsigned
    32-bit; a break between pieces and after each text)."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Numbers, list]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            numbers, held = open_.pop(lang)
            del size[lang]
            tokens, words = np.concatenate(held), list(numbers)[_OWN:]
            if words:
                counts = np.bincount(tokens, minlength=len(numbers))[_OWN:]
                named = pa.array(words, pa.binary()).cast(pa.string())
                one = np.array([0, len(words)], np.int32)
                columns = [pa.array([lang]), pa.ListArray.from_arrays(one, named), pa.ListArray.from_arrays(one, pa.array(counts)), pa.array([tokens.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                numbers, held = open_.setdefault(lang, (_Numbers(), []))
                parts = text.as_py().translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
                found = np.fromiter(map(numbers.__getitem__, parts), np.uint32, len(parts))
                held.append(np.append(found[found != _EMPTY], np.uint32(_BREAK)))
                size[lang] = size.get(lang, 0) + len(held[-1])
                if len(numbers) > BLOCK_WORDS or size[lang] > BLOCK_TOKENS:
                    yield from flush(lang)
            while len(size) > 1000 or sum(size.values()) > 8 * BLOCK_TOKENS:  # however many languages there are
                yield from flush(max(size, key=size.get))
        for lang in list(open_):
            yield from flush(lang)

    texts = docs.select(F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit("")).cast("binary"))
    return texts.mapInArrow(run, "lang string, words array<string>, counts array<long>, tokens binary")


def vocabulary(words: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Frequent words (lang, word, c) with a gapless ``id`` from 1, and how many there are."""
    spark = words.sparkSession
    held = stage(words.withColumn("_m", F.monotonically_increasing_id()), "vocabulary", folder)
    part = F.shiftright("_m", 33)
    sizes = sorted(held.groupBy(part.alias("p")).count().collect())  # one number per partition
    offsets, total = [], 1
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets, "_p long, _o long")
    numbered = held.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return numbered.select("lang", "word", "c", (F.col("_o") + F.col("_m") - F.shiftleft(F.col("_p"), 33)).alias("id")), total - 1


class Keys:
    """Keys of phrases of ``n`` words with ids of at most ``width`` bits: two parts of at most 64
    bits, an upper one of all words but the last two, and a lower one. A mixed key is held as its
    leading 64 bits and what is left (``spare`` bits)."""

    def __init__(self, n: int, width: int):
        assert 2 <= n <= LONGEST and 1 <= width <= 32
        self.n, self.width = n, width
        self.high, self.low = ((n - 2) * width, 2 * width) if n > 2 else (width, width)
        self.bits = n * width
        self.spare = max(0, self.bits - 64)

    def _round(self, x: np.ndarray, turn: int, bits: int) -> np.ndarray:
        x = x + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - bits)

    def mix(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for turn in range(3):
            high = high ^ self._round(low, 2 * turn, self.high)
            low = low ^ self._round(high, 2 * turn + 1, self.low)
        return high, low

    def unmix(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for turn in (2, 1, 0):
            low = low ^ self._round(high, 2 * turn + 1, self.low)
            high = high ^ self._round(low, 2 * turn, self.high)
        return high, low

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Mixed keys of columns of ids: leading bits, and the spare ones."""
        ids = [x.astype(np.uint64) for x in ids]
        w = np.uint64(self.width)
        high = ids[0] if self.n < 4 else ids[0] << w | ids[1]
        low = ids[1] if self.n == 2 else ids[-2] << w | ids[-1]
        high, low = self.mix(high, low)
        if not self.spare:
            return high << np.uint64(self.low) | low if self.low < 64 else low, np.zeros(0, np.uint64)
        s = np.uint64(self.spare)
        lead = low >> s
        if self.low - self.spare < 64:
            lead = high << np.uint64(self.low - self.spare) | lead
        return lead, low & np.uint64((1 << self.spare) - 1)

    def unpack(self, lead: np.ndarray, spare: np.ndarray) -> list[np.ndarray]:
        if self.spare:
            cut = self.low - self.spare
            high, low = lead >> np.uint64(cut), (lead & np.uint64((1 << cut) - 1)) << np.uint64(self.spare) | spare
        else:
            high, low = lead >> np.uint64(self.low), lead & np.uint64((1 << self.low) - 1)
        high, low = self.unmix(high, low)
        w, mask = np.uint64(self.width), np.uint64((1 << self.width) - 1)
        left = [high] if self.n < 4 else [high >> w, high & mask]
        return left + ([low] if self.n == 2 else [low >> w, low & mask])

    @property
    def lead(self) -> int:
        return self.bits - self.spare


def tally(lead: np.ndarray, spare: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their counts (1 each without)."""
    if len(spare):
        order = np.lexsort((spare, lead))
        lead, spare = lead[order], spare[order]
        fresh = np.concatenate(([True], (lead[1:] != lead[:-1]) | (spare[1:] != spare[:-1])))
    elif counts is None:
        lead, order = np.sort(lead), None
        fresh = np.concatenate(([True], lead[1:] != lead[:-1]))[: len(lead)]
    else:
        order = np.argsort(lead, kind="stable")
        lead = lead[order]
        fresh = np.concatenate(([True], lead[1:] != lead[:-1]))[: len(lead)]
    at = np.flatnonzero(fresh)
    sums = np.diff(np.append(at, len(lead))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return lead[at], spare[at] if len(spare) else spare, sums.astype(np.int64)


class Filter:
    """A counting quotient filter of sorted distinct keys. Stored are, for a quotient of about
    as many values as there are keys, a unary code of the keys of each quotient, the remainders in
    whole bytes with the spare bits behind them, and a counter of one byte for each key: 255 stands
    for a larger one, which follows in eight bytes."""

    @staticmethod
    def encode(lead: np.ndarray, spare: np.ndarray, counts: np.ndarray, bits: int, base: int = 0) -> bytes:
        """``bits``: of the keys in ``lead`` above ``base``, their least value here."""
        n = len(lead)
        rest = -(-max(0, bits - max(0, n.bit_length() - 1)) // 8)  # bytes of a remainder
        quotient_bits = max(0, bits - 8 * rest)
        offset = lead - np.uint64(base)
        quotient = offset >> np.uint64(8 * rest) if rest < 8 else np.zeros(n, np.uint64)
        per = np.bincount(quotient.astype(np.int64), minlength=1 << quotient_bits)
        unary = np.ones(n + len(per), dtype=np.uint8)
        unary[np.cumsum(per) + np.arange(len(per))] = 0
        remainders = offset.astype("<u8").view(np.uint8).reshape(n, 8)[:, :rest]
        wide = counts >= 255
        parts = [np.array([n, bits, base, len(spare) > 0, int(wide.sum())], "<u8").tobytes(), np.packbits(unary).tobytes(), np.ascontiguousarray(remainders).tobytes()]
        parts += [spare.astype("<u8").tobytes() if spare.max(initial=0) > 255 else b"", spare.astype(np.uint8).tobytes()] if len(spare) else []
        parts += [np.where(wide, 255, counts).astype(np.uint8).tobytes(), counts[wide].astype("<i8").tobytes()]
        flag = bytes([bool(len(spare)) and int(spare.max(initial=0)) > 255])
        return flag + b"".join(parts)

    @staticmethod
    def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        broad, at = data[0], 41
        n, bits, base, spares, wides = (int(x) for x in np.frombuffer(data, "<u8", 5, 1))
        rest = -(-max(0, bits - max(0, n.bit_length() - 1)) // 8)
        slots = n + (1 << max(0, bits - 8 * rest))

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        unary = np.unpackbits(take("u1", -(-slots // 8)), count=slots)
        quotient = np.cumsum(unary == 0)[unary == 1].astype(np.uint64)
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :rest] = take("u1", n * rest).reshape(n, rest)
        lead = whole.view("<u8").ravel()
        if rest < 8:
            lead = lead | quotient << np.uint64(8 * rest)
        spare = np.zeros(0, np.uint64)
        if spares:
            spare = take("<u8", n).astype(np.uint64) if broad else spare
            narrow = take("u1", n)
            spare = spare if broad else narrow.astype(np.uint64)
        counts = take("u1", n).astype(np.int64)
        counts[counts == 255] = take("<i8", wides)
        return lead + np.uint64(base), spare, counts


def count_phrases(blocks: DataFrame, width: int, shards: int) -> DataFrame:
    """``n``, ``shard``, ``filter``: phrases of the blocks (``tokens``; ``ids``, a struct of number
    and id for each frequent word) in filters, by length and shard. ``shards``: a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {n: Keys(n, width) for n in range(2, LONGEST + 1)}
        fresh = {n: [] for n in keys}
        tallied = {n: [] for n in keys}

        def packed(n: int) -> Iterator[pa.RecordBatch]:
            key, parts = keys[n], tallied[n]
            tallied[n] = []
            if not parts:
                return
            lead, spare, counts = tally(*(np.concatenate(x) for x in zip(*parts))) if len(parts) > 1 else parts[0]
            bits = key.lead - (shards.bit_length() - 1)
            cuts = np.searchsorted(lead, np.array([s << bits for s in range(1, shards)], np.uint64)).tolist()
            rows = [(s, Filter.encode(lead[a:b], spare[a:b], counts[a:b], bits, s << bits)) for s, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lead)])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int32()), pa.array([f for _, f in rows], pa.binary())], names=["n", "shard", "filter"])

        def settle(n: int) -> Iterator[pa.RecordBatch]:
            if fresh[n]:
                tallied[n].append(tally(*(np.concatenate(x) for x in zip(*fresh[n]))))
                fresh[n] = []
            if sum(len(x[0]) for x in tallied[n]) > HELD:
                yield from packed(n)

        for b in batches:
            for data, pairs in zip(b.column(0), b.column(1)):
                tokens = np.frombuffer(data.as_buffer(), "<u4")
                names = np.zeros(int(tokens.max(initial=0)) + 1, np.uint64)
                found = pairs.values
                names[found.field(0).to_numpy()] = found.field(1).to_numpy().astype(np.uint64)
                ids = names[tokens]
                here = ids > 0
                for n, key in keys.items():
                    here = here[: len(ids) - n + 1] & (ids[n - 1 :] > 0)
                    at = np.flatnonzero(here)
                    if len(at):
                        fresh[n].append(key.pack([ids[at + j] for j in range(n)]))
                    if sum(len(x[0]) for x in fresh[n]) > HELD // 4:
                        yield from settle(n)
        for n in keys:
            yield from settle(n)
            yield from packed(n)

    return blocks.select("tokens", "ids").mapInArrow(run, "n int, shard int, filter binary")


def merge_filters(filters: DataFrame, width: int, least: int) -> DataFrame:
    """``ids`` and ``f`` of the phrases that occur ``least`` times or more."""

    def run(group: pa.Table) -> pa.Table:
        key = Keys(group.column("n")[0].as_py(), width)
        lead, spare, counts = tally(*(np.concatenate(x) for x in zip(*(Filter.decode(f.as_py()) for f in group.column("filter")))))
        keep = counts >= least
        ids = key.unpack(lead[keep], spare[keep] if len(spare) else spare)
        flat = np.stack(ids, axis=1).astype(np.int64).ravel() if keep.any() else np.zeros(0, np.int64)
        offsets = np.arange(0, key.n * int(keep.sum()) + 1, key.n, dtype=np.int32)
        return pa.table({"ids": pa.ListArray.from_arrays(offsets, pa.array(flat)), "f": pa.array(counts[keep])})

    return filters.groupBy("n", "shard").applyInArrow(run, "ids array<long>, f long")


def _frequent(docs: DataFrame, least: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, c, id) and phrases (ids, f) that occur ``least`` times or more, and the
    number of words of each language (lang, n)."""
    blocks = stage(numbered_blocks(docs).withColumn("block", F.monotonically_increasing_id()), "blocks", folder)
    listed = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("_at", "_w"))
    listed = listed.select("block", "lang", F.col("_at").alias("at"), F.col("_w.words").alias("word"), F.col("_w.counts").alias("c"))
    words = listed.groupBy("lang", "word").agg(F.sum("c").alias("c"))
    sizes = stage(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")), "sizes", folder)
    known, count = vocabulary(words.where(F.col("c") >= least), folder)
    known = stage(known, "words", folder)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    width = max(1, int(count).bit_length())
    shards = 1 << max(0, (-(-3 * total // SHARD) - 1).bit_length())
    shards = min(shards, 1 << min(width, 16))
    named = listed.join(known.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct((F.col("at") + _OWN).alias("at"), "id")).alias("ids"))
    whole = blocks.select("block", "tokens").join(named, "block")
    with arrow_rows(docs.sparkSession, BATCH):
        phrases = stage(merge_filters(count_phrases(whole, width, shards), width, least), "phrases", folder)
    return known, phrases, sizes


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of two to four words of each language: ``lang``, ``rank``,
    ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (of its parts at the cut with the lowest
    score), ``n`` (words of the language), ``score``.

    A phrase occurs ``least`` times or more and is left out if it lies within a longer one with
    ``percent`` of its occurrences. A null lang is ``und``, a null text is empty; repeated rows
    count each; other columns are ignored. Without such phrases there are no rows.
    """
    with staging(docs.sparkSession) as folder:
        known, phrases, sizes = _frequent(docs, least, folder)
        counts = known.select(F.array("id").alias("ids"), F.col("c").alias("f")).union(phrases)
        cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
        cuts = cuts.withColumn("_first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("_rest", F.expr("slice(ids, k + 1, size(ids) - k)"))
        first = counts.select(F.col("ids").alias("_first"), F.col("f").alias("l"))
        rest = counts.select(F.col("ids").alias("_rest"), F.col("f").alias("r"))
        score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
        scored = cuts.join(first, "_first").join(rest, "_rest").withColumn("score", score)
        least_cut = scored.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_m")).select("ids", "a", "_m.score", "_m.l", "_m.r")
        inner = phrases.where(F.size("ids") > 2).select(F.col("f"), F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), i -> slice(ids, i, n))))")).alias("ids"))
        within = inner.groupBy("ids").agg(F.max("f").alias("_f"))
        ratio = F.expr(f"cast(100 as decimal(3, 0)) * cast(_f as decimal(19, 0)) < cast({int(percent)} as decimal(10, 0)) * cast(a as decimal(19, 0))")
        kept = least_cut.join(within, "ids", "left").where(F.col("_f").isNull() | ratio)
        spelled = kept.select("ids", "a", "l", "r", "score", F.posexplode("ids").alias("_at", "id")).join(known.select("id", "lang", "word"), "id")
        spelled = spelled.groupBy("ids", "a", "l", "r", "score", "lang").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_w"))
        phrase = F.array_join(F.col("_w.word"), " ").alias("phrase")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = spelled.select("lang", phrase, "a", "l", "r", "score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        return stage(ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, unnest(p) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, g, f AS a FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, size, g, a, unnest(range(1, size)) AS k FROM c),
s AS (SELECT x.*, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.k = x.k AND l.g = list_slice(x.g, 1, x.k) JOIN f r ON r.lang = x.lang AND r.k = size - x.k AND r.g = list_slice(x.g, x.k + 1, size)),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, f, unnest(y) AS g FROM (SELECT lang, a AS f, list_transform(range(2, size), lambda z: list_transform(range(1, size - z + 2), lambda j: list_slice(g, j, j + z - 1))) AS ys FROM c WHERE size > 2), unnest(ys) AS v(y)),
b AS (SELECT lang, g, max(f) AS f FROM i GROUP BY lang, g),
o AS (SELECT m.lang, array_to_string(m.g, ' ') AS phrase, m.a, m.l, m.r, m.score FROM m LEFT JOIN b ON b.lang = m.lang AND b.g = m.g WHERE b.f IS NULL OR 100 * b.f < 80 * m.a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
