"""Byte-pair encoding and decoding with a public tokenizer's vocabulary.

A word is a doubly linked list of symbols; a priority queue holds the rank of every
neighbouring pair that can merge. The lowest rank (leftmost of equals) is merged, its new
neighbours are queued, and entries whose symbols have changed meanwhile are skipped, so a
word of n symbols takes O(n log n). Words repeat, so a worker remembers the result of short
ones. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# White space of the Unicode standard. str.split() takes four control characters besides.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")
REMEMBERED = 300_000  # words a worker keeps, and half as many chunks
LONGEST = 64  # characters of a chunk worth keeping
HELD_CHARS = 1_000_000  # of texts whose ids and decoded texts are held at once
SIDE, PLACE = 24, 40  # bits of a symbol in a pair, and of a place in a queue entry


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    where it is printable Latin-1, else the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters, free = [""] * 256, 256
    for b in range(256):
        if b in own:
            letters[b] = chr(b)
        else:
            letters[b] = chr(free)
            free += 1
    return letters


@dataclass
class Vocabulary:
    """What a tokenizer file says; the driver reads it and ships it, a fixed size."""

    ids: dict[str, int]
    ranks: dict[int, int]  # pair -> rank
    merged: list[int]  # rank -> id of the merged symbol
    pattern: str
    suffix: str
    added: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: not a lower-casing byte-level BPE with word ends")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            ranks.setdefault(ids[a] << SIDE | ids[b], rank)
        return cls(ids, ranks, [ids[a + b] for a, b in pairs], split["pattern"]["Regex"], model["end_of_word_suffix"] or "", {x["content"]: x["id"] for x in spec["added_tokens"]})

    def names(self) -> list[str]:
        """Vocabulary strings by id."""
        out = [""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for word, i in [*self.ids.items(), *self.added.items()]:
            out[i] = word
        return out


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merges neighbours by rank until no pair of ``ranks`` is left; ``merged`` has the new
    symbol of each rank. A queue entry is one number: the rank, then the place."""
    n, known = len(symbols), ranks.get
    ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        rank = known(left << SIDE | right)
        if rank is not None:
            queue.append(rank << PLACE | i - 1)
        left = right
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        rank, i = entry >> PLACE, entry & (1 << PLACE) - 1
        j = ahead[i]
        if j >= n or symbols[i] < 0 or known(symbols[i] << SIDE | symbols[j]) != rank:
            continue  # stale: one side has been merged away or changed
        symbols[i] = new = merged[rank]
        symbols[j] = -1
        ahead[i] = k = ahead[j]
        if k < n:
            back[k] = i
            rank = known(new << SIDE | symbols[k])
            if rank is not None:
                heapq.heappush(queue, rank << PLACE | i)
        h = back[i]
        if h >= 0:
            rank = known(symbols[h] << SIDE | new)
            if rank is not None:
                heapq.heappush(queue, rank << PLACE | h)
    return [s for s in symbols if s >= 0]


class Coder(dict):
    """Encodes texts; as a dict it maps a chunk without white space to its ids (32-bit)."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.pattern = regex.compile(vocabulary.pattern)
        self.words: dict[str, bytes] = {}
        letters = byte_letters()
        self.inner = [vocabulary.ids[x] for x in letters]
        self.last = [vocabulary.ids[x + vocabulary.suffix] for x in letters]
        self.names = vocabulary.names()
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None

    def __missing__(self, chunk: str) -> bytes:
        # NFC and lower case, letter by letter, never cross white space
        if chunk.isascii():
            lower = chunk.lower()
        else:
            lower = unicodedata.normalize("NFC", chunk)
            lower = "".join(map(str.lower, lower)) if "\u03a3" in lower else lower.lower()
        ids = []
        for word in [lower] if lower.isalpha() else self.pattern.findall(lower):
            known = self.words.get(word)
            if known is None:
                known = array("i", self.word(word)).tobytes()
                if len(word) <= LONGEST:
                    if len(self.words) >= REMEMBERED:
                        self.words.clear()
                    self.words[word] = known
            ids.append(known)
        out = ids[0] if len(ids) == 1 else b"".join(ids)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.clear()
            self[chunk] = out
        return out

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.v.ranks, self.v.merged)

    def decode(self, ids) -> str:
        """Vocabulary strings, one space between them: the tokenizer file names no decoder
        that would turn letters back into bytes."""
        return " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> bytes:
        """Ids (32-bit) of a text. Special strings in the text are their own ids; the text
        between them is coded apart."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts.append(self._plain(text[at : m.start()]))
            parts.append(array("i", [self.v.added[m[0]]]).tobytes())
            at = m.end()
        parts.append(self._plain(text[at:]))
        return b"".join(parts)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, SPACE.split(text) if NOT_SPACE.search(text) else text.split()))


def code(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text) to batches (doc_id, ids, decoded) of about ``HELD_CHARS`` of text
    or one text, so that only these, and not a whole batch, are held coded."""
    for b in batches:
        schema = pa.schema([b.schema.field(0), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        first, held, texts = 0, 0, []
        for i, t in enumerate(b.column(1), 1):
            text = t.as_py() or ""
            texts.append(coder.encode(text))
            held += len(text)
            if held > HELD_CHARS or i == b.num_rows:
                ends = np.cumsum([0, *(len(x) // 4 for x in texts)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(texts), dtype=np.int32)))
                decoded = pa.array([coder.decode(memoryview(x).cast("i")) for x in texts], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, i - first), ids, decoded], schema=schema)
                first, held, texts = i, 0, []


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, ids,
    decoded. Null and empty texts have no ids and decode to an empty text; texts are coded
    whole, however long; repeated rows are coded each."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from code(batches, Coder(shared.value))

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def hexdigest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hexdigest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        hexdigest(F.col("decoded")).alias("decoded_sha256"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
