"""Token ids as length-delimited binary records with an offset index.

A shard is a file of frames: the payload's length (u64), the masked checksum of those eight
bytes (u32), the payload, and the masked checksum of the payload (u32), little-endian as in
TFRecord files but with the CRC-32 of zlib. A payload is the document's id (i64, a null id is
the smallest number) and its token ids, two bytes each where the vocabulary allows it, else
four. Beside each shard lies an index of u64 offsets, one per record and the end, for reads in
any order. Shards are written by the tasks of a range-partitioned, sorted table; a task names
its files anew at each attempt, and only the files in the manifest, which Spark commits, count,
so a lost executor leaves nothing but unused files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import shared_dir

from .bpe import LONGEST, NOT_SPACE, REMEMBERED, SPACE, byte_letters
from .common import table, whole

END = 1
NO_ID = -(2**63)
HEAD, CHECK = struct.Struct("<QI"), struct.Struct("<I")
BATCH_BYTES = 4_000_000
SLICE = 500  # rows of a batch that become Python objects at a time


def masked(data: bytes) -> int:
    """CRC-32 rotated and shifted, so that a checksum of checksums is not degenerate."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, CHECK.pack(masked(size)), payload, CHECK.pack(masked(payload))))


def take(stream) -> bytes | None:
    """The next payload of a stream; None at its end."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or HEAD.unpack(head)[1] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = HEAD.unpack(head)[0]
    body = stream.read(size + CHECK.size)
    if len(body) < size + CHECK.size or CHECK.unpack(body[size:])[0] != masked(body[:size]):
        raise ValueError("damaged record")
    return body[:size]


# Letters that NFC leaves alone and lower() maps one to one, and ASCII punctuation after them.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-/:-@\[-`{-~]*)")
# The settings under which such letters are one word of the vocabulary's and the rest another.
NORMALIZER = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Encoder(dict):
    """Texts to id bytes with the tokenizers library. White space separates the vocabulary's
    words: texts are cut there, and a worker remembers what it has encoded. Of a chunk that
    is letters and punctuation after them, both are words of their own, and case is dropped: they
    go to the library's model alone, past its normalizer, so many chunks share them. Others
    go through the whole library. As a dict it maps a chunk between white space to its id
    bytes."""

    def __init__(self, path: str):
        super().__init__()
        # a task has one core; the library's own threads would only hold memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.letters = dict(enumerate(byte_letters()))
        self.model = self.library.model if self._cuts() else None

    def _cuts(self) -> bool:
        """Whether the library cuts and folds words as ``PLAIN`` takes it to."""
        steps = [json.loads(x.__getstate__()) if x else {} for x in (self.library.normalizer, self.library.pre_tokenizer)]
        folds = [(x["type"], x.get("pattern")) for x in steps[0].get("normalizers", [])]
        split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
        special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        return folds == NORMALIZER and steps[1].get("pretokenizers") == [split, BYTES] and not any(map(PLAIN.fullmatch, special))

    def __missing__(self, chunk: str) -> bytes:
        plain = PLAIN.fullmatch(chunk) if self.model else None
        if plain and plain[1]:
            out = self.word(plain[1].lower())
            if plain[2]:
                out += self.word(plain[2])
        else:
            out = np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype=self.type).tobytes()
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.clear()
            self[chunk] = out
        return out

    def word(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            out = np.array([t.id for t in self.model.tokenize(raw)], dtype=self.type).tobytes()
            if len(word) <= LONGEST:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = out
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Id bytes of each text."""
        for t in texts:
            yield b"".join(map(self.__getitem__, SPACE.split(t) if NOT_SPACE.search(t) else t.split()))


# One per worker process and tokenizer, so that what a task has learned serves the next one.
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, folder: str, path: str, end: int = END) -> list[dict]:
    """Encodes ``docs`` (doc_id integer, text; other columns are ignored), appends ``end`` to
    each, and writes shards in ascending order of doc_id (nulls first, then by text).

    Null and empty texts are written with the end id alone; repeated rows are written each; an
    empty table makes no shard. Returns the manifest in order: shard, file, records, tokens
    and bytes, one entry per shard.
    """
    schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by name: the function travels by value, and the module's encoders are the worker's own
        from threadlake.llm.token_records import encoder_of

        encoder, shard = encoder_of(path), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:08d}-{uuid.uuid4().hex}"
        last, offsets, tokens, out = encoder.type.type(end).tobytes(), [0], 0, None
        try:
            for b in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
                for number, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                    data = frame(struct.pack("<q", number) + ids + last)
                    if out is None:
                        out = store.open_output_stream(f"{name}.rec", buffer_size=1 << 20)
                    out.write(data)
                    offsets.append(offsets[-1] + len(data))
                    tokens += len(ids) // encoder.type.itemsize + 1
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        with store.open_output_stream(f"{name}.idx") as index:
            index.write(np.array(offsets, dtype="<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [os.path.basename(name)], "records": [len(offsets) - 1], "tokens": [tokens], "bytes": [offsets[-1]]}, schema)

    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_n")
    rows = docs.select(number, whole("text").alias("_t"))
    ordered = rows.repartitionByRange("_n", F.xxhash64("_t")).sortWithinPartitions("_n", "_t")
    manifest = ordered.mapInArrow(write, "shard long, file string, records long, tokens long, bytes long").collect()
    return [r.asDict() for r in sorted(manifest, key=lambda r: r["shard"])]


def read_records(spark: SparkSession, folder: str, manifest: list[dict], path: str, seed: int | None = None) -> DataFrame:
    """doc_id, start (ids in all records before it), ids (little-endian u32 bytes, the end id
    included) of every record, its checksums verified. With a ``seed`` each shard is read in
    a shuffled order, record by record, by its offset index."""
    from tokenizers import Tokenizer

    width = np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    bases = np.cumsum([0, *(m["tokens"] for m in manifest)])
    shards = [(int(i), m["file"], int(base)) for i, (m, base) in enumerate(zip(manifest, bases))]

    def records(store, name: str, base: int, shard: int):
        if seed is None:
            with store.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as f:
                while (payload := take(f)) is not None:
                    yield payload, base
                    base += (len(payload) - 8) // width.itemsize
            return
        with store.open_input_stream(f"{name}.idx") as f:
            offsets = np.frombuffer(f.read(), dtype="<u8").astype(np.int64)
        # a frame is 16 bytes longer than its payload, and 8 of those are the id
        starts = base + np.cumsum(np.append(0, (np.diff(offsets) - 24) // width.itemsize))
        with store.open_input_file(f"{name}.rec") as f:
            for i in np.random.default_rng([seed, shard]).permutation(len(offsets) - 1):
                f.seek(int(offsets[i]))
                yield take(f), int(starts[i])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for shard, file, base in zip(*(c.to_pylist() for c in b.columns)):
                rows, held = [], 0
                for payload, start in records(store, f"{root}/{file}", base, shard):
                    (number,) = struct.unpack_from("<q", payload)
                    ids = np.frombuffer(payload, dtype=width, offset=8).astype("<u4").tobytes()
                    rows.append((None if number == NO_ID else number, start, ids))
                    held += len(ids)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    listing = spark.createDataFrame(shards, "shard long, file string, base long").repartition(max(1, len(shards)))
    return listing.mapInArrow(read, "doc_id long, start long, ids binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = os.path.join(shared_dir(spark), f"records-{uuid.uuid4().hex}")
    manifest = write_records(table(spark, sf_dir, "documents"), folder, path)
    found = read_records(spark, folder, manifest, path)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
