"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles fall into size bands ``[l, floor(l / g)]`` for the similarity ``g``;
similar sets lie in one band or in neighbours. Two sets of at most ``r`` elements with Jaccard
similarity ``g`` or more differ in at most ``k = floor(2 r (1 - g) / (1 + g))`` elements. For
each band the domain of shingles is cut into first-level partitions and each of these into
``k2 + 1`` second-level ones; a similar pair differs in at most ``k2`` of some first-level
partition's parts, so it agrees on one of the enumerated subsets of parts: it has a signature
(hash of the set's elements in that subset) in common. Bands overlap by one narrow band: most sets emit the
signatures of one band, the others those of two.

There are a fifth more parts than ``k + 1``, and a set of a given size differs from any similar
one of the band in at most ``k' <= k`` elements. So a pair agrees on at least ``m - k'`` of ``m``
parts, and each of its sets need only emit the ``k' + 1`` parts with the most elements (then
those further back): of the parts on which the pair agrees, the last in this order has
``m - k' - 1`` before it in both sets. Parts of one or two elements, which unrelated texts with
a common line share, are mostly left out.

Pairs of sets that share a signature are verified exactly. Groups of up to ``PAIRS`` sets are
paired in full. Of a larger group only a star around its hub ``h``, the member in the most such
groups, is verified; hubs that are in one component by then make way for one of them, once more after
the first stars. Two members ``x`` and ``y`` that this leaves in different components are
not both linked with the hub; let ``x`` not be. With ``D(s)`` the symmetric difference of ``s``
and ``h``, ``x`` and ``y`` differ in ``|D(x)| + |D(y)| - 2 |D(x) & D(y)|`` elements, so they can
only be similar if the small sets ``D(x)`` and ``D(y)`` share more than ``(1 - a) / 2 * |D(y)|``
and at least ``(|D(x)| - a (|x| + |h|)) / (1 + a)`` elements, ``a = (1 - g) / (1 + g)``. A prefix
filter on the differences (elements that are not the hub's come first) finds all such pairs. One of
the two is outside the hub's component: only such members spell out their prefixes, and of the
others' only those elements leave the task that a bit filter of the former lets through. So
large groups cost a few rows per member, and no link between components is lost. Equal sets are
one node from the start.

Before the elements of two sets are compared, so are parity sketches of 512 bits: the bits in
which they differ are at most the elements in which the sets differ, which rules most pairs out
without moving their elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import stage

from .common import small, table
from .graph import components

SHINGLE = 4
PERCENT = 85
K2 = 1
WIDE = 3  # narrow bands from one band's start to the next one's
PAIRS = 24  # members of a group whose pairs are all verified at once
BLOCK = 1_000_000  # signatures a task holds before it hands them on
KNOWN_WORDS = 500_000
BITS = 512  # of a set's parity sketch, kept in 64-bit columns
SKETCH = [f"_s{i}" for i in range(BITS // 64)]
FILTER_BITS = 1 << 25  # most bits of the filter of prefix elements; beyond it lets more through


class WordHash(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | bytes | None, n: int, hashes: WordHash) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct ``n``-word shingles; with fewer words the
    whole sequence is one shingle; empty without words. bytes.lower() and bytes.split() know
    A-Z and the six ASCII space characters only."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - size + 1 + j])
    return np.unique(h)


class Bands:
    """Size bands and the parts of each band's signatures. ``tops`` are the largest sizes of
    narrow bands, of which similar sets lie in one or in neighbours; a band is ``WIDE + 1``
    narrow ones and shares its last with the next band."""

    def __init__(self, percent: int, k2: int = K2):
        self.percent, self.k2 = percent, k2
        self.tops = [1]
        self.edges: dict[int, np.ndarray] = {}

    def bands(self, size: int) -> list[int]:
        while self.tops[-1] < size:
            self.tops.append(100 * (self.tops[-1] + 1) // self.percent)
        narrow = int(np.searchsorted(self.tops, size))
        return [narrow // WIDE - 1, narrow // WIDE] if narrow and narrow % WIDE == 0 else [narrow // WIDE]

    def differences(self, total: int) -> int:
        """Most elements in which similar sets of ``total`` elements together differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int) -> tuple[int, int]:
        """Largest size of the band and its number of second-level parts: (k2 + 1) for each
        first-level partition, a fifth more than a pair can differ in."""
        while len(self.tops) <= (band + 1) * WIDE:
            self.tops.append(100 * (self.tops[-1] + 1) // self.percent)
        top = self.tops[(band + 1) * WIDE]
        k, group = self.differences(2 * top), self.k2 + 1
        return top, -(-(k + 3 + k // 5) // group) * group

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures of a sorted set. Parts are ranges of the hash, so each is a slice."""
        out = []
        for band in self.bands(len(s)):
            top, m = self.parts(band)
            k = self.differences(len(s) + min(top, 100 * len(s) // self.percent))
            if k == 0:
                continue  # only equal sets are similar
            if m not in self.edges:
                self.edges[m] = np.array([(j << 64) // m for j in range(m)], dtype=np.uint64)
            at = np.searchsorted(s, self.edges[m])
            sizes = np.diff(np.append(at, len(s)))
            places = np.argsort(sizes, kind="stable")[m - k - 1 :]
            with np.errstate(over="ignore"):
                # sums of all before a part's end, less those before its start
                ends = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(s))])
                sums = ends[at[places] + sizes[places]] - ends[at[places]]
                salt = (np.uint64(band) << np.uint64(32)) + places.astype(np.uint64)
                out.append(_mix(sums + _mix(salt + np.uint64(1))))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _set_id(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; the first names it, the second proves that the name is unique."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return _signed(d & (1 << 64) - 1), _signed(d >> 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def signature_table(docs: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """_sig, _set, _rep, _n: signatures of every distinct set of a task (_n null), and the rows
    of ``docs`` themselves: id, set and its check (null for empty sets), number of shingles. Of a
    signature that more than ``PAIRS`` sets of one block share, the surplus rows name the block's
    smallest set as their star's centre (_rep), so one signature sends few rows of each task to
    one place."""
    schema = pa.schema([("_sig", pa.int64()), ("_set", pa.int64()), ("_rep", pa.int64()), ("_n", pa.int32())])

    def flush(sigs: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        sig = np.concatenate(sigs).view(np.int64)
        own = np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in sigs])
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        lens = np.diff(np.append(starts, len(sig)))
        surplus = np.arange(len(sig)) - np.repeat(starts, lens) > PAIRS
        centre = own[np.repeat(starts, lens)]
        return _batch(schema, sig, own, pa.array(centre, pa.int64(), mask=~surplus), pa.nulls(len(sig), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, seen = WordHash(seed), Bands(percent), set()
        sigs: list[np.ndarray] = []
        ids: list[int] = []
        held = 0
        for b in batches:
            names, checks, sizes = [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), n, hashes)
                name, check = _set_id(s) if len(s) else (None, None)
                names.append(name)
                checks.append(check)
                sizes.append(len(s))
                if name is None or name in seen:
                    continue
                seen.add(name)
                found = bands.signatures(s)
                if len(found):
                    sigs.append(found)
                    ids.append(name)
                    held += len(found)
                if held > BLOCK:
                    yield flush(sigs, ids)
                    sigs, ids, held = [], [], 0
            yield _batch(schema, b.column(0), names, checks, sizes)
        if sigs:
            yield flush(sigs, ids)

    return docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("binary")).mapInArrow(run, "_sig long, _set long, _rep long, _n int")


def candidate_table(sigs: DataFrame) -> DataFrame:
    """_kind, _a, _b, _check, _n. Kind 0: a pair of sets to verify. Kind 1: membership
    (signature, set) of a group too large for all its pairs. Kind 2: a row of the documents."""
    schema = pa.schema([("_kind", pa.int8()), ("_a", pa.int64()), ("_b", pa.int64()), ("_check", pa.int64()), ("_n", pa.int32())])
    place = F.when(F.col("_rep").isNull() & F.col("_n").isNull(), F.col("_sig")).otherwise(F.xxhash64("_sig", "_set"))

    def found(kind: int, a, b) -> pa.RecordBatch:
        return _batch(schema, np.full(len(a), kind), a, b, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, own = [], []
        for b in batches:
            row = b.column(3).is_valid()
            if row.true_count:
                r = b.filter(row)
                yield _batch(schema, np.full(r.num_rows, 2), *r.columns)
                b = b.filter(pc.invert(row))
            rep = b.column(2)
            star = rep.is_valid().to_numpy(zero_copy_only=False)
            s, o = b.column(0).to_numpy(), b.column(1).to_numpy()
            sig.append(s[~star])
            own.append(o[~star])
            if star.any():
                r = rep.filter(rep.is_valid()).to_numpy()
                yield found(0, o[star], r)
                yield found(1, s[star], o[star])
        if not sig:
            return
        sig, own = np.concatenate(sig), np.concatenate(own)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        if not len(sig):
            return
        # equal sets of different tasks are one node
        first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])
        sig, own = sig[first], own[first]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        lens = np.diff(np.append(starts, len(sig)))
        large = lens > PAIRS
        member = np.repeat(large, lens)
        centre = np.repeat(own[starts], lens)
        a, b = [own[member]], [centre[member]]
        place_in = np.arange(len(sig)) - np.repeat(starts, lens)
        size = np.repeat(lens, lens)
        for gap in range(1, PAIRS):  # every pair at this distance within its group
            left = np.flatnonzero(~member & (place_in + gap < size))
            if not len(left):
                break
            a.append(own[left + gap])
            b.append(own[left])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)
        for lo in range(0, len(pairs), 200_000):
            part = pairs[lo : lo + 200_000]
            yield found(0, part[:, 0], part[:, 1])
        if member.any():
            yield found(1, sig[member], own[member])

    return sigs.repartition(place).mapInArrow(run, "_kind byte, _a long, _b long, _check long, _n int")


def overlap_of():
    """An Arrow function: number of elements two sorted sets have in common."""

    @F.arrow_udf("int")
    def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            s, t = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
            s, t = (s, t) if len(s) <= len(t) else (t, s)
            at = np.searchsorted(t, s)
            out.append(int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s)))
        return pa.array(out, pa.int32())

    return overlap


def possible(percent: int, a: str = "", b: str = "b") -> Column:
    """Whether two sets can be similar by their sizes (_n) and sketches; the second one's
    columns carry the prefix ``b``."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    bits = sum(F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in SKETCH)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (bits * (100 + percent) <= (n + m) * (100 - percent))


def sketched(sets: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """Sizes and sketches of sets, the set's id as ``name``."""
    return sets.select(F.col("_set").alias(name), *[F.col(c).alias(prefix + c) for c in ("_n", *SKETCH)])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set ids whose Jaccard similarity is ``percent`` or more."""
    near = pairs.join(sketched(sets, "a"), "a").join(sketched(sets, "b", "b"), "b").where(possible(percent)).select("a", "b")
    left = sets.select(F.col("_set").alias("a"), F.col("_elements").alias("_x"))
    right = sets.select(F.col("_set").alias("b"), F.col("_elements").alias("_y"))
    total = (F.length("_x") + F.length("_y")) / 8
    both = near.join(left, "a").join(right, "b")
    common = both.select("a", "b", total.cast("long").alias("_n"), overlap_of()(F.col("_x"), F.col("_y")).alias("_c"))
    return common.where(F.col("_c") * 100 >= (F.col("_n") - F.col("_c")) * percent).select("a", "b")


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members (_hub, _set) with _comp, of the hubs whose members span components."""
    found = members.join(comps.select(F.col("node").alias("_set"), "root"), "_set", "left")
    found = found.select("_hub", "_set", F.coalesce("root", "_set").alias("_comp"))
    span = found.groupBy("_hub").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo < _hi").select("_hub")
    return found.join(span, "_hub")


def _with_hubs(members: DataFrame, comps: DataFrame) -> DataFrame:
    """_hub, _set for members (_sig, _set) of groups, each hub among its own members. A group's
    hub is the member that belongs to the most groups; of hubs in one component the one that
    belongs to the most groups serves for all, so that near copies are compared with one set."""
    degree = members.groupBy("_set").agg(F.count("*").alias("_n"))
    ranked = members.join(degree, "_set").groupBy("_sig").agg(F.max(F.struct("_n", "_set")).alias("_top"))
    hubs = ranked.join(comps.select(F.col("node").alias("_node"), "root"), F.col("_top._set") == F.col("_node"), "left")
    hubs = hubs.select("_sig", "_top", F.coalesce("root", "_top._set").alias("_home"))
    best = hubs.groupBy("_home").agg(F.max("_top").alias("_best"))
    hubs = hubs.join(best, "_home").select("_sig", F.col("_best._set").alias("_hub"))
    found = members.join(hubs, "_sig").select("_hub", "_set")
    return found.union(found.select("_hub", F.col("_hub").alias("_set"))).distinct()


def prefix_of(percent: int, known: np.ndarray | None = None):
    """An Arrow function of the elements of a hub and of a set: the elements of their
    difference among which one lies that any similar set of another component has in the
    prefix of its own difference. With ``known``, a bit filter, it takes the hub's name as well
    and leaves out elements that the filter does not know for this hub."""
    a = (100 - percent) / (100 + percent)

    def one(x: pa.Scalar, y: pa.Scalar) -> np.ndarray:
        h, s = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
        at = np.searchsorted(h, s)
        new = s[h[np.minimum(at, len(h) - 1)] != s]
        at = np.searchsorted(s, h)
        gone = h[s[np.minimum(at, len(s) - 1)] != h]
        d = len(new) + len(gone)
        excess = d - a * (len(h) + len(s))
        # at least so many elements are shared; rounded down for the arithmetic's sake
        share = np.ceil(excess / (1 + a) - 1e-9) if excess > 0 else np.floor(d * (1 - a) / 2 - 1e-9) + 1
        return np.concatenate([new, gone])[: d - max(int(share), 1) + 1].view(np.int64)

    @F.arrow_udf("array<bigint>")
    def prefix(hub: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array([one(x, y) for x, y in zip(hub, own)], pa.list_(pa.int64()))

    @F.arrow_udf("array<bigint>")
    def known_prefix(hub: pa.Array, own: pa.Array, name: pa.Array) -> pa.Array:
        out = []
        for x, y, h in zip(hub, own, name.to_numpy()):
            e = one(x, y)
            slot = (e ^ h) & (64 * len(known) - 1)
            out.append(e[known[slot >> 6] >> (slot & 63) & 1 == 1])
        return pa.array(out, pa.list_(pa.int64()))

    return prefix if known is None else known_prefix


def bit_filter(rows: DataFrame, count: int) -> np.ndarray:
    """Bits of a filter of (_hub, _e), 16 a row and ``FILTER_BITS`` at most; names and elements are
    hashes already. Tasks merge the bits, the driver sees 64 of them a row."""
    bits = min(FILTER_BITS, max(64, 1 << (16 * count).bit_length()))
    slot = F.col("_e").bitwiseXOR(F.col("_hub")).bitwiseAND(F.lit(bits - 1))
    bit = rows.select(F.shiftright(slot, 6).alias("_at"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("_bit"))
    found = bit.groupBy("_at").agg(F.bit_or("_bit").alias("_bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found["_at"].to_numpy()] = found["_bits"].to_numpy()
    return out


def _crossing(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, by their differences from
    a common hub. One of the two is outside the hub's component."""
    home = open_.where("_set = _hub").select("_hub", F.col("_comp").alias("_home"))
    hub = sets.select(F.col("_set").alias("_hub"), F.col("_elements").alias("_x"))
    own = ["_hub", "_set", "_comp", "_n", *SKETCH]

    def spelled(members: DataFrame, prefix: Column) -> DataFrame:
        both = members.join(sets.withColumnRenamed("_elements", "_y"), "_set").join(hub, "_hub")
        rows = both.select(*own, prefix.alias("_p"))
        return stage(rows.select(*own, F.explode_outer("_p").alias("_e")).where("_e is not null"), "differences")

    pairs = open_.where("_set <> _hub").join(home, "_hub")
    far = spelled(pairs.where("_comp <> _home"), prefix_of(percent)("_x", "_y"))
    known = bit_filter(far, far.count())
    near = spelled(pairs.where("_comp = _home"), prefix_of(percent, known)("_x", "_y", "_hub"))
    rows = far.union(near)
    span = rows.groupBy("_hub", "_e").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo < _hi").select("_hub", "_e")
    rows = rows.join(span, ["_hub", "_e"])
    other = rows.select("_hub", "_e", F.col("_set").alias("b"), F.col("_comp").alias("_other"), *[F.col(c).alias("b" + c) for c in ("_n", *SKETCH)])
    both = rows.join(other, ["_hub", "_e"]).where((F.col("_comp") < F.col("_other")) & possible(percent))
    return both.select(F.col("_set").alias("a"), "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id integer, text; other columns are ignored): doc_id,
    n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null and empty texts and texts without words have an empty set and are linked with
    nothing: their component is themselves. Repeated rows and equal sets are one node. A row
    with a null id belongs to its component like any other but never names it, unless there is
    no other id. Shingles are told apart by 64-bit hashes; set names are checked by further 64
    bits and hashed anew with another seed should two sets ever share one.
    """
    spark = docs.sparkSession
    found = stage(candidate_table(signature_table(docs, n, percent, seed)), "candidates")
    rows = found.where("_kind = 2").select(F.col("_a").alias("_doc"), F.col("_n").cast("long").alias("n_shingles"), F.col("_b").alias("_set"), "_check")
    named = rows.where("_set is not null")
    first = named.groupBy("_set").agg(F.min("_doc").alias("_first"), F.min("_check").alias("_lo"), F.max("_check").alias("_hi"))
    if first.where("_lo <> _hi").limit(1).count():
        return similar_groups(docs, n, percent, seed + 1)

    pairs = stage(_ordered(found.where("_kind = 0").select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "pairs")
    members = stage(found.where("_kind = 1").select(F.col("_a").alias("_sig"), F.col("_b").alias("_set")).distinct(), "members")

    # the elements of the sets that are compared; one document of each
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_set")).union(members.select("_set")).distinct()
    wanted = stage(wanted.join(first.select("_set", "_first"), "_set").where("_first is not null"), "wanted")
    ids = small(wanted.select("_first"), wanted.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("_first"), F.col("text").cast("binary").alias("_text")).join(ids, "_first")
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("_first"), F.col("text").cast("binary").alias("_text"))
    sets = stage(element_table(texts.unionByName(nameless), n, seed), "elements")
    # several rows may carry the id that stands for a set; usually none do
    if sets.count() != sets.select("_set").distinct().count():
        sets = stage(sets.dropDuplicates(["_set"]), "elements")

    links = stage(verified(pairs, sets, percent), "links")
    comps = components(links)
    done = pairs
    for turn in ("stars", "stars again", "crossing"):
        if turn != "crossing":
            # the first stars leave most hubs in few components, so fewer hubs serve for all
            hubs = stage(_with_hubs(members, comps), "hubs")
        open_ = stage(_open(hubs, comps), "open")
        if not open_.limit(1).count():
            break
        if turn != "crossing":
            home = open_.where("_set = _hub").select("_hub", F.col("_comp").alias("_home"))
            more = open_.join(home, "_hub").where("_comp <> _home").select(F.col("_set").alias("a"), F.col("_hub").alias("b"))
        else:
            more = _crossing(open_, sets, percent)
        more = stage(_ordered(more).join(done, ["a", "b"], "left_anti"), "pairs")
        fresh = stage(verified(more, sets, percent), "links")
        done = done.unionByName(more)
        if fresh.limit(1).count():
            links = links.unionByName(fresh)
            comps = components(links)

    root = rows.join(comps.select(F.col("node").alias("_set"), "root"), "_set", "left").select("_doc", "n_shingles", F.coalesce("root", "_set").alias("_root"))
    least = root.where("_root is not null").groupBy("_root").agg(F.min("_doc").alias("component_id"))
    return root.join(least, "_root", "left").select(F.col("_doc").alias("doc_id"), "n_shingles", F.coalesce("component_id", "_doc").alias("component_id"))


def element_table(texts: DataFrame, n: int, seed: int) -> DataFrame:
    """_set, _elements (sorted 64-bit hashes as bytes), _n and the parity sketch of texts."""
    types = [("_set", pa.int64()), ("_elements", pa.binary()), ("_n", pa.int32()), *((c, pa.int64()) for c in SKETCH)]
    schema = pa.schema(types)

    def sketch(s: np.ndarray) -> list[int]:
        odd = np.bincount((s >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(seed)
        for b in batches:
            sets = [shingle_set(t.as_py(), n, hashes) for t in b.column(0)]
            rows = [(_set_id(s)[0], s.tobytes(), len(s), *sketch(s)) for s in sets if len(s)]
            if rows:
                yield _batch(schema, *zip(*rows))

    return texts.select("_text").mapInArrow(run, "_set long, _elements binary, _n int, " + ", ".join(f"{c} long" for c in SKETCH))


def keep_first(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller
    doc_id. Rows without words or without id stay; of repeated rows with one id all stay."""
    groups = similar_groups(docs, n, percent)
    surplus = stage(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_surplus")).distinct(), "surplus")
    surplus = small(surplus, surplus.count())
    return docs.join(surplus, docs["doc_id"] == surplus["_surplus"], "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
e AS (SELECT doc_id, least(len(w), 4) n, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') s FROM e),
c AS (SELECT doc_id, count(*) q FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 85 * (x.q + y.q - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE t(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, t.root FROM t JOIN u ON u.a = t.node WHERE t.root < u.b)
  SELECT node, min(root) root FROM t GROUP BY node)
SELECT d.doc_id, coalesce(q, 0) n_shingles, coalesce(least(root, d.doc_id), d.doc_id) component_id FROM d LEFT JOIN c USING (doc_id) LEFT JOIN r ON r.node = d.doc_id
"""
