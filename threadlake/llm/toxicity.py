"""Toxicity scores from a convolutional text classifier.

A word is embedded as the sum of hashed vectors: one for the whole word and one for each of
a few prefix lengths, so inflected forms share evidence. Filters of several widths slide
over the words, each keeps its largest response in the text (max pooling over the whole
text), and a logistic unit turns the pooled responses into a score. Every labelled row takes
part: words are counted by label over all of them, then shards of rows train copies of the
model in parallel, whose changes are averaged, for a few rounds. Thresholds are calibrated
per language on a fifth of the rows that the training did not see. Scoring is an Arrow
function over every row.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import stage, staging

from .common import small, table, whole

TOKEN = re.compile(r"\w+")
# A whole word and its prefixes of these lengths each have a hashed vector.
PREFIXES = (4, 5, 6)
KNOWN_WORDS = 400_000  # words a worker remembers before it starts afresh
DRAWS = 1 << 62  # values of an id's draw, so that classes of any size get their share
# About what a shard of the training holds; a set of one shard is trained by the driver.
SHARD_ROWS = 4096
SHARD_CHARS = 64_000_000
BLOCK_CHARS = 2_000_000  # letters whose words are handled at once
PIECE_WORDS = 1 << 18  # words whose responses are held at once
UNIT = 1 << 32  # changes are summed as whole numbers of 1 / UNIT, in any order
STEPS = 256  # values of a score before calibration, per unit


@dataclass
class Settings:
    """``epochs`` is divided among ``rounds``, between which the shards' models are averaged.
    Training sees all labelled rows unless ``sample_rows`` asks for about that many of each
    class only."""

    buckets: int = 1 << 18
    dim: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    sample_rows: int | None = None
    epochs: int = 4
    rounds: int = 2
    batch: int = 64
    rate: float = 0.02
    seed: int = 7
    cut: float = 0.7


def features(word: str, buckets: int) -> list[int]:
    keys = [word, *("^" + word[:n] if len(word) >= n else "" for n in PREFIXES)]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % (buckets - 1) + 1 if k else 0 for k in keys]


class Words(dict):
    """Word to a running number; number 0 is the padding between texts."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets
        self.rows: list[list[int]] = [[0] * (1 + len(PREFIXES))]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.rows)
        self.rows.append(features(word, self.buckets))
        return n

    def shrink(self) -> None:
        """Starts afresh when too many words are known."""
        if len(self) > KNOWN_WORDS:
            self.clear()
            del self.rows[1:]


def flatten(texts: list[str], words: Words, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each text followed by ``gap`` paddings, and their starts."""
    out: list[int] = []
    starts = []
    pad = [0] * gap
    for text in texts:
        starts.append(len(out))
        out += map(words.__getitem__, TOKEN.findall(text.lower()))
        out += pad
    return np.array(out, dtype=np.int64), np.array(starts, dtype=np.int64)


def blocks(texts: list[str]) -> Iterator[slice]:
    """Stretches of the texts, each ended by the one that fills ``BLOCK_CHARS``."""
    lo = chars = 0
    for i, text in enumerate(texts, 1):
        chars += len(text)
        if chars > BLOCK_CHARS or i == len(texts):
            yield slice(lo, i)
            lo, chars = i, 0


@dataclass
class Model:
    settings: Settings
    table: np.ndarray  # buckets x dim, row 0 is zero
    kernels: list[np.ndarray]  # per width: width x dim x filters
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def pooled(self, flat: np.ndarray, starts: np.ndarray, vectors: np.ndarray, places: bool = False):
        """Largest response per text and filter (0 at least), and where it is. Responses are
        held for ``PIECE_WORDS`` at a time, so a long text takes no more than its words."""
        n = len(flat)
        best, where = [], []
        for kernel, bias in zip(self.kernels, self.biases):
            parts = [vectors @ part for part in kernel]
            top = np.full((len(starts), self.settings.filters), -np.inf)
            found = np.zeros(top.shape, dtype=np.int64)
            for lo in range(0, n, PIECE_WORDS):
                hi = min(n, lo + PIECE_WORDS)
                conv = np.tile(bias.astype(np.float32), (hi - lo, 1))
                for j, part in enumerate(parts):
                    words = flat[lo + j : hi + j]
                    conv[: len(words)] += part[words]
                conv *= (flat[lo:hi] > 0)[:, None]  # windows start at words; a padding stands for "no response"
                first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)
                begin = np.maximum(starts[first:last], lo) - lo
                here = np.maximum.reduceat(conv, begin, axis=0)
                if places:
                    lens = np.diff(np.append(begin, hi - lo))
                    at = np.where(conv == np.repeat(here, lens, axis=0), np.arange(lo, hi)[:, None], n)
                    at = np.minimum.reduceat(at, begin, axis=0)
                    found[first:last] = np.where(here > top[first:last], at, found[first:last])
                top[first:last] = np.maximum(top[first:last], here)
            best.append(np.maximum(top, 0))
            where.append(found)
        return np.concatenate(best, axis=1), where

    def dense(self) -> np.ndarray:
        """All weights but the table's, in rows of ``dim``."""
        own = np.concatenate([self.out, *(k.ravel() for k in self.kernels), *self.biases, [self.bias]])
        return np.append(own, np.zeros(-len(own) % self.settings.dim)).reshape(-1, self.settings.dim)

    def add_dense(self, change: np.ndarray) -> None:
        change, at = change.ravel(), 0
        for part in (self.out, *self.kernels, *self.biases):
            part += change[at : at + part.size].reshape(part.shape).astype(part.dtype)
            at += part.size
        self.bias += float(change[at])

    def logits(self, texts: list[str], words: Words) -> np.ndarray:
        """Scores before the calibration; texts are taken in blocks of bounded length."""
        gap = max(self.settings.widths)
        done = [self._block(texts[part], words, gap) for part in blocks(texts)]
        return np.concatenate(done) if done else np.zeros(0)

    def _block(self, texts: list[str], words: Words, gap: int) -> np.ndarray:
        words.shrink()
        flat, starts = flatten(texts, words, gap)
        used, flat = np.unique(np.append(flat, 0), return_inverse=True)
        vectors = self.table[np.array([words.rows[n] for n in used])].sum(axis=1)
        pooled, _ = self.pooled(flat[:-1], starts, vectors)
        return pooled @ self.out + self.bias

    def scores(self, texts: list[str], words: Words) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts, words) + b, -30, 30)))


def presence(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, label: np.ndarray, buckets: int) -> np.ndarray:
    """How many clean and toxic texts each bucket is in."""
    ends = np.append(starts[1:], len(flat))
    seen = np.zeros((2, buckets), dtype=np.int64)
    for s, e, y in zip(starts, ends, label):
        seen[y, np.unique(rows[flat[s:e]])] += 1
    return seen


def evidence(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of each bucket's presence in toxic against clean texts, ``n`` of each."""
    rate = (seen + 0.5) / (n[:, None] + 1)
    odds = np.log(rate[1]) - np.log(rate[0]) - np.log((n[0] + 1) / (n[1] + 1))
    odds[0] = 0
    return odds


def untrained(settings: Settings) -> Model:
    s, rng = settings, np.random.default_rng(settings.seed)
    shape = [(w, s.dim, s.filters) for w in s.widths]
    model = Model(
        s,
        rng.normal(0, 0.02, (s.buckets, s.dim)).astype(np.float32),
        [rng.normal(0, 0.1, x).astype(np.float32) for x in shape],
        [np.full(s.filters, -0.1) for _ in s.widths],
        np.full(s.filters * len(s.widths), 0.5),
        -1.0,
    )
    model.table[0] = 0
    return model


def one_class(model: Model, toxic: bool) -> Model:
    """With one class only (or no rows) the score is constant: the class, or 0."""
    model.scale = (0.0, 30.0 if toxic else -30.0)
    return model


def begin(model: Model, odds: np.ndarray) -> None:
    """The first channel starts from each bucket's log odds; gradients go on from there."""
    model.table[:, 0] = np.clip(odds, -4, 4) / 8
    for kernel in model.kernels:
        kernel[0, 0, :] += 1.0


def fit(texts: list[str], label: np.ndarray, langs: list[str | None], settings: Settings) -> Model:
    """Trains on four fifths of the rows and calibrates on the rest."""
    s, rng = settings, np.random.default_rng(settings.seed + 1)
    label = np.asarray(label, dtype=np.int64)
    model = untrained(s)
    if len(set(label.tolist())) < 2:
        return one_class(model, len(label) > 0 and bool(label[0]))
    order = rng.permutation(len(texts))
    held = order[: len(texts) // 5]
    held = held if len(set(label[held].tolist())) == 2 else order
    seen = order[len(texts) // 5 :]
    seen = seen if len(set(label[seen].tolist())) == 2 else order

    words = Words(s.buckets)
    flat, starts = flatten([texts[i] for i in seen], words, max(s.widths))
    rows, y = np.array(words.rows), label[seen]
    begin(model, evidence(presence(flat, starts, rows, y, s.buckets), np.bincount(y, minlength=2)))
    learn(model, flat, starts, rows, y, s.epochs, rng)
    x = model.logits([texts[i] for i in held], Words(s.buckets))
    calibrate(model, x, label[held], [langs[i] for i in held], np.ones(len(held)))
    return model


def learn(model: Model, flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int, rng) -> None:
    """Changes ``model`` by gradients of batches of texts (word numbers, their buckets, labels)."""
    s = model.settings
    ends = np.append(starts[1:], len(flat))
    params = {"out": model.out, **{f"k{i}": k for i, k in enumerate(model.kernels)}, **{f"b{i}": b for i, b in enumerate(model.biases)}}
    moment = {k: [np.zeros(v.shape), np.zeros(v.shape)] for k, v in params.items()}
    table2 = np.zeros(s.buckets, dtype=np.float32)
    step, bias2 = 0, 0.0
    for _ in range(epochs):
        shuffled = rng.permutation(len(starts))
        for lo in range(0, len(starts), s.batch):
            docs = shuffled[lo : lo + s.batch]
            pieces = [flat[starts[d] : ends[d]] for d in docs]
            here = np.concatenate(pieces)
            first = np.cumsum([0] + [len(p) for p in pieces[:-1]])
            used, here = np.unique(here, return_inverse=True)
            vectors = model.table[rows[used]].sum(axis=1)
            pooled, where = model.pooled(here, first, vectors, places=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30)))
            g = (p - y[docs]) / len(docs)
            grads = {"out": pooled.T @ g}
            back = np.outer(g, model.out) * (pooled > 0)
            to_words = np.zeros_like(vectors)
            for i, (kernel, at) in enumerate(zip(model.kernels, where)):
                part = back[:, i * s.filters : (i + 1) * s.filters]
                d, f = np.nonzero(part)
                value, pos = part[d, f], at[d, f]
                dk = np.zeros(kernel.shape)
                for j in range(len(kernel)):
                    ok = pos + j < len(here)
                    word, fj, vj = here[pos[ok] + j], f[ok], value[ok]
                    np.add.at(dk[j].T, fj, vectors[word] * vj[:, None])
                    np.add.at(to_words, word, kernel[j].T[fj] * vj[:, None])
                grads[f"k{i}"], grads[f"b{i}"] = dk, part.sum(axis=0)
            step += 1
            for k, grad in grads.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                params[k] -= (s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(params[k].dtype)
            bias2 += g.sum() ** 2
            model.bias -= 0.1 * g.sum() / (np.sqrt(bias2) + 1e-6)
            moved = np.flatnonzero(np.abs(to_words).sum(axis=1))
            if len(moved):
                for column in rows[used[moved]].T:
                    np.add.at(table2, column, (to_words[moved] ** 2).sum(axis=1))
                for column in rows[used[moved]].T:
                    np.add.at(model.table, column, -s.rate * to_words[moved] / (np.sqrt(table2[column]) + 1e-6)[:, None])
                model.table[0] = 0


def calibrate(model: Model, x: np.ndarray, label: np.ndarray, langs: list[str | None], n: np.ndarray) -> None:
    """Logistic scaling of the scores ``x``, each of ``n`` rows, then per language the threshold
    midway between the best cut's neighbours; languages with fewer than five rows of a class
    use the cut over all."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = n * (p - label), n * np.maximum(p * (1 - p), 1e-6)
        # a little shrinkage keeps separable classes finite
        h = np.array([[np.sum(w * x * x) + 0.05, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.05]])
        da, db = np.linalg.solve(h, [np.sum(g * x) + 0.05 * (a - 1), np.sum(g) + 0.05 * b])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    model.scale = (float(max(a, 1e-3)), float(b))
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * x + model.scale[1], -30, 30)))
    model.threshold = best_cut(p, label, n)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if min(np.sum(n[own & (label == 1)]), np.sum(n[own & (label == 0)])) >= 5:
            model.thresholds[lang] = best_cut(p[own], label[own], n[own])


def best_cut(p: np.ndarray, label: np.ndarray, n: np.ndarray) -> float:
    """The threshold with the fewest errors, in the middle of the widest such gap."""
    order = np.argsort(p, kind="stable")
    p, label, n = p[order], label[order], n[order]
    wrong = np.concatenate([[0], np.cumsum(n * label)]) + np.concatenate([np.cumsum((n * (label == 0))[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], p, [1.0]])
    gaps = np.diff(edges)
    best = np.flatnonzero(wrong == wrong.min())
    i = best[np.argmax(gaps[best])]
    return float((edges[i] + edges[i + 1]) / 2)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(marked: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` ids of each class, chosen by the hash of the id."""
    counts = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    draw = F.pmod(F.xxhash64("_id"), F.lit(DRAWS))
    chosen = F.lit(False)
    for y, n in counts.items():
        chosen = chosen | ((F.col("_y") == y) & (draw < min(DRAWS, DRAWS * rows // n)))
    return marked.where(chosen)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fits on all labelled rows outside the held-out fold, whatever their number and length.
    Rows without id or label do not take part; of several labels of one id the largest counts,
    of several rows of one id the one whose text has the smallest hash. What is one shard is
    fitted by the driver, more by ``fit_shards``."""
    spark, s = docs.sparkSession, settings or Settings()
    marked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
        .groupBy("_id")
        .agg((F.max("_y") > 0).alias("_y"))
    )
    if s.sample_rows is not None:
        marked = drawn(marked, s.sample_rows)
    texts = docs.where(~held_out()).select(F.col("doc_id").alias("_id"), whole("text").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    pool = texts.join(small(marked, marked.count()), "_id")
    one = F.min(F.struct(F.xxhash64("_text").alias("_h"), "_text", "_lang")).alias("_r")
    pool = pool.groupBy("_id", "_y").agg(one).select("_id", "_y", "_r._text", "_r._lang")
    fifth = F.pmod(F.xxhash64(F.lit("held"), "_id"), F.lit(5)) == 0
    with staging(spark) as folder:
        pool = stage(pool.withColumn("_held", fifth), "labelled", folder)
        sizes = pool.groupBy("_held", "_y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_text")).alias("chars")).collect()
        if sum(r["n"] for r in sizes) > SHARD_ROWS or sum(r["chars"] for r in sizes) > SHARD_CHARS:
            return fit_shards(pool, sizes, s)
        taken = sorted((r[0], int(r[1]), r[2] or "", r[3]) for r in pool.select("_id", "_y", "_lang", "_text").collect())
    return fit([t[3] for t in taken], np.array([t[1] for t in taken], dtype=np.int64), [t[2] or None for t in taken], s)


def fit_shards(pool: DataFrame, sizes: list, settings: Settings) -> Model:
    """``fit`` over rows of any number (_id, _y, _text, _lang, _held). The driver holds models
    and sums of the models' size, and counts of the calibration's rounded scores."""
    spark, s = pool.sparkSession, settings
    model = untrained(s)
    classes = {part: {r["_y"] for r in sizes if r["_held"] == part} for part in (True, False)}
    both = {r["_y"] for r in sizes}
    if len(both) < 2:
        return one_class(model, True in both)
    held, seen = (pool.where(F.col("_held") == part) if len(classes[part]) == 2 else pool for part in (True, False))
    used = [r for r in sizes if len(classes[False]) < 2 or not r["_held"]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(s.buckets), np.zeros((2, s.buckets), dtype=np.int64)
        for batch in batches:
            texts, y = batch.column("_text").to_pylist(), np.array(batch.column("_y").to_pylist(), dtype=np.int64)
            for part in blocks(texts):
                words.shrink()
                flat, starts = flatten(texts[part], words, max(s.widths))
                total += presence(flat, starts, np.array(words.rows), y[part], s.buckets)
        found = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch({"bucket": found, "clean": total[0, found], "toxic": total[1, found]})

    counts = seen.select("_text", "_y").mapInArrow(count, "bucket long, clean long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    total = np.zeros((2, s.buckets), dtype=np.int64)
    for y, name in enumerate(("clean", "toxic")):
        total[y, counts["bucket"].to_numpy()] = counts[name].to_numpy()
    begin(model, evidence(total, np.array([sum(r["n"] for r in used if r["_y"] == y) for y in (False, True)])))

    shards = max(1, sum(r["n"] for r in used) // SHARD_ROWS, sum(r["chars"] for r in used) // SHARD_CHARS)
    # in the order of their ids, so that a shard always learns the same
    dealt = (
        seen.select("_id", "_text", "_y", F.pmod(F.xxhash64(F.lit("shard"), "_id"), F.lit(shards)).alias("_shard"))
        .repartitionByRange(shards, "_shard")
        .sortWithinPartitions("_shard", "_id")
    )
    for i in range(s.rounds):
        epochs = s.epochs // s.rounds + (i < s.epochs % s.rounds)
        average(model, dealt, epochs, s.seed + 1 + i)

    shared = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(s.buckets)
        for batch in batches:
            x = np.rint(np.clip(shared.value.logits(batch.column("_text").to_pylist(), words), -1000, 1000) * STEPS)
            yield pa.record_batch({"lang": batch.column("_lang"), "y": batch.column("_y"), "x": x.astype(np.int64)})

    rated = held.select("_text", "_lang", "_y").mapInArrow(rate, "lang string, y boolean, x long")
    rated = rated.groupBy("lang", "y", "x").count().toArrow().sort_by([("lang", "ascending"), ("y", "ascending"), ("x", "ascending")])
    shared.unpersist()
    y, n = (np.array(rated[c].to_pylist(), dtype=np.int64) for c in ("y", "count"))
    calibrate(model, rated["x"].to_numpy() / STEPS, y, [lang or None for lang in rated["lang"].to_pylist()], n)
    return model


def average(model: Model, dealt: DataFrame, epochs: int, seed: int) -> None:
    """Adds to ``model`` the mean change that the shards of ``dealt`` (_shard, _text, _y) make to
    copies of it; a bucket's mean is over the shards that changed it."""
    s = model.settings
    values = [f"d{i}" for i in range(s.dim)]
    shared = dealt.sparkSession.sparkContext.broadcast(model)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, gap = Words(s.buckets), max(s.widths)
        flats, begins, y, size = [], [], [], 0
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            y += batch.column("_y").to_pylist()
            for part in blocks(texts):
                flat, starts = flatten(texts[part], words, gap)
                flats.append(flat.astype(np.int32))
                begins.append(starts + size)
                size += len(flat)
        own = copy.deepcopy(shared.value)
        y = np.array(y, dtype=np.int64)
        learn(own, np.concatenate(flats), np.concatenate(begins), np.array(words.rows), y, epochs, np.random.default_rng(seed))
        moved = np.flatnonzero((own.table != shared.value.table).any(axis=1))
        table = own.table[moved].astype(float) - shared.value.table[moved]
        dense = own.dense() - shared.value.dense()
        change = np.rint(np.concatenate([table, dense]) * UNIT).astype(np.int64)
        key = np.concatenate([moved, -1 - np.arange(len(dense))])
        yield pa.record_batch({"key": key, **{c: change[:, i].copy() for i, c in enumerate(values)}})

    schema = ", ".join(f"{c} long" for c in ("key", *values))
    changes = dealt.groupBy("_shard").applyInArrow(learned, schema)
    mean = changes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in values)).toArrow()
    shared.unpersist()
    key = mean["key"].to_numpy()
    change = np.stack([mean[c].to_numpy() for c in values], axis=1) / UNIT / mean["n"].to_numpy()[:, None]
    model.table[key[key >= 0]] += change[key >= 0].astype(np.float32)
    dense = np.zeros(model.dense().shape)
    dense[-1 - key[key < 0]] = change[key < 0]
    model.add_dense(dense)


def scorer(spark: SparkSession, model: Model):
    """An Arrow function text -> score; the model has a fixed size and is broadcast."""
    shared = spark.sparkContext.broadcast(model)
    kept: dict[int, Words] = {}

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        own = shared.value
        words = kept.setdefault(0, Words(own.settings.buckets))
        return pa.array(own.scores([t or "" for t in text.to_pylist()], words), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang; other columns are ignored):
    doc_id, held_out, score, predicted (score >= ``cut``), threshold (of the row's language,
    the common one where the language is null or unknown), toxic (score >= threshold).

    A null or empty text, and one without words, gets the score of "no response". Repeated
    rows are scored each. Empty documents give an empty result, empty labels the score 0.
    """
    spark, s = docs.sparkSession, settings or Settings()
    model = train(docs, labels, s)
    limit = F.lit(model.threshold)
    for lang, value in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == lang, value).otherwise(limit)
    scored = docs.select("doc_id", held_out().alias("held_out"), limit.alias("threshold"), scorer(spark, model)(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= s.cut).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("toxic")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below their language's threshold
    and below ``cut``."""
    s = settings or Settings()
    model = train(docs, labels, s)
    limit = F.lit(min(model.threshold, s.cut))
    for lang, value in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == lang, min(value, s.cut)).otherwise(limit)
    return docs.where(scorer(docs.sparkSession, model)(F.col("text")) < limit)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
