"""Collocations: phrases against brute force, filters and keys as exact round trips."""

import re
from collections import Counter

import numpy as np
import pytest

from threadlake.llm import collocations as c


def plain(docs, least=30, percent=80, top=2000):
    counts, sizes = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            sizes[lang] += len(words)
            for n in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        within = Counter()
        for g, a in found.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    within[g[i : i + n]] = max(within[g[i : i + n]], a)
        rows = []
        for g, a in found.items():
            score, _, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            if 100 * within[g] < percent * a:
                rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, sizes[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def documents():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)] + ["É", "The", "a-b", "\x1c", "  ", "."]
    docs = []
    for i in range(300):
        parts = [str(x) for x in rng.choice(words, 60)]
        for _ in range(int(rng.integers(0, 4))):
            parts.insert(int(rng.integers(0, 60)), ["New York City", "Once upon a time", "once\tupon", "of the, of the"][int(rng.integers(0, 4))])
        docs.append((["en", "de", None, "und"][i % 4], " ".join(parts)))
    return docs + [("en", None), ("en", ""), ("fr", " . "), ("xx", "one"), (None, None), ("de", "x" * 5000)]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, flushes and shards
        for name, value in (("BLOCK_TOKENS", 500), ("BLOCK_WORDS", 60), ("HELD", 300), ("SHARD", 2000)):
            monkeypatch.setattr(c, name, value)
    docs = documents()
    df = spark.createDataFrame([(i, lang, t, i) for i, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string, n long").repartition(4)
    for least, percent, top in ((30, 80, 2000), (5, 50, 7)):
        got = sorted(tuple(r) for r in c.collocations(df, least, percent, top).select(*COLUMNS).collect())
        assert got == plain(docs, least, percent, top)
        assert got


@pytest.mark.parametrize("width", [1, 5, 16, 17, 21, 32])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_keys_are_read_back(n, width):
    rng = np.random.default_rng(n * width)
    ids = [rng.integers(0, 1 << width, 3000, dtype=np.uint64) for _ in range(n)]
    key = c.Keys(n, width)
    lead, spare = key.pack(ids)
    assert all((x == y).all() for x, y in zip(ids, key.unpack(lead, spare)))
    if key.lead < 64:
        assert int(lead.max()) < 1 << key.lead
    distinct = set(zip(*(x.tolist() for x in ids)))
    assert len(c.tally(lead, spare)[0]) == len(distinct)


@pytest.mark.parametrize("bits", [3, 8, 12, 31, 40, 63, 64])
@pytest.mark.parametrize("n", [1, 2, 200, 5000])
def test_filters_are_lossless(n, bits):
    rng = np.random.default_rng(bits)
    lead = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(1, 4, len(lead)) * rng.choice([1, 1, 1, 200, 10**12], len(lead))
    for spare in (np.zeros(0, np.uint64), rng.integers(0, 9, len(lead), dtype=np.uint64), rng.integers(0, 1 << 32, len(lead), dtype=np.uint64)):
        data = c.Filter.encode(lead, spare, counts, bits)
        back = c.Filter.decode(data)
        assert all((x == y).all() and len(x) == len(y) for x, y in zip((lead, spare, counts), back))
    if len(lead) == 5000 and bits >= 31:
        assert len(c.Filter.encode(lead, np.zeros(0, np.uint64), np.ones(len(lead), np.int64), bits)) < len(lead) * (bits / 8 + 1)


def test_merge_adds_counts():
    one = (np.array([1, 5, 9], np.uint64), np.array([3, 0, 1], np.uint64), np.array([1, 2, 300]))
    two = (np.array([1, 1, 9], np.uint64), np.array([3, 4, 1], np.uint64), np.array([10, 20, 30]))
    lead, spare, counts = c.tally(*(np.concatenate(x) for x in zip(one, two)))
    assert list(zip(lead.tolist(), spare.tolist(), counts.tolist())) == [(1, 3, 11), (1, 4, 20), (5, 0, 2), (9, 1, 330)]


def test_empty_and_rare(spark):
    schema = "doc_id long, lang string, text string"
    assert c.collocations(spark.createDataFrame([], schema)).collect() == []
    assert c.collocations(spark.createDataFrame([(1, "en", "only once here")], schema)).collect() == []
    assert c.collocations(spark.createDataFrame([(1, "en", "a " * 40)], schema)).count() == 1
