"""SimHash: fingerprints and groups against brute force."""

import numpy as np
import pytest
import xxhash

from threadlake.llm import simhash

SCHEMA = "doc_id long, text string, component_id string, _fp string, _root int"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\v\f\r":
        low = low.replace(gap, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=4):
    """Smallest id reachable, by repeated lowering over all pairs."""
    least = {d: d for d, _ in prints}
    links = [(a, b) for i, (a, x) in enumerate(prints) for b, y in prints[i + 1 :] if bin(x ^ y).count("1") <= radius]
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def documents():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 120)))) for _ in range(120)]
    long = [str(x) for x in rng.choice(words, 900)]
    for i in range(60):  # a chain of near copies
        long[int(rng.integers(0, 900))] = f"n{i}"
        texts.append(" ".join(long))
    texts += [None, "", " \n\t", "A B\x0bC d", "a b c D", "one", "One", "x y Zé", "İ İ"]
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark, rows):
    docs = documents()
    want = [(d, plain_fingerprint(t)) for d, t in docs]
    least = plain_groups(want)
    data = [(d, t, "x", "y", 1) for d, t in docs]
    for block, tile in ((10**6, 256), (16, 4)):
        got = rows(simhash.near_duplicates(spark.createDataFrame(data, SCHEMA), block=block, tile=tile), "doc_id", "fingerprint", "component_id")
        assert got == [(d, f"{fp:016x}", least[d]) for d, fp in want]
    assert len(set(least.values())) < len(docs) - 50


def test_wide_radius_and_shared_population_counts(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    made = np.concatenate([base ^ np.uint64(1 << int(rng.integers(0, 64))) ^ np.uint64(1 << int(rng.integers(0, 64))) for _ in range(12)])
    prints = np.unique(made)
    key = sorted(prints.tolist(), key=lambda x: (x.bit_count(), *((x & q).bit_count() for q in simhash.QUARTERS), x))
    whole = np.array(key, dtype=np.uint64)

    def groups(a, b):
        above = {x: x for x in key}
        for x, y in zip(a.tolist(), b.tolist()):
            while above[x] != x:
                x = above[x]
            while above[y] != y:
                y = above[y]
            above[max(x, y)] = min(x, y)
        found = {}
        for x in key:
            y = x
            while above[y] != y:
                y = above[y]
            found.setdefault(y, set()).add(x)
        return sorted(map(sorted, found.values()))

    pairs = [(x, y) for i, x in enumerate(key) for y in key[i + 1 :] if (x ^ y).bit_count() <= 4]
    want = groups(*np.array(pairs, dtype=np.uint64).T)
    assert groups(*simhash.tile_links(whole, None, 4, 8)) == want
    cut = len(whole) // 3
    one, two = whole[:cut], whole[cut:]
    parts = [simhash.tile_links(one, None, 4, 8), simhash.tile_links(two, None, 4, 8), simhash.tile_links(one, two, 4, 8)]
    assert groups(*map(np.concatenate, zip(*parts))) == want


def test_hot_copies_repeated_rows_and_missing_ids(spark, rows):
    data = [(i, "the same text over and over again") for i in range(5, 3000)] + [(7, "the same text over and over again"), (None, ""), (None, None)]
    got = rows(simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert len(got) == len(data) and {r[2] for r in got if r[0] is not None} == {5}
    assert [r for r in got if r[0] is None] == [(None, "0" * 16, None)] * 2


@pytest.mark.parametrize("tile", [3, 256])
def test_dense_group_gives_a_forest(tile):
    group = np.array(sorted({(1 << i) | (1 << j) for i in range(24) for j in range(i)}), dtype=np.uint64)
    group = np.array(sorted(group.tolist(), key=lambda x: tuple((x & q).bit_count() for q in simhash.QUARTERS)), dtype=np.uint64)
    a, b = simhash.tile_links(group, None, 4, tile)
    assert len(a) == len(group) - 1 and len(set(b.tolist())) == 1


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, plain_fingerprint(t)) for d, t in docs]
    least = plain_groups(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op13(spark, sf).collect()}
    assert got == {d: (f"{fp:016x}", least[d]) for d, fp in want}
