"""Lexical search: ranks against brute force, bounds above every score, edge cases."""

import math
import re
from collections import Counter

import numpy as np

from threadlake.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def plain_rank(docs, items, k=10):
    terms = [(d, Counter(plain_terms(t))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in terms:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def documents():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)] + ["Über", "ǅungla", "x_y", "İ"]
    weights = 1 / np.arange(1, len(words) + 1)
    return [(i, " ".join(rng.choice(words, int(rng.integers(1, 300)), p=weights / weights.sum()))) for i in range(400)]


def test_ranks_equal_brute_force(spark, rows):
    docs = documents() + [(500, None), (501, ""), (502, " -- "), (503, "a\x00b a"), (504, "w3 " * 5000), (None, "w200 w201 w202")]
    docs += [(d, docs[7][1]) for d in range(600, 640)]  # a group of equal texts: ties
    items = [(1, "W1 w2, w2 über"), (2, docs[7][1][:200]), (3, None), (4, "..."), (5, "nothing here knows"), (6, "w3 w3 w3"), (7, "a b"), (8, "w200 w202 w203"), (9, "İ x")]
    table = spark.createDataFrame([(d, t, "q", 5) for d, t in docs], "doc_id long, text string, item string, score int").repartition(5)
    got = rows(search.rank(table, spark.createDataFrame([(i, t, 0) for i, t in items] + [(1, items[0][1], 1)], "item_id long, text string, rank int")))
    assert got == sorted(plain_rank(docs, items), key=lambda r: r[:2])


def test_bounds_are_never_below_scores(spark):
    docs = documents()
    items = [Counter(search.terms_of(t.encode())) for _, t in docs[:20]]
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    counts = Counter(t for _, text in docs for t in set(search.terms_of(text.encode())))
    n, total = sum(r.n for r in index), sum(r.total for r in index)
    assert n == len(docs)
    plan = search.Plan(items, counts, n, total)
    texts, close = dict(docs), 0
    for r in index:
        bounds = search._bounds(plan, *plan.arrays(), r.bits, r.levels, np.array(r.lens), r.rows)
        for j, d in enumerate(r.ids):
            words = search.terms_of(texts[d].encode())
            for i in range(len(items)):
                score = plan.score(i, Counter(words), len(words))
                assert bounds[i, j] >= score
                close += bounds[i, j] <= 1.2 * score
    assert close > 0.9 * len(items) * len(docs)


def test_most_documents_are_excluded(spark):
    docs = [(i, f"common words of all u{i} v{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = search.build_index(df).cache()
    item = Counter(search.terms_of(b"common words u17 v17"))
    plan = search.Plan([item], search.document_counts(df, list(item)), 3000, 18000)
    floor = plan.score(0, Counter(search.terms_of(b"common words of all u67 v17")), 6)
    left = search.not_excluded(index, plan, {0: (floor, 400)}).collect()
    assert {17, 67, 117} <= {r.doc_id for r in left} and len(left) < 60


def test_blocks_of_items_are_complete(spark, monkeypatch, rows):
    monkeypatch.setattr(search, "ITEMS", 4)
    docs = documents()[:60]
    items = [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(11)]
    got = rows(search.rank(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3))
    assert got == sorted(plain_rank(docs, items, 3), key=lambda r: r[:2])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("x", "w1")], "item_id string, text string")
    assert search.rank(none, items).collect() == []
    docs = spark.createDataFrame([(1, "w1"), (2, "w2")], "doc_id long, text string")
    assert search.rank(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in search.rank(docs, items).collect()] == [("x", 1, 1)]
