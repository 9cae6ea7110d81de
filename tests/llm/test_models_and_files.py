"""Jaccard join, BPE, records, chat, sharding, toxicity and the pipeline on small rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from threadlake.llm import bpe, chat, graph, jaccard_join, sharding, token_records, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"w{i}" for i in range(3000)]
ODD = [(None, "a lone null id", "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "same text", "fr"), (4, "same text", "fr"), (5, "same text", "de")]


def docs_of(spark, rows):
    schema = "doc_id long, text string, lang string, _set string, _doc int, _sig int, shard string, size int"
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "y", 3) for i, t, lang in rows], schema)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- Jaccard join ------------------------------------------------------------------------


def shingles(text, size=4):
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_components(rows, size=4, percent=85):
    """component per row by comparing all pairs; a null id never names a component."""
    sets = [shingles(t, size) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _, _) in enumerate(rows):
        if sets[i] and d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, len(sets[i]), ids.get(find(i), d) if sets[i] else d) for i, (d, _, _) in enumerate(rows)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(3)
        at = rng.randrange(len(words))
        if k == 0:
            words[at] = rng.choice(WORDS)
        elif k == 1:
            del words[at]
        else:
            words.insert(at, rng.choice(WORDS))
    return " ".join(words)


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("pairs", [24, 2])
def test_components_equal_all_pairs(spark, monkeypatch, pairs):
    """Groups around the threshold, with few and with many members; small limits send the
    larger groups through stars and differences."""
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    rng = random.Random(pairs)
    rows = list(ODD)
    common = prose(rng, 12)
    for size, copies, most in [(5, 12, 1), (20, 25, 2), (60, 60, 4), (150, 90, 9), (400, 30, 14), (40, 20, 3)]:
        base = prose(rng, size).split()
        for _ in range(copies):
            text = edited(rng, base, rng.randrange(most + 1))
            rows.append((0, common + " " + text if size == 40 else text.upper() if rng.random() < 0.1 else text, "en"))
    rows += [(0, prose(rng, rng.randrange(1, 9)), "en") for _ in range(60)]
    place = rng.sample(range(6, 100_000), len(rows))
    rows = [(d if d is None or 0 < d < 6 else place[i], t, lang) for i, (d, t, lang) in enumerate(rows)]
    got = [tuple(r) for r in jaccard_join.similar_groups(docs_of(spark, rows).repartition(7)).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_difference_prefix_finds_pairs_around_a_hub(spark):
    """Any similar pair of which one is not similar to the hub meets in its prefixes."""
    rng = np.random.default_rng(1)
    prefix = jaccard_join.prefix_of(85).func
    import pyarrow as pa

    hits = 0
    for _ in range(3000):
        hub = np.unique(rng.integers(0, 400, 60).astype(np.uint64))
        base = hub if rng.random() < 0.5 else np.union1d(rng.choice(hub, len(hub) - 8, replace=False), rng.integers(400, 430, 6).astype(np.uint64))
        x, y = (np.union1d(rng.choice(base, len(base) - rng.integers(0, 5), replace=False), rng.integers(400, 430, rng.integers(0, 5)).astype(np.uint64)) for _ in range(2))
        j = lambda a, b: len(np.intersect1d(a, b)) * 100 >= 85 * len(np.union1d(a, b))
        if j(x, y) and not (j(x, hub) and j(y, hub)) and not np.array_equal(x, hub) and not np.array_equal(y, hub):
            h = pa.array([hub.tobytes()] * 2, pa.binary())
            p, q = (set(v.as_py()) for v in prefix(h, pa.array([x.tobytes(), y.tobytes()], pa.binary())))
            assert p & q
            hits += 1
    assert hits > 100


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for k2 in (0, 1, 2):
        bands = jaccard_join.Bands(85, k2)
        for _ in range(1500):
            n = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            b = a[rng.random(len(a)) > 0.07]
            b = np.union1d(b, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 12) + 1))).astype(np.uint64))
            if len(b) and not np.array_equal(a, b) and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                assert set(bands.signatures(a)) & set(bands.signatures(b)), (k2, len(a), len(b))


def test_sets_emit_few_signatures_and_common_lines_share_none():
    """Under a third of a set's size in signatures; sets that have only a line of eight
    shingles in common seldom meet."""
    rng = np.random.default_rng(3)
    bands = jaccard_join.Bands(85)
    line = rng.integers(0, 2**63, 8).astype(np.uint64) * np.uint64(2)
    sizes = rng.integers(100, 1500, 300)
    found = [bands.signatures(np.union1d(line, rng.integers(0, 2**63, int(n)).astype(np.uint64) * np.uint64(2))) for n in sizes]
    assert sum(map(len, found)) < 0.32 * sizes.sum()
    every = np.concatenate(found)
    assert len(every) - len(np.unique(every)) < 3


def test_hubs_of_one_component_are_one(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 12), (3, 13), (4, 20), (4, 21)], "_sig long, _set long")
    comps = spark.createDataFrame([(11, 10), (12, 10)], "node long, root long")
    got = {tuple(r) for r in jaccard_join._with_hubs(members, comps).collect()}
    assert got == {(12, 10), (12, 11), (12, 12), (12, 13), (21, 20), (21, 21)}


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_members_near_the_hub_spell_out_few_differences(spark, monkeypatch, bits):
    """A large group of near copies in one component, a few members outside of it; a filter
    that is too small lets more through and loses nothing."""
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", bits, raising=False)
    spelled, stage = [], jaccard_join.stage

    def counted(df, name, folder=None):
        out = stage(df, name, folder)
        if name == "differences":
            spelled.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    rng = random.Random(21)
    base = prose(rng, 150).split()
    replaced = lambda w, k: " ".join(rng.choice(WORDS) if i in at else x for at in [set(rng.sample(range(150), k))] for i, x in enumerate(w))
    texts = [" ".join(base)] + [replaced(base, 1 + i % 2) for i in range(300)]
    for _ in range(6):
        far = replaced(base, 7)
        texts += [far, replaced(far.split(), 1)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = [tuple(r) for r in jaccard_join.similar_groups(docs_of(spark, rows).repartition(4), 5, 80).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows, 5, 80), key=key)
    assert len({c for _, _, c in got}) > 2
    # at least four elements a copy and word replaced, if all were spelled out
    assert spelled and (sum(spelled) < 5 * len(rows) or bits == 64)


def test_hot_groups_and_empty_tables(spark):
    rng = random.Random(8)
    base = prose(rng, 80).split()
    rows = [(i, edited(rng, base, 1) if i % 3 == 1 else " ".join(base) if i % 3 == 0 else prose(rng, 30), "en") for i in range(600)]
    got = {r[0]: r[2] for r in jaccard_join.similar_groups(docs_of(spark, rows)).collect()}
    assert all(got[i] == (0 if i % 3 < 2 else i) for i in range(600))
    assert jaccard_join.similar_groups(docs_of(spark, rows).limit(0)).count() == 0
    kept = jaccard_join.keep_first(docs_of(spark, rows + [(None, None, "en"), (900, "", "en"), (901, "", "en")]))
    assert len(kept.columns) == 8 and kept.count() == 1 + 200 + 3


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 100 for i in range(101, 160)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- BPE and records ---------------------------------------------------------------------

TRICKY = [None, "", " \t", "I'LL don't 's x's", "Σ ΑΣ ß İ", "a\x1cb\x1dc d", "é é", "x<|endoftext|>y <|startoftext|>", "123 4.5!!! ...", "\U0001f600\U0001f600 ok", "word " * 5000, "z" * 3000, "the cat  sat"]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    alphabet = list("abcthe AB\t\n'.,!0") + ["é", "ß", "中", "<|endoftext|>", "́"]
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)]
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(None, "x", None), (3, "twice", None), (3, "twice", None)])
    coded = bpe.encode_decode(docs, PATH)
    got = {r["doc_id"]: r for r in coded.where("doc_id <> 3").collect()}
    for i, t in enumerate(texts):
        if i == 3:
            continue
        want = library.encode(t or "", add_special_tokens=False)
        assert got[i]["ids"] == want.ids, t
        assert got[i]["decoded"] == library.decode(want.ids, skip_special_tokens=False)
    assert coded.count() == len(texts) + 3 and coded.where("doc_id is null").count() == 1
    digest = {r["doc_id"]: r for r in bpe.digests(coded).where("doc_id in (1, 12)").collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(digest[1])[1:] == (0, empty, empty)
    ids = library.encode(texts[12], add_special_tokens=False).ids
    assert digest[12]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.digests(bpe.encode_decode(docs.limit(0), PATH)).count() == 0


def test_bpe_holds_a_slice_of_a_batch():
    """A task yields coded rows long before its batch is done, in their order and with their keys."""
    coder = bpe.Coder(bpe.Vocabulary.load(PATH))
    texts = [f"word{i} " * 5000 for i in range(200)] + [None, ""]
    keys = pa.array(range(len(texts)), pa.int32())
    out = list(bpe.code(iter([pa.RecordBatch.from_arrays([keys, pa.array(texts)], names=["doc_id", "text"])]), coder))
    longest = max(len(t or "") for t in texts)
    assert len(out) > 1
    at = 0
    for b in out:
        assert sum(len(t or "") for t in texts[at : at + b.num_rows]) <= bpe.HELD_CHARS + longest
        at += b.num_rows
    table = pa.Table.from_batches(out)
    assert table["doc_id"].to_pylist() == list(range(len(texts))) and table["doc_id"].type == pa.int32()
    library = Tokenizer.from_file(PATH)
    for i in (0, 77, 199, 200, 201):
        assert table["ids"][i].as_py() == library.encode(texts[i] or "", add_special_tokens=False).ids


def test_merges_skip_stale_entries():
    """The queue's result is that of merging the best pair again and again."""
    rng = random.Random(2)
    vocabulary = bpe.Vocabulary.load(PATH)
    coder = bpe.Coder(vocabulary)
    for _ in range(300):
        word = "".join(rng.choice("aenrst") for _ in range(rng.randrange(1, 25)))
        symbols = [coder.inner[b] for b in word[:-1].encode()] + [coder.last[ord(word[-1])]]
        slow = list(symbols)
        while True:
            ranked = [(vocabulary.ranks[a << bpe.SIDE | b], i) for i, (a, b) in enumerate(zip(slow, slow[1:])) if a << bpe.SIDE | b in vocabulary.ranks]
            if not ranked:
                break
            rank, i = min(ranked)
            slow[i : i + 2] = [vocabulary.merged[rank]]
        assert bpe.merge(symbols, vocabulary.ranks, vocabulary.merged) == slow


def test_records_share_words_between_chunks():
    """Letters and the punctuation behind them are coded apart, whatever their case; odd chunks
    go through the whole library. The ids are the library's."""
    library = Tokenizer.from_file(PATH)
    encoder = token_records.Encoder(PATH)
    words = ["andhere", "Éanviré", "cheinö", "ß"]
    texts = [" ".join(w + tail for tail in ("", ".", ",***", "&&&", "!'") for w in (word, word.upper() if word != "ß" else word, word.lower())) for word in words]
    texts += [t or "" for t in TRICKY] + ["a's a'.s 'tis THE' x<|endoftext|> a.<|endoftext|>b \u212b \u00b5 \u00aa ÿ÷ é\u0301."]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, encoder.type).tobytes(), text
    for word in words:
        assert word.lower() in encoder.words and not any(word.lower() + tail in encoder.words for tail in (".", ",***", "&&&", "!'"))


def test_records_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = [(100 - i, t, "en") for i, t in enumerate(TRICKY)] + [(None, "first", None), (7, "b", None), (7, "a", None), (7, "a", None)]
    docs = docs_of(spark, rows).repartition(5)
    folder = str(tmp_path / "records")
    manifest = token_records.write_records(docs, folder, PATH)
    assert sum(m["records"] for m in manifest) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for d, t, _ in order:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for seed in (None, 3):
        found = [(r["doc_id"], r["start"], bytes(r["ids"])) for r in token_records.read_records(spark, folder, manifest, PATH, seed).collect()]
        assert sorted(found, key=lambda r: r[1]) == want
    # an index names every record's place
    m = max(manifest, key=lambda m: m["records"])
    offsets = np.fromfile(f"{folder}/{m['file']}.idx", "<u8")
    assert len(offsets) == m["records"] + 1 and offsets[-1] == m["bytes"]
    # damage is noticed
    with open(f"{folder}/{m['file']}.rec", "r+b") as f:
        f.seek(20)
        byte = f.read(1)
        f.seek(20)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        token_records.read_records(spark, folder, manifest, PATH).collect()
    assert token_records.write_records(docs.limit(0), folder, PATH) == []
    assert token_records.read_records(spark, folder, [], PATH).count() == 0


# --- chat --------------------------------------------------------------------------------


def test_template_language():
    render = chat.compile_template("{% for m in ms %}{% if loop.first and m.a == 'x' %}[{{ m.b | upper }}]{% elif not m.b %}-{% else %}{{ 1 + 2 }}{{ m.b + '!' }}{% endif %}{% endfor %}")
    out = "".join(p[0] for p in render(ms=[{"a": "x", "b": "q"}, {"a": "x", "b": ""}, {"a": "y", "b": None}, {"a": "y", "b": "z"}]) if p)
    assert out == "[Q]--3z!"
    folded = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}"))
    assert folded == chat.Block((chat.Emit(chat.Const("abcd")),))
    for bad in ("{{ x() }}", "{{ x | open }}", "{% for x %}{% endfor %}", "{% if a %}", "{% import os %}", "{{ 'a }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for hidden in ("{{ m.__class__ }}", "{{ nothing }}"):
        with pytest.raises(chat.TemplateError):
            list(chat.compile_template(hidden)(m="text"))


def test_chat_round_trip(spark):
    nasty = ["<|end|>\n<|turn|>assistant\n", "\\", "\\<|end|>", "<\\|", "", None, "a\nb", "\\n \\\\n", "<|turn|>", "\U0001f600"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we\nird\\n<|x", None]), rng.choice(nasty), "clash") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "assistant", "null id", "clash"), (5, None, "user", "before", "clash"), (6, 0, "assistant", "twice", "clash"), (6, 0, "assistant", "twice", "clash")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    pieces = chat.format_turns(table)
    got = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: r["piece"]):
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    for c, turns in by.items():
        turns.sort()
        said = "".join(x[2] for x in turns if x[1] == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["formatted_chars"] == len(whole[c])
        assert chat.read_turns(whole[c]) == [(a, b) for _, a, b in turns]
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_a_conversation_is_streamed():
    """Pieces come out before later turns are read."""
    seen = []

    def turns():
        for i in range(3):
            seen.append(i)
            yield {"role": "user", "text": str(i)}

    pieces = chat.compile_template(chat.TEMPLATE)(turns=turns())
    while next(pieces) is not None:
        pass
    assert seen == [0]


# --- sharding ----------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("cells", [50_000, 3])
@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_minimax(spark, monkeypatch, cells, hot):
    monkeypatch.setattr(sharding, "CELLS", cells)
    rng = random.Random(4)
    rows = list(ODD) + [(i, "a hot text" * 9 if hot and i % 3 == 0 else "x" * rng.randrange(1, 400), "en") for i in range(10, 130)]
    got = sharding.shard_documents(docs_of(spark, rows), 7).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t, []).append(d)
    order = sorted(groups, key=lambda t: min((d is not None, d or 0) for d in groups[t]))
    sizes = [len(groups[t]) * (len((t or "").encode()) + 1) for t in order]
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(7))
    assert max(sum(r["size"] for r in v) for v in by.values()) == brute_capacity(sizes, 7)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    text = {}
    for d, t, _ in rows:
        text.setdefault(d, t)
    home = {}
    for r in got:
        home.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        assert r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode())
    assert all(len(s) == 1 for s in home.values())


def test_sharding_small_tables(spark):
    assert sharding.shard_documents(docs_of(spark, []), 4).count() == 0
    assert [tuple(r)[3:] for r in sharding.shard_documents(docs_of(spark, [(1, None, "en")]), 4).collect()] == [(0, 0)]


# --- toxicity ----------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["awful", "nasty", "rotten"]
    rows, marks = [], []
    for i in range(1200):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "ly", "est,"]))
        rows.append((i, " ".join(words), rng.choice(["en", "fr"])))
        marks.append((i, toxic, "clash"))
    labels = spark.createDataFrame(marks + [(None, 1, "clash"), (3, None, "clash"), (7, 0, "clash")], "doc_id long, toxic int, score string")
    long = (5000, "fine " * 30_000 + "nastyest", "en")
    docs = docs_of(spark, rows + [long, (5001, None, None), (5002, "", "xx"), (None, "fine words", "en"), (9, rows[9][1], "en")])
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count()
    wrong = total = 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        if r["held_out"] and i < 1200:
            total += 1
            wrong += r["predicted"] != (i % 5 == 0)
    assert total > 300 and wrong <= total * 0.03
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["predicted"] == 1 and by[5001]["score"] == by[5002]["score"] and not by[5001]["toxic"]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 5000").count() == 0 and kept.where("doc_id is null").count() == 1
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert all(r["score"] < 1e-6 for r in toxicity.score_documents(docs.limit(5), labels.limit(0)).collect())


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """More rows than one shard, and long texts that alone have a word: all are counted, whatever
    the partitions."""
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(12_000):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(3, 12))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["awful", "nasty", "rotten"]))
        rows.append((i, " ".join(words), rng.choice(["en", "fr"])))
        marks.append((i, int(i % 5 == 0)))
    for i in range(12_000, 12_060):
        rows.append((i, "fine " * 21_000 + "gruesome", "en"))
        marks.append((i, 1))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = docs_of(spark, rows + [(20_000, "w5 gruesome w6", "fr"), (20_001, "w5 w6", None)])
    counted, odds = [], toxicity.evidence
    monkeypatch.setattr(toxicity, "evidence", lambda seen, n: counted.append((seen.copy(), n)) or odds(seen, n))
    models = [toxicity.train(docs.repartition(n), labels) for n in (3, 7)]
    kept = {i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 != 1}
    for seen, n in counted:
        # four fifths, the others calibrate
        assert 0.78 * len(kept) < n.sum() < 0.82 * len(kept)
        word = toxicity.features("gruesome", seen.shape[1])[0]
        assert seen[0, word] == 0 and 0.5 < seen[1, word] / sum(i >= 12_000 for i in kept) < 1
    a, b = models
    assert (a.table == b.table).all() and (a.dense() == b.dense()).all()
    assert (a.scale, a.threshold, a.thresholds) == (b.scale, b.threshold, b.thresholds)
    monkeypatch.setattr(toxicity, "train", lambda *_: a)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert got[20_000]["predicted"] == 1 and got[20_001]["predicted"] == 0
    left = [(r["predicted"], int(i % 5 == 0)) for i, r in got.items() if r["held_out"] and i < 12_000]
    assert len(left) > 3000 and sum(p != y for p, y in left) <= len(left) * 0.01


def test_responses_do_not_depend_on_the_pieces(monkeypatch):
    model = toxicity.untrained(toxicity.Settings(buckets=1 << 12))
    words = toxicity.Words(1 << 12)
    rng = random.Random(12)
    flat, starts = toxicity.flatten([" ".join(rng.choice(WORDS) for _ in range(n)) for n in (0, 40, 3, 200, 1, 0)], words, 3)
    vectors = model.table[np.array(words.rows)].sum(axis=1)
    want = model.pooled(flat, starts, vectors, places=True)
    for size in (1, 7, 64):
        monkeypatch.setattr(toxicity, "PIECE_WORDS", size)
        got = model.pooled(flat, starts, vectors, places=True)
        assert (got[0] == want[0]).all() and all((x == y).all() for x, y in zip(got[1], want[1]))


# --- pipeline ----------------------------------------------------------------------------


@pytest.mark.parametrize("pairs", [24, 2])
def test_pipeline_drops_copies_from_four_fifths_on(spark, monkeypatch, pairs):
    """Copies with fresh text, cut ones and ones with words replaced, five words a shingle."""
    import corpus_pipeline as pipeline

    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    rng = random.Random(20 + pairs)
    texts = []
    for copies in (1, 1, 1, 1, 20):
        base = prose(rng, 300).split()
        texts.append(" ".join(base))
        for _ in range(copies):
            share = rng.uniform(0.14, 0.27)
            texts.append(" ".join(base) + " " + prose(rng, int(300 * share)))
            texts.append(" ".join(base[: int(300 * (1 - share))]))
            texts.append(" ".join(rng.choice(WORDS) if rng.random() < share / 10 else w for w in base))
    base = prose(rng, 400).split()
    texts += [" ".join(base), " ".join(base + prose(rng, 80).split()), " ".join(base[:330])]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    want = {d for d, _, c in brute_components(rows, 5, 80) if d == c}
    assert want < {d for d, _, c in brute_components(rows) if d == c}
    assert {r["doc_id"] for r in pipeline.drop_near_copies(spark, docs_of(spark, rows).repartition(5), "").collect()} == want


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "secret_scan", "bpe"]
    for name, apply in pipeline.STAGES:
        frames.append(pipeline.stage(apply(spark, frames[-1], sf), name))
    assert all(f.columns == columns for f in frames[:5])
    given, clean, one, safe, masked, coded = ({r["doc_id"]: r for r in f.collect()} for f in frames)
    # what a stage keeps is unchanged; only the secret scan touches texts
    for before, after in ((given, clean), (clean, one), (one, safe)):
        assert all(after[i] == before[i] for i in after)
    rows = [(r["doc_id"], r["text"], None) for r in clean.values()]
    assert set(one) == {d for d, _, c in brute_components(rows) if d == c}
    assert set(one) == {d for d, _, c in brute_components(rows, 5, 80) if d == c}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    import re

    def five(t):
        w = re.findall(r"\w+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    leaks = {i for i, r in one.items() if any(100 * len(five(t) & five(r["text"])) >= 80 * len(five(t)) for t in items)}
    assert set(safe) == set(one) - leaks
    assert set(masked) == set(safe) == set(coded)
    assert all(r["n_chars"] == len(r["text"]) or r["text"] == safe[i]["text"] for i, r in masked.items())
    library = Tokenizer.from_file(PATH)
    for i, r in coded.items():
        ids = library.encode(masked[i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_one_row_of_a_repeated_id_is_fetched(spark, monkeypatch):
    """A third of all rows under one labelled id: the driver gets a row for each id drawn."""
    docs = spark.range(6000).selectExpr("if(id < 2000, 7, id) as doc_id", "concat('text number ', id, if(id % 2 = 0, ' vile', ' kind')) as text", "'en' as lang")
    labels = spark.range(2000, 2400).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as toxic").unionAll(spark.sql("select 7L, 1"))
    fetched = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks, langs, s: fetched.append((texts, marks)))
    toxicity.train(docs, labels)
    texts, marks = fetched[0]
    kept = labels.where(~toxicity.held_out()).count()
    assert len(texts) == len(marks) == kept
    assert sum(int(t.split()[2]) < 2000 for t in texts) == (1 if spark.sql("select 7L as doc_id").where(~toxicity.held_out()).count() else 0)
    few = toxicity.Settings(sample_rows=30)
    fetched.clear()
    toxicity.train(docs, labels, few)
    assert 20 <= len(fetched[0][0]) <= 110
