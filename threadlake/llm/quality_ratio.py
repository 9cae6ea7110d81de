"""Quality rules: a log-likelihood ratio of hashed n-grams, beside plain counts.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two
multinomials are counted over all documents: the raw corpus, and the trusted target (rows whose
label says quality 1). A bucket weighs the log of its target count against the count expected
from the raw corpus, both smoothed by ``PRIOR`` occurrences, so buckets with little evidence
weigh nothing. A document's score is the mean weight of its n-grams, and it is kept if the
score reaches a threshold. Weights are whole numbers (65,536 to the unit), so sums do not
depend on order or partitions and every document's decision is the same in every run. Only
DataFrame functions are used; the driver sees one array with a weight per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, held, small, split_words, table, whole

BUCKETS = 1 << 16
PRIOR = 8
UNIT = 1 << 16
THRESHOLD = -0.1
PAIR = 1_000_003
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words


def ngrams(words: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    hashes = F.transform(words, lambda w: F.crc32(w.cast("binary")))
    pairs = F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: (a * PAIR + b) % buckets)
    pairs = F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.concat(F.transform(hashes, lambda h: h % buckets), pairs)


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: int = PRIOR) -> DataFrame:
    """One row: ``w``, the weight of every bucket in order. All documents count towards the
    raw corpus, those with a label of quality 1 towards the target too (a label without id
    marks none; several labels of an id mark it once). Without target every weight is 0."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    trusted = small(trusted.withColumn("_good", F.lit(1)), trusted.count())
    marked = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(trusted, "_id", "left")
    grams = held(marked, "_g", ngrams(split_words(F.col("_text")), buckets)).select("_good", F.explode_outer("_g").alias("_b"))
    counts = grams.groupBy("_b").agg(F.count("*").alias("r"), F.count("_good").alias("t"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "_b").join(counts, "_b", "left")
    # at most ``buckets`` rows meet in one
    one = every.agg(F.sort_array(F.collect_list(F.struct("_b", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t")))).alias("a"))
    total = lambda c: F.aggregate("a", F.lit(0).cast("long"), lambda acc, x: acc + x[c])
    one = held(held(one, "_t", total("t")), "_r", F.greatest(total("r"), F.lit(1)))
    weight = lambda x: F.log((x["t"] + prior) / ((F.col("_t") * x["r"]) / F.col("_r") + prior))
    return one.select(F.transform("a", lambda x: F.round(weight(x) * UNIT).cast("long")).alias("w"))


def duplicates(found: Column, key) -> Column:
    """Of an array sorted by ``key``, the elements that equal a neighbour in it."""
    same = lambda a, b: F.coalesce(key(a) == key(b), F.lit(False))
    return F.filter(found, lambda x, i: same(x, F.get(found, i - 1)) | same(x, F.get(found, i + 1)))


def repeated(rows: DataFrame, words: str = "_w", width: int = 3) -> DataFrame:
    """``rows`` with _repeat: how many words lie in a window of ``width`` words that occurs
    twice or more in the text. Windows are compared by hash, those that agree by their words."""
    w = F.col(words)
    places = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - (width - 1))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<struct<k:bigint,i:int>>")
    rows = held(rows, "_h", F.transform(places, lambda i: F.xxhash64(F.slice(w, i, width))))
    pairs = F.sort_array(F.transform("_h", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    rows = held(rows, "_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).otherwise(none))
    text = lambda x: F.struct(F.array_join(F.slice(w, x["i"] + 1, width), " ").alias("k"), x["i"].alias("i"))
    rows = held(rows, "_c", F.sort_array(F.transform(duplicates(F.col("_s"), lambda x: x["k"]), text)))
    rows = held(rows, "_p", F.sort_array(F.transform(duplicates(F.col("_c"), lambda x: x["k"]), lambda x: x["i"])))
    steps = F.transform("_p", lambda p, i: F.least(F.lit(width), F.coalesce(F.get("_p", i + 1), p + width) - p))
    count = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.withColumn("_repeat", count).drop("_h", "_s", "_c", "_p")


def rate(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: int = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null or empty text has no words: it fails the base rules and its score is 0. Scores are
    rounded to six digits; the threshold is held against the exact sum. Repeated rows are rated
    each.
    """
    model = weights(docs, labels, buckets, prior).scalar()
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    rows = docs.select("doc_id", whole("text").alias("_t"))
    rows = held(rows, "_w", split_words(t))
    rows = held(rows, "_l", lines)
    rows = repeated(held(rows, "_g", ngrams(F.col("_w"), buckets)))
    # a column at first, as a lambda may not name a subquery; the optimizer puts it there
    rows = rows.withColumn("_m", model).withColumn("_sum", F.aggregate("_g", F.lit(0).cast("long"), lambda acc, b: acc + F.get("_m", b.cast("int"))))
    long = lambda c: c.cast("long")
    counted = rows.select(
        "doc_id",
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.regexp_count(t, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.size("_g").alias("_n"),
        "_sum",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    passed = F.col("_sum") >= F.col("_n") * F.lit(threshold * UNIT)
    score = F.when(F.col("_n") > 0, F.round(F.col("_sum") / F.col("_n") / UNIT, 6)).otherwise(0.0)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passed).alias("kept"), score.alias("score"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


_BYTES = "list_transform(range(0, octet_length(encode(x)), 1), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS BIGINT))"
_STEP = f"lambda acc, b: xor(acc >> 8, CAST({_crc_table()} AS BIGINT[])[xor(acc, b) & 255 + 1])".replace("& 255 + 1", "& 255) + 1").replace("[xor(", "[(xor(")

ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
u AS (SELECT doc_id, unnest(w) x, unnest(range(len(w))) i FROM d),
h AS (SELECT x, xor(list_reduce({_BYTES}, {_STEP}, CAST(4294967295 AS BIGINT)), 4294967295) h FROM (SELECT DISTINCT x FROM u)),
n AS (SELECT doc_id, i, x, h, lead(h) OVER p h2, lead(x) OVER p x2, lead(x, 2) OVER p x3 FROM u JOIN h USING (x) WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, h % {BUCKETS} b FROM n UNION ALL SELECT doc_id, (h * {PAIR} + h2) % {BUCKETS} FROM n WHERE h2 IS NOT NULL),
q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
c AS (SELECT b, count(*) r, count(q.doc_id) t FROM g LEFT JOIN q USING (doc_id) GROUP BY b),
s AS (SELECT sum(r) r, sum(t) t FROM c),
w AS (SELECT b, CAST(round(ln((c.t + {PRIOR}) / (CAST(s.t * c.r AS DOUBLE) / s.r + {PRIOR})) * {UNIT}) AS BIGINT) w FROM c, s),
z AS (SELECT doc_id, count(*) n, CAST(sum(w) AS BIGINT) z FROM g JOIN w USING (b) GROUP BY doc_id),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, x2, x3) k FROM n WHERE x3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT j) k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) j FROM m WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT y) k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) y FROM d) WHERE regexp_matches(y, '{WORD}') GROUP BY doc_id),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
  CAST(coalesce(l.k, 0) AS BIGINT) n_dup_lines, CAST(coalesce(r.k, 0) AS BIGINT) n_repeat_words, coalesce(z.n, 0) n, coalesce(z, 0) z
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND z >= n * CAST({THRESHOLD * UNIT} AS DOUBLE) kept, CASE WHEN n > 0 THEN round(CAST(z AS DOUBLE) / n / {UNIT}, 6) ELSE 0.0 END score FROM f
"""
