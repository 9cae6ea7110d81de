"""Secret scans: strong patterns, and weak parts of credentials linked within a scope.

Base spans come from three patterns: assignments to secret names, access key ids, and long
hexadecimal runs. A credential often has several parts of which each alone is weak: an
identifier (an access key id, a user or client name), a secret (any base span or an opaque
mixed token) and an endpoint (a URL). Weak parts are reported only where complementary parts
lie within ``scope`` characters: an opaque token next to an identifier, an identifier next to
a secret, an endpoint next to both. The parts of all documents are joined as intervals, by
bins of ``scope`` characters within their document. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import stage

from .common import small, table, whole

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
# a maximal run of 24 or more is the same span as a run that is checked for its length
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)(?:access_?key_?id|client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"""(?i)https?://[^\x20\x09-\x0D"'<>]+"""
# In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
SCOPE = 200
MASK = "[SECRET]"
SPAN = "array<struct<start:int,rank:int,end:int>>"


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end), code points, end exclusive.

    A split by the pattern gives the gaps between its matches; running lengths of gaps and
    matches are the places. ``keep``: (match, second group) -> whether it counts.
    """
    rank = KINDS.index(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep is not None and kind == "assign" else hits
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(hits.alias("m"), second.alias("g"), gaps.alias("p"))
    pieces = F.slice(F.transform(pieces, lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g"), F.length(x["p"]).alias("p"))), F.lit(1), F.size(hits))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["p"]
        end = begin + F.length(x["m"])
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        out = F.concat(acc["out"], one)
        if keep is not None:
            out = F.when(keep(x["m"], x["g"]), out).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def parts(docs: DataFrame) -> DataFrame:
    """_doc, _print (hash of the text) and the spans of each kind of every row."""
    text = F.col("_text")
    rows = docs.select(F.col("doc_id").alias("_doc"), whole("text").alias("_text"))
    mixed = lambda m, g: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    return rows.select(
        "_doc",
        F.xxhash64("_text").alias("_print"),
        spans(text, ASSIGN, "assign", lambda m, g: F.length(g) >= 6).alias("assign"),
        spans(text, ACCESS, "access").alias("access"),
        spans(text, HEX, "hex").alias("hex"),
        spans(text, IDENT, "ident").alias("ident"),
        spans(text, OPAQUE, "opaque", mixed).alias("opaque"),
        spans(text, ENDPOINT, "endpoint").alias("endpoint"),
    )


def near(a: DataFrame, b: DataFrame, scope: int) -> DataFrame:
    """Interval semi join: rows of ``a`` (with _from, _to) of which a row of ``b`` of the
    same document lies at most ``scope`` characters away."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    left = a.withColumn("_bin", bins(F.col("_from") - scope, F.col("_to") + scope))
    right = b.select(
        F.col("_doc").alias("_bdoc"), F.col("_print").alias("_bprint"), F.col("_from").alias("_bfrom"), F.col("_to").alias("_bto"),
        bins(F.col("_from"), F.col("_to")).alias("_bbin"),
    )
    on = left["_doc"].eqNullSafe(right["_bdoc"]) & (left["_print"] == right["_bprint"]) & (left["_bin"] == right["_bbin"])
    on = on & (right["_bfrom"] <= left["_to"] + scope) & (right["_bto"] >= left["_from"] - scope)
    return left.join(right, on, "left_semi").drop("_bin").distinct()


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with their complements, of ``parts``: _doc, _print, added (spans)."""
    some = F.size("ident") + F.size("opaque") + F.size("endpoint") > 0
    flat = found.where(some).select("_doc", "_print", F.explode(F.concat(*KINDS)).alias("_s"))
    flat = flat.select("_doc", "_print", F.col("_s.rank").alias("_rank"), F.col("_s.start").alias("_from"), F.col("_s.end").alias("_to")).distinct()
    of = lambda *kinds: flat.where(F.col("_rank").isin([KINDS.index(k) for k in kinds]))
    names, secrets = of("access", "ident"), of("assign", "hex", "opaque")
    kept = [near(of("opaque"), names, scope), near(of("ident"), secrets, scope), near(near(of("endpoint"), names, scope), secrets, scope)]
    return (
        reduce(DataFrame.unionByName, kept)
        .select("_doc", "_print", F.struct(F.col("_from").alias("start"), F.col("_rank").alias("rank"), F.col("_to").alias("end")).alias("_s"))
        .groupBy("_doc", "_print")
        .agg(F.collect_list("_s").alias("added"))
    )


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, _print,
    assign, access, hex (arrays of base spans) and added (spans of linked weak parts).

    A null or empty text has no spans. Rows are told apart by id and text; repeated rows get
    the same spans each, and a null id is an id like any other.
    """
    found = stage(parts(docs), "parts")
    extra = linked(found, scope).withColumnsRenamed({"_doc": "_edoc", "_print": "_eprint"})
    both = found.join(extra, found["_doc"].eqNullSafe(extra["_edoc"]) & (found["_print"] == extra["_eprint"]), "left")
    return both.select(F.col("_doc").alias("doc_id"), "_print", "assign", "access", "hex", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def masked(text: Column, found: Column) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        new = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(F.sort_array(found), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def mask_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs``, all rows and columns whatever their names, with secrets and linked parts masked
    in ``text`` and ``n_chars`` (where there is one, and of its type) following it."""
    spans_of = scan(docs, scope).select(
        F.col("doc_id").alias("_sdoc"), F.col("_print").alias("_sprint"), F.concat("assign", "access", "hex", "added").alias("_spans")
    )
    hit = stage(spans_of.where(F.size("_spans") > 0).dropDuplicates(["_sdoc", "_sprint"]), "hits")
    hit = small(hit, hit.count())
    # the row travels as one column, so its names meet none of this step's
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    old = F.col("_row")["text"]
    both = rows.join(hit, F.col("_row")["doc_id"].eqNullSafe(hit["_sdoc"]) & (F.xxhash64(whole(old)) == hit["_sprint"]), "left")
    both = both.select("_row", F.when(F.col("_spans").isNull(), old).otherwise(masked(old, F.col("_spans"))).alias("_masked"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("_masked")
        return F.length("_masked").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("_row").getField(c)

    return both.select(*(column(c).alias(c) for c in docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat(base, F.col("added"))).alias("spans"),
    )


def _hits(kind: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    """SQL for the spans of one kind; gaps[i] lies before match i."""
    p, rank = pattern.replace("'", "''"), KINDS.index(kind)
    return f"""SELECT doc_id, {rank} AS rank, a, b FROM (
      SELECT doc_id, m, g, CAST(sum(length(p) + length(m)) OVER w AS BIGINT) AS b, CAST(sum(length(p) + length(m)) OVER w AS BIGINT) - length(m) AS a FROM (
        SELECT doc_id, unnest(regexp_extract_all(t, '{p}', 0)) m, unnest(regexp_extract_all(t, '{p}', {group})) g,
               unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}', 0)))) p,
               unnest(range(len(regexp_extract_all(t, '{p}', 0)))) i
        FROM d WHERE regexp_matches(t, '{p}')) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}"""


_NEAR = "SELECT x.* FROM s x WHERE x.rank = {r} AND " + "{c}"
_HAS = "EXISTS (SELECT 1 FROM s y WHERE y.doc_id = x.doc_id AND y.rank IN ({k}) AND y.a <= x.b + 200 AND y.b >= x.a - 200)"
_WORD = "(CASE rank " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END || ':' || a || ':' || b)"

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
s AS (
  {_hits("assign", ASSIGN, "length(g) >= 6", 2)} UNION ALL {_hits("access", ACCESS)} UNION ALL {_hits("hex", HEX)}
  UNION ALL {_hits("ident", IDENT)}
  UNION ALL {_hits("opaque", OPAQUE, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')")}
  UNION ALL {_hits("endpoint", ENDPOINT)}),
x AS (SELECT * FROM s WHERE rank < 3
  UNION ALL {_NEAR.format(r=4, c=_HAS.format(k="1, 3"))}
  UNION ALL {_NEAR.format(r=3, c=_HAS.format(k="0, 2, 4"))}
  UNION ALL {_NEAR.format(r=5, c=_HAS.format(k="1, 3") + " AND " + _HAS.format(k="0, 2, 4"))}),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) n0, count(*) FILTER (rank = 1) n1, count(*) FILTER (rank = 2) n2,
  string_agg({_WORD}, ',' ORDER BY a, rank, b) FILTER (rank < 3) base, string_agg({_WORD}, ',' ORDER BY a, rank, b) spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) n_assign, coalesce(n1, 0) n_access, coalesce(n2, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN g USING (doc_id)
"""
