"""The library's tables as views over the given tables, in Spark and in DuckDB text.

Each view reads its whole table. ``Views`` holds the Spark side; ``VIEWS`` the SQL of the
same rows for the checks; ``sql`` puts the needed ones in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import scalars as S
from threadlake.operators.pooling import centroid


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    # -- files and folders ------------------------------------------------------

    def catalog(self) -> DataFrame:
        """Documents as catalogue rows: copies share an id, suffixes vary in case."""
        return self.table("documents").select(
            F.col("doc_id").alias("rowid"),
            S.content_id(F.octet_length("text"), "text").alias("id"),
            self._path(F.col("doc_id")).alias("file_path"),
            F.concat(F.col("doc_id").cast("string"), self._suffix()).alias("file_name"),
            F.when(F.col("doc_id") % 7 == 0, "jpg").otherwise("emb").alias("format"),
            S.size_kb(F.octet_length("text")).alias("size_kb"),
            (F.lit(1704067200) + F.col("doc_id")).alias("file_mtime"),
            (F.col("doc_id") % 5 != 0).alias("has_preview"),
            (F.lit(1704067200) + (F.col("doc_id") * 37) % 1009).alias("indexed_at"),
        )

    @staticmethod
    def _suffix():
        doc = F.col("doc_id")
        return F.when(doc % 10 == 0, ".EMB").when(doc % 7 == 0, ".jpg").otherwise(".emb")

    def _path(self, name):
        return F.concat(
            F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name.cast("string"), self._suffix()
        )

    def duplicated(self) -> DataFrame:
        """The catalogue with 40 file numbers per folder, so that paths repeat."""
        doc = F.col("rowid")
        return self.catalog().withColumn(
            "file_path",
            F.concat(F.regexp_extract("file_path", "^(.*/)", 1), (doc % 40).cast("string"), F.lit(".emb")),
        )

    def stored(self) -> DataFrame:
        """An earlier state of the library: a quarter of the files unchanged, a quarter
        with another mtime, a quarter at another path, a quarter with other content."""
        doc = F.col("rowid")
        before = self.catalog().select(
            "rowid",
            F.when(doc % 4 == 3, F.sha2(F.concat("id", F.lit("old")), 256)).otherwise(F.col("id")).alias("id"),
            F.when(doc % 4 == 2, F.concat(F.lit("/old"), "file_path")).otherwise(F.col("file_path")).alias("file_path"),
            "file_name",
            "format",
            "size_kb",
            F.when(doc % 4 == 1, F.col("file_mtime") - 60).otherwise(F.col("file_mtime")).alias("file_mtime"),
            "has_preview",
            "indexed_at",
        )
        best = before.groupBy("id").agg(F.max("rowid").alias("rowid"))
        return before.join(best, ["id", "rowid"], "left_semi")

    def files(self) -> DataFrame:
        """The current scan: one row per document, in id order."""
        return self.catalog().select(
            F.col("rowid").alias("seq"), "file_path", "file_mtime", "size_kb", "id"
        )

    def folders(self) -> DataFrame:
        """Source folders and their language folders with totals and states."""
        docs = self.table("documents")
        lang = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"))
        top = lang.groupBy("source").agg(F.sum("c").alias("c"))
        num = F.regexp_extract("source", r"(\d+)", 1).cast("long")
        rows = lang.select(
            F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("path"),
            F.col("lang").alias("name"),
            "c",
            (num + F.ascii("lang")).alias("k"),
        ).unionByName(
            top.select(F.concat(F.lit("/"), "source").alias("path"), F.col("source").alias("name"), "c", num.alias("k"))
        )
        states = F.array(*[F.lit(s) for s in (S.PENDING, S.IN_PROGRESS, S.COMPLETED, S.STOPPED, S.OUTDATED, S.SCOUTING, S.ERROR)])
        return rows.select(
            "path",
            "name",
            F.when(F.col("k") % 3 == 0, F.col("c") + 1).otherwise(F.col("c")).alias("total_files"),
            F.greatest(F.lit(0), F.col("c") - F.col("k") % 2).alias("indexed_files"),
            F.lit("").alias("last_file"),
            F.element_at(states, (F.col("k") % 7 + 1).cast("int")).alias("status"),
            (F.col("k") % 4 == 0).alias("needs_rescan"),
            (F.lit(1704067200) + F.col("k")).alias("last_scan"),
            F.lit(1704067200).cast("long").alias("updated_at"),
        )

    def incoming_folders(self) -> DataFrame:
        """A discovery batch over the language folders, plus new folders under /new."""
        f = self.folders().where(F.col("path").rlike("^/[^/]+/"))
        n = F.length("path") + F.ascii("name")
        kept = f.select(
            "path",
            "name",
            F.when(n % 2 == 0, F.lit(0)).otherwise(F.col("total_files") + 2).cast("long").alias("total_files"),
            F.lit(0).cast("long").alias("indexed_files"),
            F.when(n % 3 == 0, S.SCOUTING).when(n % 3 == 1, "pending").otherwise(S.COMPLETED).alias("status"),
            F.lit(False).alias("needs_rescan"),
            F.lit(0).cast("long").alias("last_scan"),
        )
        return kept.unionByName(kept.withColumn("path", F.concat(F.lit("/new"), "path")))

    def roots(self) -> DataFrame:
        """The source folders as scan roots, with file systems of several kinds."""
        num = F.regexp_extract("source", r"(\d+)", 1).cast("long")
        return self.table("documents").select("source").distinct().select(
            F.concat(F.lit("/"), "source").alias("path"),
            F.when(num % 5 == 0, "tmpfs").when(num % 5 == 1, "squashfs").otherwise("ext4").alias("fs_type"),
        )

    def mounts(self) -> DataFrame:
        """Mount points of all kinds, one per source and language."""
        head = (
            F.when(F.col("lang") == "de", "/dev/")
            .when(F.col("lang") == "en", "/media/")
            .when(F.col("lang") == "es", "/home/")
            .otherwise("/snapshots/")
        )
        num = F.regexp_extract("source", r"(\d+)", 1).cast("long")
        return self.table("documents").select("source", "lang").distinct().select(
            F.concat(head, "source").alias("path"),
            F.when(num % 5 == 0, "tmpfs").when(num % 5 == 1, "squashfs").otherwise("ext4").alias("fs_type"),
        )

    def items(self) -> DataFrame:
        """Names like '/src3/s (12).emb' for every document."""
        doc = F.col("doc_id")
        return self.table("documents").select(
            F.concat(
                F.lit("/"), "source", F.lit("/"),
                F.when(doc % 2 == 0, "s").otherwise("S"),
                F.when(doc % 11 == 0, " x").otherwise(F.concat(F.lit(" ("), doc.cast("string"), F.lit(")"))),
                F.when(doc % 11 == 0, doc.cast("string")).otherwise(""),
                F.when(doc % 10 == 0, ".EMB").otherwise(".emb"),
            ).alias("file_path")
        )

    def pictures(self) -> DataFrame:
        """Companion images of two thirds of the items, in several spellings; one in nine
        items has two of them."""
        doc = F.col("doc_id")
        stem = F.concat(
            F.lit("/"), "source", F.lit("/"),
            F.when(doc % 2 == 0, "s").otherwise("S"),
            F.when(doc % 11 == 0, F.concat(F.lit(" x"), doc.cast("string"))).otherwise(
                F.concat(F.lit(" ("), doc.cast("string"), F.lit(")"))
            ),
        )
        kinds = (
            F.when(doc % 9 == 0, F.array(F.lit(".png"), F.lit(".JPG")))
            .when(doc % 3 == 0, F.array().cast("array<string>"))
            .when(doc % 3 == 1, F.array(F.lit(".jpg")))
            .otherwise(F.array(F.lit(".Jpeg")))
        )
        return self.table("documents").select(stem.alias("s"), F.explode(kinds).alias("e")).select(
            F.concat("s", "e").alias("file_path")
        )

    # -- vectors ----------------------------------------------------------------

    def vectors(self) -> DataFrame:
        """Embeddings as a searchable catalogue; two thirds have a companion vector."""
        v = F.col("vec_id")
        return self.table("embeddings").select(
            v.alias("id"),
            F.concat(F.lit("/lib"), F.col("label").cast("string"), F.lit("/"), v.cast("string"), F.lit(".emb")).alias("file_path"),
            F.concat(
                F.when(v % 2 == 0, "s").otherwise("S"), F.lit(" ("), F.col("label").cast("string"), F.lit(") "),
                v.cast("string"), F.lit(".emb"),
            ).alias("file_name"),
            F.when(v % 10 == 0, "EMB").when(v % 7 == 0, "jpg").otherwise("emb").alias("format"),
            (v * 0.5).cast("double").alias("size_kb"),
            (v % 5 != 0).alias("has_preview"),
            "embedding",
            F.when(v % 3 != 0, F.reverse("embedding")).alias("companion"),
            "label",
        )

    def view_queries(self) -> DataFrame:
        """Five query views per label: the mean vectors of its items by vec_id mod 5."""
        grouped = self.table("embeddings").select(
            F.col("label").cast("long").alias("query_id"), (F.col("vec_id") % 5).alias("view_id"), "embedding"
        )
        return centroid(grouped, ["query_id", "view_id"], "embedding").withColumnRenamed("embedding", "qv")

    def eval_queries(self) -> DataFrame:
        """Evaluation queries: one per label and vec_id mod 7, two views each."""
        grouped = self.table("embeddings").select(
            (F.col("label") * 7 + F.col("vec_id") % 7).cast("long").alias("query_id"),
            (F.col("vec_id") % 2).alias("view_id"),
            "embedding",
        )
        return centroid(grouped, ["query_id", "view_id"], "embedding").withColumnRenamed("embedding", "qv")

    def truth(self) -> DataFrame:
        q = (F.col("label") * 7 + F.col("vec_id") % 7).cast("long")
        return (
            self.table("embeddings")
            .select(q.alias("query_id"), F.col("label").cast("string").alias("num"))
            .distinct()
            .select(
                "query_id",
                F.concat(F.lit("s ("), "num", F.lit(").emb")).alias("expected"),
                "num",
                F.when(F.col("query_id") % 2 == 0, "s").otherwise("S").alias("prefix"),
                F.when(F.col("query_id") % 3 == 0, ".png").otherwise(".jpg").alias("ext"),
            )
        )

    # -- sequences and pictures ----------------------------------------------------

    def events(self) -> DataFrame:
        ts = "from_utc_timestamp(cast(ts as timestamp), current_timezone())"
        return self.table("events").selectExpr(
            "event_id as seq",
            "user_id",
            """concat('/src', cast(user_id % 20 as string), '/', cast(user_id as string),
                      case when user_id % 3 = 0 then '.jpg' else '.emb' end) as path""",
            """case event_type when 'signup' then 'create' when 'error' then 'remove'
                               when 'purchase' then 'rename' else 'write' end as op""",
            f"{ts} as ts",
        )

    def watched(self) -> DataFrame:
        """Items around the events, one or two per user: even users have '.emb', odd ones an
        item of another name, every fifth also '.EMB'."""
        user = F.col("user_id").cast("string")
        names = F.when(F.col("user_id") % 2 == 0, F.array(F.concat(user, F.lit(".emb")))).otherwise(
            F.array(F.concat(F.lit("u"), user, F.lit(".emb")))
        )
        extra = F.when(F.col("user_id") % 5 == 0, F.array(F.concat(user, F.lit(".EMB")))).otherwise(
            F.array().cast("array<string>")
        )
        users = self.table("events").select("user_id").distinct()
        head = F.concat(F.lit("/src"), (F.col("user_id") % 20).cast("string"), F.lit("/"))
        return users.select(head.alias("h"), F.explode(F.concat(names, extra)).alias("n")).select(
            F.concat("h", "n").alias("file_path")
        )

    def stitches(self) -> DataFrame:
        return self.table("events").selectExpr(
            "user_id as design_id",
            "event_id as seq",
            "cast(floor(value) as int) as x",
            "cast(event_id % 997 as int) as y",
            """case event_type when 'purchase' then 'JUMP' when 'signup' then 'COLOR_CHANGE'
                               when 'error' then 'TRIM' else 'STITCH' end as cmd""",
        )

    def ended_stitches(self) -> DataFrame:
        """The same records, with an END where the value is above 95."""
        return self.table("events").selectExpr(
            "user_id as design_id",
            "event_id as seq",
            "cast(floor(value) as int) as x",
            "cast(event_id % 997 as int) as y",
            """case when value > 95 then 'END' when event_type = 'purchase' then 'JUMP'
                    when event_type = 'signup' then 'COLOR_CHANGE'
                    when event_type = 'error' then 'TRIM' else 'STITCH' end as cmd""",
        )

    def pixels(self) -> DataFrame:
        """Each embedding as an 8 x 8 picture."""
        v = "cast(floor((cast(e as double) + 1.0D) * 127.5D) as int)"
        return self.table("embeddings").selectExpr("vec_id as img_id", "posexplode(embedding) as (i, e)").selectExpr(
            "img_id", "i % 8 as x", "i div 8 as y",
            f"{v} as r", f"255 - {v} as g", f"({v} * 3) % 256 as b",
            "case when (img_id + i) % 6 = 0 then 90 else 255 end as a",
        )

    def images(self) -> DataFrame:
        """The same pictures without alpha, one row of RGB bytes each."""
        def byte(value):
            return F.lpad(F.hex(value), 2, "0")

        def rgb(e):
            v = F.floor((e.cast("double") + F.lit(1.0)) * F.lit(127.5)).cast("long")
            return F.concat(byte(v), byte(F.lit(255) - v), byte((v * 3) % 256))

        return self.table("embeddings").select(
            F.col("vec_id").alias("img_id"),
            F.col("label").alias("item_id"),
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            F.lit(3).alias("channels"),
            F.unhex(F.array_join(F.transform("embedding", rgb), "")).alias("data"),
        )

    def images_rgba(self) -> DataFrame:
        """The rows of ``pixels`` packed: one picture of RGBA bytes per embedding."""
        def byte(value):
            return F.lpad(F.hex(value), 2, "0")

        def rgba(e, i):
            v = F.floor((e.cast("double") + F.lit(1.0)) * F.lit(127.5)).cast("long")
            alpha = F.when((F.col("vec_id") + i) % 6 == 0, F.lit(90)).otherwise(F.lit(255)).cast("long")
            return F.concat(byte(v), byte(F.lit(255) - v), byte((v * 3) % 256), byte(alpha))

        return self.table("embeddings").select(
            F.col("vec_id").alias("img_id"),
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            F.lit(4).alias("channels"),
            F.unhex(F.array_join(F.transform("embedding", rgba), "")).alias("data"),
        )


# The same views for DuckDB. name -> (views it needs, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "catalog": ((), """
        select doc_id as rowid,
               sha256(octet_length(encode(text))::varchar || text) as id,
               '/' || source || '/' || lang || '/' || doc_id::varchar ||
                 case when doc_id % 10 = 0 then '.EMB' when doc_id % 7 = 0 then '.jpg' else '.emb' end as file_path,
               doc_id::varchar ||
                 case when doc_id % 10 = 0 then '.EMB' when doc_id % 7 = 0 then '.jpg' else '.emb' end as file_name,
               case when doc_id % 7 = 0 then 'jpg' else 'emb' end as format,
               octet_length(encode(text)) / 1024.0::double as size_kb,
               1704067200 + doc_id as file_mtime,
               doc_id % 5 <> 0 as has_preview,
               1704067200 + (doc_id * 37) % 1009 as indexed_at
        from documents"""),
    "duplicated": (("catalog",), """
        select * replace (regexp_extract(file_path, '^(.*/)', 1) || (rowid % 40)::varchar || '.emb' as file_path)
        from catalog"""),
    "stored": (("catalog",), """
        select * from (
          select * replace (
            case when rowid % 4 = 3 then sha256(id || 'old') else id end as id,
            case when rowid % 4 = 2 then '/old' || file_path else file_path end as file_path,
            case when rowid % 4 = 1 then file_mtime - 60 else file_mtime end as file_mtime)
          from catalog)
        qualify row_number() over (partition by id order by rowid desc) = 1"""),
    "files": (("catalog",), "select rowid as seq, file_path, file_mtime, size_kb, id from catalog"),
    "folders": ((), """
        select path, name, case when k % 3 = 0 then c + 1 else c end as total_files,
               greatest(0, c - k % 2) as indexed_files, '' as last_file,
               (['Pending', 'In Progress', 'Completed', 'Stopped', 'Outdated', 'Scouting...', 'Error'])[k % 7 + 1] as status,
               k % 4 = 0 as needs_rescan, 1704067200 + k as last_scan, 1704067200::bigint as updated_at
        from (
          select '/' || source || '/' || lang as path, lang as name, count(*) as c,
                 regexp_extract(source, '(\\d+)', 1)::bigint + ascii(lang) as k
          from documents group by source, lang
          union all
          select '/' || source, source, count(*), regexp_extract(source, '(\\d+)', 1)::bigint
          from documents group by source)"""),
    "incoming_folders": (("folders",), """
        select path, name, total_files, 0::bigint as indexed_files, status, false as needs_rescan, 0::bigint as last_scan
        from (
          select path, name,
                 case when (length(path) + ascii(name)) % 2 = 0 then 0 else total_files + 2 end as total_files,
                 case when (length(path) + ascii(name)) % 3 = 0 then 'Scouting...'
                      when (length(path) + ascii(name)) % 3 = 1 then 'pending' else 'Completed' end as status
          from folders where regexp_matches(path, '^/[^/]+/'))
        union all
        select '/new' || path, name,
               case when (length(path) + ascii(name)) % 2 = 0 then 0 else total_files + 2 end,
               0::bigint,
               case when (length(path) + ascii(name)) % 3 = 0 then 'Scouting...'
                    when (length(path) + ascii(name)) % 3 = 1 then 'pending' else 'Completed' end,
               false, 0::bigint
        from folders where regexp_matches(path, '^/[^/]+/')"""),
    "roots": ((), """
        select distinct '/' || source as path,
               case regexp_extract(source, '(\\d+)', 1)::bigint % 5 when 0 then 'tmpfs' when 1 then 'squashfs' else 'ext4' end as fs_type
        from documents"""),
    "mounts": ((), """
        select distinct case lang when 'de' then '/dev/' when 'en' then '/media/' when 'es' then '/home/' else '/snapshots/' end || source as path,
               case regexp_extract(source, '(\\d+)', 1)::bigint % 5 when 0 then 'tmpfs' when 1 then 'squashfs' else 'ext4' end as fs_type
        from documents"""),
    "items": ((), """
        select '/' || source || '/' || case when doc_id % 2 = 0 then 's' else 'S' end ||
               case when doc_id % 11 = 0 then ' x' || doc_id::varchar else ' (' || doc_id::varchar || ')' end ||
               case when doc_id % 10 = 0 then '.EMB' else '.emb' end as file_path
        from documents"""),
    "pictures": ((), """
        select '/' || source || '/' || case when doc_id % 2 = 0 then 's' else 'S' end ||
               case when doc_id % 11 = 0 then ' x' || doc_id::varchar else ' (' || doc_id::varchar || ')' end || e as file_path
        from documents, unnest(case when doc_id % 9 = 0 then ['.png', '.JPG'] when doc_id % 3 = 0 then []::varchar[]
                                    when doc_id % 3 = 1 then ['.jpg'] else ['.Jpeg'] end) as t(e)"""),
    "vectors": ((), """
        select vec_id as id, '/lib' || label::varchar || '/' || vec_id::varchar || '.emb' as file_path,
               case when vec_id % 2 = 0 then 's' else 'S' end || ' (' || label::varchar || ') ' || vec_id::varchar || '.emb' as file_name,
               case when vec_id % 10 = 0 then 'EMB' when vec_id % 7 = 0 then 'jpg' else 'emb' end as format,
               (vec_id * 0.5)::double as size_kb, vec_id % 5 <> 0 as has_preview,
               embedding::double[] as embedding,
               case when vec_id % 3 <> 0 then list_reverse(embedding::double[]) end as companion, label
        from embeddings"""),
    "view_queries": ((), """
        with e as (
          select label::bigint as query_id, vec_id % 5 as view_id,
                 unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
        m as (select query_id, view_id, i, avg(x) as x from e group by all),
        n as (select query_id, view_id, sqrt(sum(x * x)) as len from m group by all)
        select query_id, view_id, list(x / len order by i) as qv
        from m join n using (query_id, view_id) group by all"""),
    "eval_queries": ((), """
        with e as (
          select (label * 7 + vec_id % 7)::bigint as query_id, vec_id % 2 as view_id,
                 unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
        m as (select query_id, view_id, i, avg(x) as x from e group by all),
        n as (select query_id, view_id, sqrt(sum(x * x)) as len from m group by all)
        select query_id, view_id, list(x / len order by i) as qv
        from m join n using (query_id, view_id) group by all"""),
    "truth": ((), """
        select query_id, 's (' || num || ').emb' as expected, num,
               case when query_id % 2 = 0 then 's' else 'S' end as prefix,
               case when query_id % 3 = 0 then '.png' else '.jpg' end as ext
        from (select distinct (label * 7 + vec_id % 7)::bigint as query_id, label::varchar as num from embeddings)"""),
    "found": (("vectors", "eval_queries"), """
        with s as (
          select q.query_id, q.view_id, v.id, v.file_name, v.has_preview,
                 round(list_inner_product(v.embedding, q.qv), 6) as score
          from vectors v, eval_queries q where lower(v.format) = 'emb'),
        d as (select * from s qualify row_number() over (partition by query_id, view_id order by score desc, id) <= 1000),
        p as (select query_id, id, file_name, max(score) as score from d where has_preview group by all having max(score) > 0)
        select *, row_number() over (partition by query_id order by score desc, id) as position
        from p qualify position <= 10"""),
    "eval_rows": (("found", "truth"), """
        select t.query_id, t.expected, t.num, t.prefix, t.ext, r.rank,
               coalesce(f.score, 0.0) as score, coalesce(f.file_name, '?') as top_match, f.score is not null as has_results
        from truth t
        left join (
          select f.query_id, min(f.position) as rank from found f join truth t on f.query_id = t.query_id
             and regexp_extract(f.file_name, '\\((\\d+)\\)', 1) = t.num
             and lower(substr(f.file_name, 1, 1)) = lower(t.prefix)
          group by f.query_id) r using (query_id)
        left join found f on f.query_id = t.query_id and f.position = 1"""),
    "ev": ((), """
        select event_id as seq, user_id,
               '/src' || (user_id % 20)::varchar || '/' || user_id::varchar ||
                 case when user_id % 3 = 0 then '.jpg' else '.emb' end as path,
               case event_type when 'signup' then 'create' when 'error' then 'remove'
                               when 'purchase' then 'rename' else 'write' end as op,
               epoch_us(ts) as us
        from events"""),
    "watched": ((), """
        select '/src' || (user_id % 20)::varchar || '/' || n as file_path
        from (select distinct user_id from events),
             unnest(list_concat([case when user_id % 2 = 0 then '' else 'u' end || user_id::varchar || '.emb'],
                                case when user_id % 5 = 0 then [user_id::varchar || '.EMB'] else []::varchar[] end)) as t(n)"""),
    "stitches": ((), """
        select user_id as design_id, event_id as seq, floor(value)::int as x, (event_id % 997)::int as y,
               case event_type when 'purchase' then 'JUMP' when 'signup' then 'COLOR_CHANGE'
                               when 'error' then 'TRIM' else 'STITCH' end as cmd
        from events"""),
    "ended_stitches": ((), """
        select user_id as design_id, event_id as seq, floor(value)::int as x, (event_id % 997)::int as y,
               case when value > 95 then 'END' when event_type = 'purchase' then 'JUMP'
                    when event_type = 'signup' then 'COLOR_CHANGE' when event_type = 'error' then 'TRIM' else 'STITCH' end as cmd
        from events"""),
    "pixels": ((), """
        select img_id, (i % 8)::int as x, (i // 8)::int as y, v as r, 255 - v as g, (v * 3) % 256 as b,
               case when (img_id + i) % 6 = 0 then 90 else 255 end as a
        from (select img_id, i, floor((e + 1.0::double) * 127.5::double)::int as v
              from (select vec_id as img_id, unnest(embedding)::double as e,
                           generate_subscripts(embedding, 1) - 1 as i from embeddings))"""),
}


def sql(body: str, *names: str) -> str:
    """``body`` (a select, or CTEs starting with 'with') after the views it uses."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    text = body.strip()
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1].strip()})" for n in order)
    if not ctes:
        return text
    if text.lower().startswith("with "):
        return f"with {ctes},\n{text[5:]}"
    return f"with {ctes}\n{text}"
