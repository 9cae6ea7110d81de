"""Change events and progress: T1-T5, T8-T10, A17, P13, S9."""

import os

from pyspark.sql import functions as F

from threadlake.session import shared_dir
from threadlake.streaming import events as EV
from threadlake.streaming import progress as PR
from threadlake.streaming.timers import finish

from .registry import query
from .views import Views


# Partitions of the state of the streams below, whose batches are small.
STATE_PARTITIONS = 16


def us(col: str):
    return F.unix_micros(col).alias(col.replace("_ts", "_us").replace("_at", "_us"))


@query("p13_relevant_events", ("ev",), """
    select seq, path, op from ev where right(path, 4) in ('.emb', '.jpg', '.png')""")
def p13(v: Views):
    return EV.relevant_events(v.events()).select("seq", "path", "op")


_ACTION = """case when right(path, 4) <> '.emb' then 'reindex_owner' when op = 'remove' then 'delete'
                  when op = 'rename' then 'delete_later' else 'index' end"""


@query("t3_classify_events", ("ev",), f"select seq, path, op, {_ACTION} as action from ev")
def t3(v: Views):
    return EV.classify_events(v.events()).select("seq", "path", "op", "action")


@query("t4_companion_owner", ("ev", "watched"), f"""
    with o as (select regexp_extract(file_path, '^(.*)\\.[^.]*$', 1) as key, arg_min(file_path, right(file_path, 4) <> '.emb') as owner from watched group by all),
    e as (select seq, path, regexp_extract(path, '^(.*)\\.[^.]*$', 1) as key, {_ACTION} as action from ev)
    select seq, path, action, case when action = 'reindex_owner' then owner else path end as target
    from e left join o using (key) where action <> 'reindex_owner' or owner is not null""")
def t4(v: Views):
    out = EV.to_owner(EV.classify_events(v.events()), v.watched())
    return out.select("seq", "path", "action", "target")


_BURSTS = """
    with g as (select *, case when us - lag(us) over w > {gap} or lag(us) over w is null then 1 else 0 end as starts
               from ev window w as (partition by path order by us, seq)),
    b as (select *, sum(starts) over (partition by path order by us, seq) as burst from g),
    s as (select path, arg_max(op, (us, seq)) as op, min(us) as first_us, max(us) as last_us, count(*) as n from b group by path, burst)"""


@query("t2_debounce", ("ev",), _BURSTS.format(gap=6 * 3600 * 1000000) + " select path, op, first_us, last_us, n from s")
def t2(v: Views):
    return EV.debounce(v.events(), "6 hours", segment="2 days").select("path", "op", us("first_ts"), us("last_ts"), "n")


@query("t2_debounce_default", ("ev",), _BURSTS.format(gap=750000) + " select path, op, first_us, last_us, n from s")
def t2_default(v: Views):
    return EV.debounce(v.events()).select("path", "op", us("first_ts"), us("last_ts"), "n")


def _settled(v: Views, rows, build, schema: str):
    """What a stream with timers brings until nothing is open any more, over ``rows`` as files."""
    folder = os.path.join(shared_dir(v.spark), f"events-{os.urandom(4).hex()}")
    source, sink, mark = (os.path.join(folder, p) for p in ("in", "out", "mark"))
    rows.write.parquet(source)
    out = build(v.spark.readStream.schema(rows.schema).parquet(source))
    # a stream takes the number of its state's partitions from the session when it starts
    given = v.spark.conf.get("spark.sql.shuffle.partitions")
    v.spark.conf.set("spark.sql.shuffle.partitions", min(int(given), STATE_PARTITIONS))
    try:
        run = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(processingTime="2 seconds").start()
    finally:
        v.spark.conf.set("spark.sql.shuffle.partitions", given)
    finish(run)
    return v.spark.read.schema(schema).parquet(sink)


@query("t2_debounce_stream", ("ev",), _BURSTS.format(gap=6 * 3600 * 1000000) + " select path, op, first_us, last_us, n from s")
def t2_stream(v: Views):
    """T1 and T2 as a stream with timers: the last burst of a path is settled by the clock."""
    events = v.events().select("path", "op", "ts", "seq")
    schema = "path string, op string, first_ts timestamp, last_ts timestamp, n long"
    out = _settled(v, events, lambda s: EV.debounce_stream(s, "6 hours", quiet="2 seconds"), schema)
    return out.select("path", "op", us("first_ts"), us("last_ts"), "n")


@query("t2_debounce_arrival", ("ev",), _BURSTS.format(gap=6 * 3600 * 1000000) + " select path, op, first_us, last_us, n from s")
def t2_arrival(v: Views):
    """T1 and T2 as a stream that debounces what each trigger brings, here the whole table: no
    burst stays open."""
    folder = os.path.join(shared_dir(v.spark), f"events-{os.urandom(4).hex()}")
    source, sink, mark = (os.path.join(folder, p) for p in ("in", "out", "mark"))
    v.events().select("path", "op", "ts", "seq").write.parquet(source)

    def each(batch, batch_id: int) -> None:
        EV.debounce(batch, "6 hours", segment="2 days").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run = EV.read_events(v.spark, source).writeStream.option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(each).start()
    run.awaitTermination()
    schema = "path string, op string, first_ts timestamp, last_ts timestamp, n long"
    return v.spark.read.schema(schema).parquet(f"{sink}/batch=*").select("path", "op", us("first_ts"), us("last_ts"), "n")


@query("t5_rename_cleanup", ("ev",), """
    with i as (select * from ev where right(path, 4) = '.emb'),
    r as (select distinct path, us from i where op = 'rename')
    select path, us as renamed_us from r
    where not exists (from i where i.path = r.path and i.op in ('create', 'write') and i.us > r.us and i.us <= r.us + 43200000000)""")
def t5(v: Views):
    return EV.rename_cleanup(v.events(), grace="12 hours").select("path", us("renamed_at"))


@query("t5_rename_cleanup_known", ("ev", "watched"), """
    with i as (select * from ev where right(path, 4) = '.emb'),
    r as (select distinct path, us from i where op = 'rename')
    select path, us as renamed_us from r
    where path in (select file_path from watched)
      and not exists (from i where i.path = r.path and i.op in ('create', 'write') and i.us > r.us and i.us <= r.us + 2000000)""")
def t5_known(v: Views):
    return EV.rename_cleanup(v.events(), v.watched()).select("path", us("renamed_at"))


@query("t5_rename_stream", ("ev",), """
    with i as (select * from ev where right(path, 4) = '.emb'),
    r as (select distinct path, us from i where op = 'rename')
    select path, us as renamed_us from r
    where not exists (from i where i.path = r.path and i.op in ('create', 'write') and i.us > r.us and i.us <= r.us + 43200000000)""")
def t5_stream(v: Views):
    """T5 as a stream with timers."""
    events = v.events().select("path", "op", "ts", "seq")
    out = _settled(v, events, lambda s: EV.rename_cleanup_stream(s, "12 hours", wait="2 seconds"), "path string, renamed_at timestamp")
    return out.select("path", us("renamed_at"))


def _progress(v: Views):
    return v.table("events").select(
        F.when(F.col("event_type") != "error", 1).otherwise(0).cast("long").alias("discovered"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long").alias("processed"),
        (F.col("event_id") % 3).alias("total"),
        (F.col("value") > 99.9).alias("scan_done"),
        F.col("user_id"),
    )


@query("a17_progress_summary", (), """
    select count(*) filter (event_type = 'purchase') as processed,
           case when max(value) > 99.9 then sum(event_id % 3) else count(*) filter (event_type <> 'error') end::bigint as total,
           max(value) > 99.9 as scan_done
    from events""")
def a17(v: Views):
    return PR.progress_summary(_progress(v))


def _rooted(v: Views):
    return v.events().select(
        F.concat(F.lit("/src"), (F.col("user_id") % 20).cast("string")).alias("root"), "seq", "path", "ts",
        (F.col("op") != "remove").alias("running"), (F.col("op") == "rename").alias("paused"),
    )


@query("t8_progress_counters", ("ev",), """
    select '/src' || (user_id % 20)::varchar as root, count(*) as processed from ev group by all""")
def t8(v: Views):
    return PR.progress(_rooted(v))


@query("t8_progress_flushes", ("ev",), """
    with c as (select '/src' || (user_id % 20)::varchar as root, path, row_number() over (partition by user_id % 20 order by seq) as processed from ev)
    select root, path as last_file, processed, false as final from c where processed % 50 = 0
    union all select root, '', max(processed), true from c group by root""")
def t8_flushes(v: Views):
    return PR.progress_flushes(_rooted(v), segment_rows=1000)


@query("t9_stalled", ("ev",), """
    with i as (select user_id % 20 as r, us, bool_or(op <> 'remove') as running, bool_or(op = 'rename') as paused from ev group by all),
    g as (select *, lead(us) over (partition by r order by us) - us as idle_us from i)
    select '/src' || r::varchar as root, us as last_progress_us, idle_us from g
    where running and not paused and idle_us > 7200000000""")
def t9(v: Views):
    return PR.stalled(_rooted(v), "2 hours", segment="3 days").select("root", us("last_progress_at"), "idle_us")


@query("t9_stalled_stream", ("ev",), """
    with i as (select user_id % 20 as r, us, bool_or(op <> 'remove') as running, bool_or(op = 'rename') as paused from ev group by all)
    select '/src' || r::varchar as root, us as last_progress_us from i
    qualify us = max(us) over (partition by r) and running and not paused""")
def t9_stream(v: Views):
    """T9 as a stream with timers: after the last event all roots are silent."""
    out = _settled(v, _rooted(v), lambda s: PR.stalled_stream(s, "2 seconds"), "root string, last_progress_at timestamp")
    return out.select("root", us("last_progress_at"))


@query("t10_alive", ("ev",), """
    select user_id as client, max(us) as last_us, 1706659200000000 - max(us) < 86400000000 as alive from ev group by user_id""")
def t10(v: Views):
    beats = v.events().select(F.col("user_id").alias("client"), "ts")
    now = F.timestamp_micros(F.lit(1706659200000000))
    return PR.alive(beats, now, "1 day").select("client", F.unix_micros("last_beat").alias("last_us"), "alive")


@query("s9_progress_feed", ("ev",), """
    select '/src' || (user_id % 20)::varchar as root, count(*) as processed from ev group by all""")
def s9(v: Views):
    """The live feed over an event folder, last state of each counter."""
    folder = os.path.join(shared_dir(v.spark), f"feed-{os.urandom(4).hex()}")
    source, sink, mark = (os.path.join(folder, p) for p in ("in", "out", "mark"))
    _rooted(v).select("root", "seq").write.parquet(source)
    stream = v.spark.readStream.schema("root string, seq long").parquet(source)

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(sink)

    run = PR.progress_stream(stream, keep, checkpointLocation=mark).trigger(availableNow=True).start()
    run.awaitTermination()
    fed = v.spark.read.schema("root string, processed long, batch long").parquet(sink)
    return fed.groupBy("root").agg(F.max_by("processed", "batch").alias("processed"))
