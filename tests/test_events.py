import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadlake.streaming import events as EV
from threadlake.streaming import progress as PR
from threadlake.streaming import timers
from threadlake.streaming.timers import finish

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "path string, op string, ts timestamp, seq long"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, data):
    """(path, op, seconds) in order."""
    return spark.createDataFrame([(p, o, at(s), i) for i, (p, o, s) in enumerate(data)], SCHEMA)


def bursts(data, gap):
    out = []
    for path in {p for p, _, _ in data}:
        mine = sorted((s, i, o) for i, (p, o, s) in enumerate(data) if p == path)
        group = [mine[0]]
        for e in mine[1:]:
            if e[0] - group[-1][0] > gap:
                out.append((path, group[-1][2], at(group[0][0]), at(group[-1][0]), len(group)))
                group = []
            group.append(e)
        out.append((path, group[-1][2], at(group[0][0]), at(group[-1][0]), len(group)))
    return sorted(out)


@pytest.mark.parametrize("segment", ["1 day", "5 seconds", "20 seconds"])
def test_debounce_equals_brute_force(spark, rows, segment):
    rng = random.Random(segment)
    data = [
        (rng.choice(["/hot", "/hot", "/hot", "/b", "/c"]), rng.choice(["create", "write", "remove"]), rng.randint(0, 3000) / 4)
        for _ in range(400)
    ]
    got = rows(EV.debounce(frame(spark, data), "1500 milliseconds", segment))
    assert got == bursts(data, 1.5) and len(got) <= len(data)


def test_events_exactly_the_gap_apart_are_one_burst(spark, rows):
    data = [("/a", "create", 0), ("/a", "write", 0.75), ("/a", "remove", 1.500001)]
    got = rows(EV.debounce(frame(spark, data)), "op", "n")
    assert got == [("remove", 1), ("write", 2)]


def test_classification(spark, rows):
    data = [(p, o, 0) for p in ("/a.EMB", "/a.jpeg", "/a.txt") for o in ("create", "write", "remove", "rename", "chmod")]
    got = rows(EV.classify_events(frame(spark, data)), "path", "op", "action")
    item = {"create": "index", "write": "index", "remove": "delete", "rename": "delete_later"}
    assert got == sorted([("/a.EMB", o, a) for o, a in item.items()] + [("/a.jpeg", o, "reindex_owner") for o in item])


def test_companion_events_go_to_their_item(spark, rows):
    items = spark.createDataFrame([("/d/a.EMB",), ("/d/a.emb",), ("/d/b.EMB",)], "file_path string")
    ev = EV.classify_events(frame(spark, [("/d/a.jpg", "write", 0), ("/d/b.png", "remove", 1), ("/d/c.jpg", "write", 2), ("/d/q.emb", "write", 3)]))
    assert rows(EV.to_owner(ev, items), "path", "target") == [
        ("/d/a.jpg", "/d/a.emb"), ("/d/b.png", "/d/b.EMB"), ("/d/q.emb", "/d/q.emb")
    ]


RENAMES = [
    ("/a.emb", "rename", 10), ("/a.emb", "create", 11.5),     # comes back: stays
    ("/b.emb", "rename", 10), ("/b.emb", "create", 12),       # comes back at the last moment: stays
    ("/c.emb", "rename", 10), ("/c.emb", "create", 12.001),   # too late: goes
    ("/d.emb", "create", 9), ("/d.emb", "rename", 10),        # created before: goes
    ("/e.emb", "rename", 10), ("/e.emb", "write", 10.5), ("/e.emb", "rename", 11),  # second one goes
    ("/f.jpg", "rename", 10),                                 # not an item
    ("/g.emb", "rename", 10), ("/g.emb", "remove", 11),       # removed as well: goes
]
GONE = [("/c.emb", at(10)), ("/d.emb", at(10)), ("/e.emb", at(11)), ("/g.emb", at(10))]


def test_rename_grace(spark, rows):
    assert rows(EV.rename_cleanup(frame(spark, RENAMES))) == GONE
    known = spark.createDataFrame([("/c.emb",), ("/q.emb",)], "file_path string")
    assert rows(EV.rename_cleanup(frame(spark, RENAMES), known)) == [("/c.emb", at(10))]


def test_rename_grace_against_brute_force(spark, rows):
    rng = random.Random(5)
    data = [(rng.choice(["/hot.emb", "/hot.emb", "/b.emb"]), rng.choice(["rename", "create", "write", "remove"]), rng.randint(0, 900) / 3) for _ in range(300)]
    want = sorted({
        (p, at(s)) for p, o, s in data
        if o == "rename" and not any(q == p and x in ("create", "write") and s < t <= s + 2 for q, x, t in data)
    })
    # times are stored to the microsecond
    assert [(p, t) for p, t in rows(EV.rename_cleanup(frame(spark, data)))] == want


def run_stream(spark, tmp_path, batches, build, schema, write_schema):
    """Feeds the batches one after the other, and returns all rows that came out."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        query = (
            build(spark.readStream.schema(write_schema).parquet(source))
            .writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(schema).parquet(sink)


def test_debounce_by_watermark_over_restarts(spark, rows, tmp_path):
    one = [("/a", "create", 0), ("/a", "write", 0.5), ("/b", "write", 0.2)]
    two = [("/a", "write", 1.0), ("/z", "write", 30)]
    late_and_last = [("/b", "write", 0.3), ("/z", "write", 100)]
    out = run_stream(
        spark, tmp_path, [frame(spark, x) for x in (one, two, late_and_last)],
        lambda s: EV.debounce_by_watermark(s, delay="5 seconds"),
        "path string, op string, first_ts timestamp, last_ts timestamp, n long", SCHEMA,
    )
    # the late event on /b is older than the watermark and dropped; /z at 100 s stays open
    assert rows(out, "path", "op", "n") == [("/a", "write", 3), ("/b", "write", 1), ("/z", "write", 1)]


def run_timed(spark, tmp_path, batches, build, schema, write_schema):
    """Feeds the batches to one running query with timers, each after the one before was read,
    and returns all rows that came out by the time nothing was open."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches[0].limit(0).coalesce(1).write.parquet(source)
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = (
        build(spark.readStream.schema(write_schema).parquet(source))
        .writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="2 seconds").start()
    )
    spark.conf.set("spark.sql.shuffle.partitions", few)
    read = 0
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        read += batch.count()
        while sum(p["numInputRows"] for p in query.recentProgress) < read:
            query.awaitTermination(0.1)
    finish(query)
    return spark.read.schema(schema).parquet(sink)


BURST = "path string, op string, first_ts timestamp, last_ts timestamp, n long"


def test_timed_debounce_equals_batch_without_a_last_event(spark, rows, tmp_path):
    rng = random.Random(4)
    data = sorted(
        ((rng.choice(["/hot", "/hot", "/b", "/c"]), rng.choice(["create", "write", "remove"]), rng.randint(0, 600) / 4) for _ in range(200)),
        key=lambda e: e[2],
    )
    parts = [data[:70], data[70:150], data[150:]]
    got = run_timed(
        spark, tmp_path, [frame(spark, x) for x in parts],
        lambda s: EV.debounce_stream(s, "1500 milliseconds", quiet="12 seconds"), BURST, SCHEMA,
    )
    # bursts that lie in two batches are one, and the last ones of each path are there
    assert sorted((p, f, t, n) for p, _, f, t, n in rows(got)) == sorted((p, f, t, n) for p, _, f, t, n in bursts(data, 1.5))


def test_timed_debounce_takes_late_events(spark, rows, tmp_path):
    one = [("/a", "create", 1000), ("/b", "write", 5)]
    late = [("/a", "write", 1), ("/b", "rename", 4.5), ("/b", "create", 4)]
    got = run_timed(
        spark, tmp_path, [frame(spark, one), frame(spark, late)],
        lambda s: EV.debounce_stream(s, quiet="12 seconds", grace="12 seconds"), BURST, SCHEMA,
    )
    assert rows(got) == [
        ("/a", "create", at(1000), at(1000), 1), ("/a", "write", at(1), at(1), 1), ("/b", "write", at(4), at(5), 3)
    ]


def test_rename_stream_equals_batch(spark, rows, tmp_path):
    early = [e for e in RENAMES if e[2] < 11]
    late = [e for e in RENAMES if e[2] >= 11]
    out = run_timed(
        spark, tmp_path, [frame(spark, x) for x in (early, late)],
        lambda s: EV.rename_cleanup_stream(s, wait="12 seconds"), "path string, renamed_at timestamp", SCHEMA,
    )
    assert rows(out) == GONE


def test_targets_are_unique_for_a_while(spark, rows, tmp_path):
    schema = "target string, ts timestamp, _x int"
    one = spark.createDataFrame([("/a", at(0), 1), ("/a", at(0), 1), ("/b", at(1), 2)], schema)
    two = spark.createDataFrame([("/a", at(-9000), 3), ("/c", at(2), 4)], schema)
    out = run_timed(spark, tmp_path, [one, two], lambda s: EV.dedupe_targets(s, "12 seconds"), schema, schema)
    assert rows(out) == [("/a", at(0), 1), ("/b", at(1), 2), ("/c", at(2), 4)]


PROGRESS = "root string, ts timestamp, running boolean, paused boolean"


def beats(spark, data):
    return spark.createDataFrame([(r, at(s), run, pause) for r, s, run, pause in data], PROGRESS)


def test_stall_batch(spark, rows):
    data = [("/a", 0, True, False), ("/a", 100, True, False), ("/a", 221, True, False), ("/b", 0, True, True), ("/b", 900, True, False), ("/c", 0, False, False), ("/c", 500, True, False)]
    for segment in ("1 day", "50 seconds"):
        got = rows(PR.stalled(beats(spark, data), segment=segment), "root", "last_progress_at", "idle_us")
        assert got == [("/a", at(100), 121_000_000)]
    open_ends = PR.stalled(beats(spark, data), now=F.lit(at(1000)))
    assert rows(open_ends, "root", "last_progress_at") == [("/a", at(100)), ("/a", at(221)), ("/c", at(500))]


def test_stalls_are_told_when_all_roots_are_silent(spark, rows, tmp_path):
    steps = [
        [("/a", 0, True, False), ("/b", 0, True, True), ("/c", 0, True, False), ("/d", 50, False, False), ("/d", 40, True, False)],
        [("/c", 100, True, False)],
    ]
    out = run_timed(
        spark, tmp_path, [beats(spark, s) for s in steps], lambda s: PR.stalled_stream(s, "12 seconds"),
        "root string, last_progress_at timestamp", PROGRESS,
    )
    assert rows(out) == [("/a", at(0)), ("/c", at(100))]


def test_alive_and_summary(spark, rows):
    hb = spark.createDataFrame([("x", at(0)), ("x", at(10)), ("y", at(9.9))], "client string, ts timestamp")
    assert rows(PR.alive(hb, F.lit(at(24.95))), "client", "alive") == [("x", True), ("y", False)]
    ev = "discovered long, processed long, total long, scan_done boolean"
    running = spark.createDataFrame([(5, 2, 0, False), (3, 1, 0, False)], ev)
    assert tuple(PR.progress_summary(running).first()) == (3, 8, False)
    done = running.unionAll(spark.createDataFrame([(0, 0, 7, True)], ev))
    assert tuple(PR.progress_summary(done).first()) == (3, 7, True)
    assert tuple(PR.progress_summary(running.limit(0)).first()) == (0, 0, False)


def test_flushes(spark, rows):
    ev = spark.range(120).selectExpr("'/r' as root", "id as seq", "concat('/f', id) as path")
    for width in (10, 1000):
        assert rows(PR.progress_flushes(ev, segment_rows=width)) == [
            ("/r", "", 120, True), ("/r", "/f49", 50, False), ("/r", "/f99", 100, False)
        ]


def test_periodic_runs(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    seen = []
    q = PR.periodic(
        spark.readStream.schema("id long").parquet(source), lambda df, n: seen.append(df.count()), every="1 second",
        checkpointLocation=str(tmp_path / "m"),
    ).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [5] and os.path.isdir(tmp_path / "m")


def test_bursts_of_many_paths_share_their_state():
    """A batch costs requests to the state by bucket and not by path; paths of a bucket that wait
    longer are settled by their own times."""

    class State:
        value, asked = None, 0

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.asked, self.value = self.asked + 1, value

        def clear(self):
            self.asked, self.value = self.asked + 1, None

    class Timers:
        at = ()

        def listTimers(self):
            return iter(self.at)

        def deleteTimer(self, at):
            self.at = ()

        def registerTimer(self, at):
            self.at = (at,)

    class Clock:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    bursts = timers._Bursts(10, 5, 9, "path")
    bursts.state, bursts.handle = State(), Timers()
    frame = pd.DataFrame([(f"p{i}", "rename" if i % 2 else "write", t, i) for i in range(500) for t in (0, 8, 30)], columns=["path", "op", "us", "seq"])
    out = pd.concat(bursts.handleInputRows((0,), iter([frame[:700], frame[700:]]), Clock(100)))
    assert sorted(out["path"]) == sorted({f"p{i}" for i in range(500)}) and set(out["n"]) == {2} and set(out["last_us"]) == {8}
    assert bursts.state.asked <= 3 and bursts.handle.at == (105,)
    bursts.handle.at = ()
    out = pd.concat(bursts.handleExpiredTimer((0,), Clock(106), None))
    assert len(out) == 250 and set(out["op"]) == {"write"} and bursts.handle.at == (109,)
    bursts.handle.at = ()
    out = pd.concat(bursts.handleExpiredTimer((0,), Clock(109), None))
    assert len(out) == 250 and set(out["op"]) == {"rename"} and bursts.state.value is None and bursts.handle.at == ()
