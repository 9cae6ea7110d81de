"""Streams that wait by the clock: debounce, rename grace, repeated requests and stalls
(T2, T4, T5, T9).

Events are compared by their own times, but waiting is done by processing-time timers: what
is open is settled once nothing more has arrived for a while. So no later event is needed to
settle the last one, an event that arrives late is never dropped, and after a restart timers
that have run out meanwhile fire at once. State is a few numbers per key with something open;
bursts keep that of a bucket of keys together, as a key costs far more requests than numbers.

A query with timers runs a batch per trigger even without new events and never ends by
itself; ``availableNow`` is not for it. ``needs_timers`` chooses the state store they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LAST = np.iinfo("int64").max


def needs_timers(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in RocksDB; ones with a
    checkpoint go on with what they began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def finish(query, poll: float = 0.1) -> None:
    """Stops a query with timers once it has read what its source holds and no key has anything
    open; between two batches, as a batch that is cut off fails its tasks. Its error, if it
    has one, is raised."""
    drained = 0
    while query.isActive:
        done = query.lastProgress
        if done and done.batchId > 0 and not done.numInputRows and not any(o.numRowsTotal for o in done.stateOperators):
            drained += 1
            if not query.status["isTriggerActive"] or drained * poll > 10:
                query.stop()
                return
        query.awaitTermination(poll)
    query.awaitTermination()


class _Waiting(StatefulProcessor):
    """One timer per key, moved by ``wake``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", self.schema)

    def wake(self, at_ms: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_ms is not None:
            self.handle.registerTimer(int(at_ms))

    def close(self) -> None:
        pass


# Paths share a state row, and so a frame and a timer, with the others of their bucket.
BUCKETS = 1024


class _Bursts(_Waiting):
    """Open bursts of all keys of a bucket, each with the time its wait ends; one timer, at the
    first of these times."""

    fields = ("key", "op", "first", "last", "seq", "n", "due")
    schema = "key array<string>, op array<string>, first array<long>, last array<long>, seq array<long>, n array<long>, due array<long>"

    def __init__(self, gap_us: int, quiet_ms: int, grace_ms: int, key: str):
        self.gap, self.quiet, self.grace, self.key = gap_us, quiet_ms, grace_ms, key

    def _bursts(self, pieces: pd.DataFrame) -> pd.DataFrame:
        """Bursts of pieces (fields without due) of any keys, by key and time."""
        code = pd.factorize(pieces["key"], use_na_sentinel=False)[0]
        order = np.lexsort((pieces["first"].to_numpy(), code))
        p, code = pieces.iloc[order].reset_index(drop=True), code[order]
        first, last = p["first"].to_numpy(), p["last"].to_numpy()
        reached = p["last"].groupby(code).cummax().to_numpy()
        new = np.ones(len(p), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (first[1:] - reached[:-1] > self.gap)
        starts = np.flatnonzero(new)
        # the last event of a burst: by time, then seq
        ranked = np.lexsort((pd.factorize(p["op"], sort=True)[0], p["seq"].to_numpy(), last, np.cumsum(new)))
        end = ranked[np.append(starts[1:], len(p)) - 1]
        n = np.add.reduceat(p["n"].to_numpy(), starts)
        return pd.DataFrame({"key": p["key"].to_numpy(object)[starts], "op": p["op"].to_numpy(object)[end], "first": first[starts], "last": last[end], "seq": p["seq"].to_numpy()[end], "n": n})

    def _out(self, bursts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({self.key: bursts["key"], "op": bursts["op"], "first_us": bursts["first"], "last_us": bursts["last"], "n": bursts["n"]})

    def _held(self) -> pd.DataFrame | None:
        found = self.state.get()
        return None if found is None else pd.DataFrame({f: pd.Series(list(x), dtype=object if f in ("key", "op") else "int64") for f, x in zip(self.fields, found)})

    def _hold(self, open_: pd.DataFrame) -> None:
        if len(open_):
            text = {f: [x if isinstance(x, str) else None for x in open_[f]] for f in ("key", "op")}
            self.state.update(tuple(text[f] if f in text else open_[f].tolist() for f in self.fields))
            self.wake(int(open_["due"].min()))
        else:
            self.state.clear()
            self.wake(None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = []
        for frame in rows:
            us = frame["us"].to_numpy("int64")
            events = {"key": frame[self.key].to_numpy(object), "op": frame["op"].to_numpy(object), "first": us, "last": us, "seq": frame["seq"].fillna(-1).to_numpy("int64"), "n": np.ones(len(us), dtype="int64")}
            pieces.append(self._bursts(pd.DataFrame(events)))
        if not pieces:
            return
        held = self._held()
        # keys that nothing has arrived for keep their bursts and the ends of their waits
        other = None
        if held is not None:
            here = held["key"].isin(pd.concat([p["key"] for p in pieces]))
            other = held[~here]
            pieces.append(held.loc[here, list(self.fields[:-1])])
        bursts = self._bursts(pd.concat(pieces, ignore_index=True)) if len(pieces) > 1 else pieces[0]
        # a later burst shows that the ones before it are over
        code = pd.factorize(bursts["key"], use_na_sentinel=False)[0]
        ends = np.append(code[1:] != code[:-1], True)
        open_ = bursts[ends]
        wait = np.where(open_["op"] == "rename", max(self.quiet, self.grace), self.quiet)
        open_ = open_.assign(due=timerValues.getCurrentProcessingTimeInMs() + wait)
        self._hold(open_ if other is None else pd.concat([other, open_], ignore_index=True))
        if not ends.all():
            yield self._out(bursts[~ends])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held is None:
            return
        over = held["due"] <= timerValues.getCurrentProcessingTimeInMs()
        self._hold(held[~over])
        if over.any():
            yield self._out(held[over])


class _Renames(_Waiting):
    """Open renames with the time their wait ends, and what was present lately, likewise."""

    schema = "renamed array<long>, due array<long>, present array<long>, until array<long>"

    def __init__(self, grace_us: int, wait_ms: int):
        self.grace, self.wait = grace_us, wait_ms

    def _settle(self, key: tuple, open_: dict, back: dict, now: int) -> Iterator[pd.DataFrame]:
        renames, present = np.array(sorted(open_), "int64"), np.array(sorted(back), "int64")
        # the first presence event after a rename answers it if it is within the grace
        first = np.append(present, _LAST)[np.searchsorted(present, renames, side="right")]
        waiting = renames[first > renames + self.grace].tolist()
        gone = [r for r in waiting if open_[r] <= now]
        open_ = {r: open_[r] for r in waiting if open_[r] > now}
        back = {p: t for p, t in back.items() if t > now}
        if open_ or back:
            self.state.update((list(open_), list(open_.values()), list(back), list(back.values())))
            self.wake(min([*open_.values(), *back.values()]))
        else:
            self.state.clear()
            self.wake(None)
        if gone:
            yield pd.DataFrame({"path": [key[0]] * len(gone), "us": gone})

    def _held(self) -> tuple[dict, dict]:
        if not self.state.exists():
            return {}, {}
        renamed, due, present, until = self.state.get()
        return dict(zip(renamed, due)), dict(zip(present, until))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        open_, back = self._held()
        for frame in rows:
            for us, op in zip(frame["us"].tolist(), frame["op"]):
                if op == "rename":
                    open_.setdefault(us, now + self.wait)
                else:
                    back[us] = now + self.wait
        yield from self._settle(key, open_, back, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_, back = self._held()
        yield from self._settle(key, open_, back, timerValues.getCurrentProcessingTimeInMs())


class _First(_Waiting):
    schema = "until long"

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not self.state.exists():
            until = timerValues.getCurrentProcessingTimeInMs() + self.quiet
            self.state.update((until,))
            self.wake(until)
            yield frames[0].head(1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


class _Stalls(_Waiting):
    schema = "last long, running boolean, paused boolean"

    def __init__(self, limit_ms: int, key: str):
        self.limit, self.key = limit_ms, key

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, running, paused = tuple(self.state.get()) if self.state.exists() else (None, False, False)
        for frame in rows:
            us = frame["us"]
            at = int(us.max())
            if last is None or at >= last:
                row = frame.loc[us == at]
                if at != last:
                    running = paused = False
                last, running, paused = at, running or bool(row["running"].any()), paused or bool(row["paused"].any())
        self.state.update((last, running, paused))
        self.wake(timerValues.getCurrentProcessingTimeInMs() + self.limit)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, running, paused = self.state.get()
        self.state.clear()
        if running and not paused:
            yield pd.DataFrame({self.key: [key[0]], "us": [last]})


def _run(events: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    needs_timers(events.sparkSession)
    return events.groupBy(key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime")


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval) / pd.Timedelta("1us"))


def _millis(interval: str) -> int:
    return _micros(interval) // 1000


def settle_stream(events: DataFrame, gap: str, grace: str, quiet: str | None = None, key: str = "path") -> DataFrame:
    """One row per burst of events (``key``, op, ts, seq) at most ``gap`` apart: key, op
    (of the last event), first_ts, last_ts, n.

    A burst is settled when a later one of its key has arrived, or when nothing of its key
    has arrived for ``quiet`` (by default the gap); one that ends in a rename waits for ``grace``
    (T5), so what comes back in time is one burst with it. An event of a burst that is
    settled already starts another one. Events without a time are left out. The state is kept
    by bucket of keys, not by key.
    """
    width = _micros(gap)
    timed = events.where("ts is not null").select(key, "op", "seq", F.unix_micros("ts").alias("us"))
    timed = timed.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    processor = _Bursts(width, width // 1000 if quiet is None else _millis(quiet), _millis(grace), key)
    out = _run(timed, "_bucket", processor, f"{key} string, op string, first_us long, last_us long, n long")
    return out.select(key, "op", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "n")


def renamed_stream(events: DataFrame, grace: str, wait: str | None = None) -> DataFrame:
    """T5: path and renamed_at of renames (events path, op in rename / create / write, ts) that
    no presence event within ``grace`` after them has answered when ``wait`` (by default the
    grace) has gone by since they arrived."""
    width = _micros(grace)
    timed = events.where("ts is not null").select("path", "op", F.unix_micros("ts").alias("us"))
    out = _run(timed, "path", _Renames(width, width // 1000 if wait is None else _millis(wait)), "path string, us long")
    return out.select("path", F.timestamp_micros("us").alias("renamed_at"))


def first_stream(events: DataFrame, quiet: str, key: str = "target") -> DataFrame:
    """T4: the first of the events of a key, at once; ones that arrive within ``quiet`` after
    it are left out, however their times are."""
    # rows reach Python as named tuples, which know no leading underscores
    plain = events.select(F.col(key).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(events.columns)))
    out = _run(plain, "k", _First(_millis(quiet)), plain.schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(events.columns)))


def stall_stream(events: DataFrame, limit: str, key: str = "root") -> DataFrame:
    """Key and last_progress_at when no event (key, ts, running, paused) of a key that runs
    unpaused has arrived for ``limit``; once for each such silence, also if all keys are silent."""
    timed = events.where("ts is not null").select(key, F.unix_micros("ts").alias("us"), "running", "paused")
    out = _run(timed, key, _Stalls(_millis(limit), key), f"{key} string, us long")
    return out.select(key, F.timestamp_micros("us").alias("last_progress_at"))
