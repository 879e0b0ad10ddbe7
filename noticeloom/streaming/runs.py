"""Runs of sources and their alerts as streams with timers.

Each operator keeps one small state for a key, registers event-time timers for what must happen when nothing comes, and
drops the state when it has no more use. The batch twins say the same over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from noticeloom.sources.work import ship

_MINUTE = 60_000


def _rows(batches: Iterator[pd.DataFrame]) -> list[tuple[int, str]]:
    """(milliseconds, kind) of a batch, in order of time; at the same time ends come before starts."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return []
    b = pd.concat(frames)
    ms = b["ts"].astype("datetime64[ms]").astype("int64")
    return sorted(zip(ms.tolist(), b["kind"].tolist()), key=lambda r: (r[0], r[1] == "start", r[1]))


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Cooldown(StatefulProcessor):
    """(key, ts): events at least so many minutes after the last one let through. A timer drops the state once it can hold
    back nothing more."""

    def __init__(self, minutes: int):
        self.gap = minutes * _MINUTE

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        kept, timer = [], last
        for ms, _ in _rows(rows):
            if last is None or ms - last >= self.gap:
                kept.append(_time(ms))
                last = ms
        if kept:
            if timer is not None:
                self.handle.deleteTimer(timer + self.gap)
            self.handle.registerTimer(last + self.gap)
            self.last.update((last,))
            yield pd.DataFrame({"key": [key[0]] * len(kept), "ts": kept})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class StaleRuns(StatefulProcessor):
    """(key, ts): the starts after which no end came for so many minutes, told when that time is up. A second start while a run is
    open takes its place."""

    def __init__(self, minutes: int):
        self.limit = minutes * _MINUTE

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        began = self.open.get()[0] if self.open.exists() else None
        timer, stale = began, []
        for ms, kind in _rows(rows):
            if began is not None and ms - began >= self.limit and kind in ("start", "end"):
                stale.append(_time(began))  # its timer would have gone off before this
                began = None
            if kind == "start":
                began = ms
            elif kind == "end":
                began = None
        if began != timer:
            if timer is not None:
                self.handle.deleteTimer(timer + self.limit)
            if began is None:
                self.open.clear()
            else:
                self.open.update((began,))
                self.handle.registerTimer(began + self.limit)
        if stale:
            yield pd.DataFrame({"key": [key[0]] * len(stale), "ts": stale})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        began = self.open.get()[0] if self.open.exists() else None
        if began is not None and expiredTimerInfo.getExpiryTimeInMs() >= began + self.limit:
            self.open.clear()
            yield pd.DataFrame({"key": [key[0]], "ts": [_time(began)]})

    def close(self) -> None:
        pass


class Streaks(StatefulProcessor):
    """(key, ts, errors, status): after each run, how many in a row have failed, and the status: error from `most` on. A key that
    doesn't run for so many minutes is forgotten."""

    def __init__(self, most: int, minutes: int):
        self.most, self.idle = most, minutes * _MINUTE

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("streak", "errors long, ms long")

    def handleInputRows(self, key, rows, timerValues):
        errors, last = self.state.get() if self.state.exists() else (0, None)
        before, out = last, []
        for ms, kind in _rows(rows):
            if last is not None and ms - last >= self.idle:
                errors = 0
            errors = errors + 1 if kind == "error" else 0
            last = ms if last is None else max(last, ms)
            out.append((key[0], _time(ms), errors, "error" if errors >= self.most else "active"))
        if out:
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(last + self.idle)
            self.state.update((errors, last))
            yield pd.DataFrame(out, columns=["key", "ts", "errors", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    """events: a stream (key, ts, kind); rows later than the delay are dropped. Needs RocksDB state."""
    ship(events.sparkSession)
    keyed = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "kind").withWatermark("ts", delay)
    return keyed.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def cooldown_stream(events: DataFrame, minutes: int, delay: str = "0 seconds") -> DataFrame:
    return _stateful(events, Cooldown(minutes), "key string, ts timestamp", delay)


def stale_stream(events: DataFrame, minutes: int, delay: str = "0 seconds") -> DataFrame:
    return _stateful(events, StaleRuns(minutes), "key string, ts timestamp", delay)


def streak_stream(events: DataFrame, most: int, minutes: int, delay: str = "0 seconds") -> DataFrame:
    return _stateful(events, Streaks(most, minutes), "key string, ts timestamp, errors long, status string", delay)


def stale_runs(events: DataFrame, minutes: int) -> DataFrame:
    """(key, ts): the starts of events (key, ts, kind) after which, by the time of the last event of all, so many minutes went by
    without an end or a new start of their key."""
    now = events.agg(F.max("ts").alias("now"))
    order = Window.partitionBy("key").orderBy("ts", F.col("kind") == "start", "kind")
    next_at = events.where("kind IN ('start', 'end')").withColumn("next", F.lead("ts").over(order))
    passed = lambda to: F.timestamp_diff("MILLISECOND", F.col("ts"), to) >= minutes * _MINUTE
    open_to = F.coalesce("next", "now")
    return next_at.crossJoin(F.broadcast(now)).where((F.col("kind") == "start") & passed(open_to)).select("key", "ts")


def streaks(events: DataFrame, most: int, minutes: int) -> DataFrame:
    """(key, ts, errors, status) of events (key, ts, kind): errors in a row up to each run. A pause of so many minutes begins anew."""
    order = Window.partitionBy("key").orderBy("ts", F.col("kind") == "start", "kind")
    pause = F.coalesce(F.timestamp_diff("MILLISECOND", F.lag("ts").over(order), F.col("ts")) >= minutes * _MINUTE, F.lit(False))
    failed = F.col("kind") == "error"
    islands = events.withColumn("pause", pause).withColumn("part", F.sum(F.when(F.col("pause") | ~failed, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    errors = F.sum(failed.cast("long")).over(Window.partitionBy("key", "part").orderBy("ts", failed, "kind").rowsBetween(Window.unboundedPreceding, 0))
    return islands.select("key", "ts", errors.alias("errors")).withColumn("status", F.when(F.col("errors") >= most, "error").otherwise("active"))
