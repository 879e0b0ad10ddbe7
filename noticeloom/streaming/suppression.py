"""Repeated events held back, measured from the last one that was let through, and a set of seen keys."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType())])
_STATE = T.StructType([T.StructField("last", T.TimestampType())])


def _keyed(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.select(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("key"), F.col("ts").cast("timestamp").alias("ts"))


def let_through_stream(events: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """A stream of (key, ts): the events (ts, keys) at least so many minutes after the last one of their key
    that was let through. State is one timestamp for each key; rows of a batch are taken in order of time,
    and rows older than the last one let through are held back."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        kept = []
        for ts in sorted(t for batch in batches for t in batch["ts"]):
            if last is None or ts - last >= timedelta(minutes=minutes):
                kept.append(ts)
                last = ts
        if last is not None:
            state.update((last.to_pydatetime(),))
        if kept:
            yield pd.DataFrame({"key": key[0], "ts": kept})

    return _keyed(events, keys).groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def let_through(events: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """The same over a whole table, in batches of rows sorted by key and time. All that is kept from one batch to the
    next is the key and the last time that was let through, so a key may have any number of rows."""
    gap = minutes * 60_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            codes = batch["key"].dictionary_encode()
            code, names, t = codes.indices.to_numpy(), codes.dictionary.to_pylist(), batch["t"].to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1), len(code)]
            kept: list[int] = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = names[code[a]]
                last = last if key == last_key else None
                last_key = key
                at = a if last is None else a + int(np.searchsorted(t[a:b], last + gap))
                while at < b:  # from each time let through, straight to the next
                    kept.append(at)
                    last = int(t[at])
                    at += int(np.searchsorted(t[at:b], last + gap))
            yield batch.take(pa.array(kept, pa.int64()))

    rows = _keyed(events, keys).where("ts IS NOT NULL").select("key", F.unix_micros("ts").alias("t"))
    kept = rows.repartition("key").sortWithinPartitions("key", "t").mapInArrow(fold, "key string, t long")
    return kept.select("key", F.timestamp_micros("t").alias("ts"))


def unseen(batch: DataFrame, seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new, seen): the batch's first rows of keys not seen before, and the keys seen with it."""
    new = batch.dropDuplicates([key]).join(seen.select(key), key, "left_anti")
    return new, seen.select(key).unionByName(new.select(key))


def unseen_stream(stream: DataFrame, key: str) -> DataFrame:
    """A stream's first row of each key; the checkpoint keeps the keys, without expiry."""
    return stream.dropDuplicates([key])
