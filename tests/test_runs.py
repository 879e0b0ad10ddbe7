"""Streams with timers and their batch twins agree, also after a restart in between."""

import random

import pytest
from pyspark.sql import functions as F

from noticeloom.streaming import runs
from noticeloom.streaming.suppression import let_through

KIND = "key string, ts timestamp, kind string"


def _events(kinds, count=240):
    r = random.Random(len(kinds))
    out, minute = [], 0
    for _ in range(count):
        minute += r.choice([0, 1, 3, 10, 40])
        out.append((f"k{r.randrange(5)}", minute, r.choice(kinds)))
    return out + [("end", minute + 10_000, kinds[0])]


def _streamed(spark, tmp_path, rows, make):
    """Three batches; the query is stopped and started again between them."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        cut = len(rows) // 3
        for part in (rows[:cut], rows[cut:2 * cut], rows[2 * cut:]):
            frame = spark.createDataFrame([(k, m, x) for k, m, x in part], "key string, m long, kind string")
            frame.select("key", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            events = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
            query = make(events).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _batch(spark, rows):
    return spark.createDataFrame(rows, "key string, m long, kind string").select("key", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "kind")


@pytest.mark.parametrize("name", ["cooldown", "stale", "streak"])
def test_stream_and_batch_agree(spark, tmp_path, name):
    rows = _events({"cooldown": ["alert"], "stale": ["start", "end"], "streak": ["error", "error", "success"]}[name])
    batch = _batch(spark, rows)
    stream, twin = {
        "cooldown": (lambda e: runs.cooldown_stream(e, 60), let_through(batch, ["key"], 60)), "stale": (lambda e: runs.stale_stream(e, 90), runs.stale_runs(batch, 90)),
        "streak": (lambda e: runs.streak_stream(e, 3, 120), runs.streaks(batch, 3, 120)),
    }[name]
    want = sorted(map(tuple, twin.collect()))
    got = _streamed(spark, tmp_path, rows, stream)
    assert got == want and len(want) > 5
