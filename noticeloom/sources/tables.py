"""Table access and pinned clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clock of queries over events and of queries over orders, in UTC.
EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-07-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
