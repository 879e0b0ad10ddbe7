"""Files of reports and exchanges: CSV as spreadsheets write it, JSON documents, feeds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.operators.intake import csv_line


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes and line breaks in fields; missing values are ''."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})
    return rows.na.fill("").where(F.concat(*[F.trim(F.col(f"`{c}`")) for c in rows.columns]) != "")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header and fields quoted only where they must be."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV as spreadsheets read it: each file begins with a byte order mark and the header, lines end with CRLF, and fields are
    quoted only where they hold quotes, commas or line breaks."""
    head = "\ufeff" + ",".join(rows.columns)

    def with_head(batches):
        first = next(batches, None)
        kind = pa.schema([("value", pa.string())]) if first is None else first.schema
        yield pa.RecordBatch.from_arrays([pa.array([head], kind.field(0).type)], schema=kind)
        if first is not None:
            yield first
        yield from batches

    lines = rows.select(csv_line(*[F.col(f"`{c}`") for c in rows.columns]).alias("value"))
    lines.mapInArrow(with_head, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_results(rows: DataFrame, path: str, by: str) -> None:
    """One JSON document, an array of records, for each value of a column; a value's records must fit into one row."""
    record = F.to_json(F.struct(*[c for c in rows.columns if c != by]))
    each = rows.groupBy(by).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(record)), ",\n"), F.lit("]")).alias("value"))
    each.write.mode("overwrite").partitionBy(by).text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document of an array of records."""
    return spark.read.option("multiLine", True).json(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, description, pubDate) of the items of an RSS file."""
    kind = "title string, link string, description string, pubDate string"
    return spark.read.option("rowTag", "item").schema(kind).xml(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
