"""What the corpus operators share: work tables, Arrow-batched column maps, joins with hot keys, label sampling."""

from __future__ import annotations

import bisect
import importlib.util
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from noticeloom.sources.work import shared_folder, write_settings, written  # noqa: F401

#: Bytes of a batch, about, that a Python function gets as lists at a time. Spark itself bounds the Arrow
#: batches that it sends by bytes.
SLICE_BYTES = 4 << 20


def discard(table: DataFrame) -> None:
    """Frees the files of a table from written() that nothing will read any more."""
    for folder in {name.rsplit("/", 1)[0].split("/order=")[0] for name in table.inputFiles()}:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has such columns, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, for the functions that run there."""
    package = __package__.partition(".")[0]
    if any(f"{package}-" in name for name in spark.sparkContext.listFiles):
        return
    root = Path(importlib.util.find_spec(package).origin).parent
    target = Path(tempfile.mkdtemp(prefix=f"{package}-")) / f"{package}-code.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


class Cover:
    """The stretches that spans (start, end, ...), sorted by start, cover; asked in logarithmic time."""

    def __init__(self, spans: list[tuple]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, *_ in spans:
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        """Whether any of them overlaps this stretch."""
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES, by the mean size of its rows."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Maps all columns of df batch by batch; make() runs once in each task and gives a function from
    the input columns, as lists, to the output columns, as lists of one length."""
    ship(df.sparkSession)
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for part in (part for batch in batches for part in slices(batch)):
            out = fn(*(column.to_pylist() for column in part.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds)], schema=kinds)

    return df.mapInArrow(run, schema)


def join_skewed(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000, how: str = "inner") -> DataFrame:
    """rows joined, inner or left, with groups, which has a key once and in `size` how many rows have it: groups of over
    one part in `share` of all their rows, fewer than `share` in number, are broadcast, the others shuffled."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * share > total
    hot = F.broadcast(groups.where(large))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(~large), key, how)
    return rows.join(hot, key).unionByName(rest)


def fold(column: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; a null id is in fold 0 of its own text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """(text, label) of at most bound training rows, the same rows at every run: ids outside fold
    `held`, lowest hash first. The id list is broadcast; its bound is `bound`. Labels other than 0 and 1, null ids and ids
    without a document count for nothing; of a document's repeated labels the larger counts; null texts are empty, repeated
    documents each count, other columns aren't read, and empty tables give no rows."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label")
