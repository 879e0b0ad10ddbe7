"""Work tables in the folder that all executors share."""

from __future__ import annotations

import importlib.util
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch, about, that are Python objects at a time.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a session within one process, as in
    tests, gets a local folder; on a cluster, whose executors don't share one, this is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="noticeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/noticeloom/{uuid.uuid4().hex}"


@contextmanager
def write_settings(spark: SparkSession) -> Iterator[None]:
    """While a work table is written: shuffle files go with the job that made them, and Arrow batches are small. What
    the session had set before is set again afterwards."""
    values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """df written as a Parquet table in the shared folder, partitioned by parts, and read again: its
    lineage ends there, and the shuffle files that made it go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    with write_settings(spark):
        df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(make: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What make gives for the columns, as lists, in an array of this kind: slice by slice, by the mean size of the rows, so that
    a whole batch is never held as Python objects."""
    rows = len(columns[0])
    step = max(1, rows * SLICE_BYTES // max(1, sum(c.nbytes for c in columns)))
    parts = [pa.array(make(*(c.slice(i, step).to_pylist() for c in columns)), kind) for i in range(0, rows, step)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors, once for each application, for the functions that run there."""
    context = (spark or SparkSession.active()).sparkContext
    package = __package__.partition(".")[0]
    if any(f"{package}-" in name for name in context.listFiles):
        return
    root = Path(importlib.util.find_spec(package).origin).parent
    target = Path(tempfile.mkdtemp(prefix=f"{package}-")) / f"{package}-code.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
