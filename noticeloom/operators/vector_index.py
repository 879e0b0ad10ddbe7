"""Nearest vectors over an index of cells.

Cells are fitted by k-means on a bounded sample; every vector lies in the cell of its nearest centre. A query looks into the cells
whose centres are nearest to it. How many, follows from the recall that queries of a bounded sample reach against the
exact scan of all vectors. Queries and vectors are compared by products of matrices, tile by tile: no pair becomes a row
but a tile's nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions.vectors import dot, is_valid
from noticeloom.sources.work import ship, written

#: Vectors that the cells are fitted on and queries that the number of probes is fitted on, at most; cells, at most; the least recall.
SAMPLE, TRIED, CELLS, RECALL = 20_000, 64, 256, 0.95
#: Vectors whose distances from all centres are held at a time, and vectors and queries that are compared in one task; queries of one product.
TILE, STRIP = 4096, 256
#: More than products of matrices of units differ from sums taken one by one.
MARGIN = 1e-9


@dataclass
class Index:
    """cells: centres (cell, centre), at most CELLS rows; rows: (id, unit, cell) of every vector; probes: cells to look into."""

    cells: DataFrame
    rows: DataFrame
    probes: int


def units(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(id, unit) of vectors (id, vector): those of full dimension, finite and of some length, at length one."""
    size = F.sqrt(dot(F.col("vector"), F.col("vector")))
    known = vectors.where(is_valid(F.col("vector"), dimensions)).withColumn("_size", size).where("_size > 0")
    return known.select("id", F.transform("vector", lambda x: x / F.col("_size")).alias("unit"))


def exact(queries: DataFrame, rows: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """(query, id, similarity, rank): of each query (query, unit) the `most` nearest of rows (id, unit) at a similarity of at
    least `least`, itself left out; ties go to the smaller id. Queries are a stated set, sent to all rows."""
    return _best(queries.withColumn("cell", F.lit(0)), rows.select("id", "unit").withColumn("cell", F.lit(0)), most, least)


def _dealt(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (cell, ...) with each row's tile, and (cell, tiles) of how many tiles each cell has."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias(f"{name}s"))
    tile = F.pmod(F.xxhash64("query" if "query" in rows.columns else "id"), F.col(f"{name}s")).cast("int")
    return rows.join(sizes, "cell").withColumn(name, tile).drop(f"{name}s"), sizes


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, most: int, least: float) -> pd.DataFrame:
    """(query, id, similarity) of queries (query, of) and rows (id, unit): of each query the `most` nearest at least, and few
    more. Products of matrices find them; their similarities are sums in the order of the dimensions, so that they don't
    depend on the tile."""
    q, r, found = queries["query"].to_numpy(), rows["id"].to_numpy(), []
    left, right = np.stack(queries["of"].to_numpy()), np.stack(rows["unit"].to_numpy())
    for start in range(0, len(q), STRIP):
        product = left[start:start + STRIP] @ right.T
        product[q[start:start + STRIP, None] == r] = -np.inf
        bound = np.partition(product, len(r) - most, axis=1)[:, len(r) - most] if most < len(r) else np.full(len(product), -np.inf)
        x, y = np.nonzero((product >= np.maximum(bound, least)[:, None] - MARGIN) & (product > -np.inf))
        exactly = np.cumsum(left[start + x] * right[y], axis=1)[:, -1] if len(x) else np.zeros(0)
        found.append(pd.DataFrame({"query": q[start + x], "id": r[y], "similarity": exactly}))
    return pd.concat(found)


def _best(queries: DataFrame, rows: DataFrame, most: int, least: float) -> DataFrame:
    """(query, id, similarity, rank) of queries (query, unit, cell) and rows (id, unit, cell) of the same cell. Rows and queries of a cell
    are cut into tiles, and each two tiles are compared in a task of their own."""
    ship(rows.sparkSession)
    kinds = queries.schema["query"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    wanted, lefts = _dealt(queries.select("query", F.col("unit").alias("of"), F.col("cell").alias("cell")).where("query IS NOT NULL"), "left")
    held, rights = _dealt(rows.select(F.col("id").alias("id"), F.col("unit").alias("unit"), F.col("cell").alias("cell")).where("id IS NOT NULL"), "right")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, tasks = ("cell", "left", "right"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = wanted.join(rights, "cell").select("query", "of", "cell", "left", every("rights").alias("right")).repartition(tasks, *keys)
    held = held.join(lefts, "cell").select("id", "unit", "cell", every("lefts").alias("left"), "right").repartition(tasks, *keys)

    def compare(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if most < 1 or not len(some) or not len(others):
            return pd.DataFrame({"query": some["query"][:0], "id": others["id"][:0], "similarity": []})
        return _nearest(some, others, most, least)

    pairs = wanted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(compare, f"query {kinds[0]}, id {kinds[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return pairs.where(F.col("similarity") >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def _with_cells(rows: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """rows (unit, ...) with the column cells, array<int>: the cells nearest to unit, the nearest first, by products of matrices."""
    known = cells.orderBy("cell").collect()  # at most CELLS centres
    if not known or most < 1:
        return rows.withColumn("cells", F.array().cast("array<int>"))
    numbers, centres = np.array([c["cell"] for c in known], np.int32), np.array([c["centre"] for c in known], float)
    sizes = (centres**2).sum(axis=1)
    ship()

    @F.arrow_udf("array<int>")
    def nearest(units: pa.Array) -> pa.Array:
        vectors = units.flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
        found = [np.zeros(0, np.int32)]
        for a in range(0, len(vectors), TILE):
            distance = sizes - 2 * (vectors[a:a + TILE] @ centres.T)
            found.append(numbers[np.argsort(distance, axis=1, kind="stable")[:, :most]].ravel())
        each = min(most, len(numbers))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * each, pa.int32()), pa.array(np.concatenate(found)))

    return rows.withColumn("cells", nearest("unit"))


def build(vectors: DataFrame, dimensions: int, most: int = 10, recall: float = RECALL, cells: int | None = None, seed: int = 7) -> Index:
    """The index of vectors (id, vector). About the square root of the sample's size is the number of cells, where none is given.
    Probes are doubled until the tried queries find `recall` of their `most` nearest, or all cells are looked into.

    Null, zero and otherwise dimensioned vectors are left out, repeated ids are kept, an empty table gives an empty index."""
    spark = vectors.sparkSession
    rows = written(units(vectors, dimensions), "units")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    known = sample.count()
    if not known:
        return Index(spark.createDataFrame([], "cell int, centre array<double>"), rows.withColumn("cell", F.lit(0)), 0)
    wanted = max(1, min(CELLS, known, cells or round(known**0.5)))
    model = KMeans(k=wanted, seed=seed, maxIter=15, featuresCol="v").fit(sample.select(array_to_vector("unit").alias("v"))) if wanted > 1 else None
    centres = [list(map(float, c)) for c in model.clusterCenters()] if model else [[0.0] * dimensions]
    table = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    placed = written(_with_cells(rows, table, 1).select("id", "unit", F.get("cells", 0).alias("cell")), "cells")
    tried = written(rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(TRIED).select(F.col("id").alias("query"), "unit"), "tried")
    # a vector among the nearest of all is among those of the cells looked into, if its own is one of them: one scan tells for every number of probes
    truth = exact(tried, rows, most).select("query", "id").join(placed.select("id", "cell"), "id").join(_with_cells(tried, table, wanted).select("query", "cells"), "query")
    found = {r["at"]: r["n"] for r in truth.groupBy(F.array_position("cells", F.col("cell")).alias("at")).agg(F.count("*").alias("n")).collect()}  # at most CELLS
    total, probes = sum(found.values()), 1
    while probes < wanted and sum(n for at, n in found.items() if at <= probes) < recall * total:
        probes *= 2
    return Index(table, placed, min(probes, wanted))


def search(queries: DataFrame, index: Index, most: int, least: float = 0.0) -> DataFrame:
    """(query, id, similarity, rank) as exact() gives them, of the vectors in the cells nearest to each query (query, unit)."""
    looked = _with_cells(queries, index.cells, index.probes).select("query", "unit", F.explode("cells").alias("cell"))
    return _best(looked, index.rows, most, least)
