"""Vectors held as arrays of numbers: built-in array functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Dimensions whose sums are held together.
BLOCK = 32


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of no length or of unequal dimensions."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / F.nullif(size, F.lit(0.0)))


def similarity(a: Column, b: Column) -> Column:
    """One less the cosine distance, but at least 0."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def is_valid(v: Column, dimensions: int | None = None) -> Column:
    """A vector without null, infinite or undefined entries, of the given number of dimensions."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & (F.lit(dimensions is None) | (F.size(v) == (dimensions or 0))), F.lit(False))


def mean_vector(rows: DataFrame, keys: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """(keys, mean array<double>): the weighted mean of the vectors of each group, dimension by dimension."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # blocks of dimensions, each one row of sums: less to hold for a group than a row for each dimension
    starts = F.sequence(F.lit(0), F.size(vector) - 1, F.lit(BLOCK))
    parts = rows.where(F.size(vector) > 0).select(*keys, w.alias("_w"), F.col(vector).alias("_v"), F.explode(starts).alias("_b"))
    parts = parts.select(*keys, "_w", "_b", F.slice("_v", F.col("_b") + 1, F.lit(BLOCK)).alias("_v"))
    sums = [s for i in range(BLOCK) for s in (F.sum(F.get("_v", F.lit(i)).cast("double") * F.col("_w")).alias(f"_x{i}"), F.sum(F.when(F.size("_v") > i, F.col("_w"))).alias(f"_w{i}"), )]
    each = F.array(*[F.struct(F.col(f"_w{i}").isNotNull().alias("known"), (F.col(f"_x{i}") / F.col(f"_w{i}")).alias("m")) for i in range(BLOCK)])
    means = parts.groupBy(*keys, "_b").agg(*sums).select(*keys, "_b", F.transform(F.filter(each, lambda e: e["known"]), lambda e: e["m"]).alias("_m"))
    mean = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_m"))), lambda s: s["_m"])).alias("mean")
    return means.groupBy(*keys).agg(mean) if keys else means.agg(mean)
