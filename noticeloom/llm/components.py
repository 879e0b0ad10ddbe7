"""Connected components by alternating large and small stars, on tables that the shared folder keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _heads(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours in pairs (u, v)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b): component is the least id that paths reach.

    Null ends and loops are dropped, repeated edges count once, no edges give no rows. Each round halves the
    length of paths at least, and no round gathers a node's neighbours: their minimum is aggregated
    where they lie and joined back, so that a node may have any number of them.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = written(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_heads(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        heads = _heads(large)
        small = large.join(heads, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(heads.select("u", F.col("m").alias("v")))
        small = written(small.where("u <> v").distinct(), "small")
        discard(now)
        discard(large)
        now = small
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            break
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
