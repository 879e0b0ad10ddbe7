"""Weighted keyword rules, as data that becomes one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyword_scores(docs: DataFrame, fields: dict[str, int], rules: list[tuple[str, str]]) -> DataFrame:
    """(id, category, score): weights of the fields that contain each rule's (category, keyword), added up."""
    each = [
        F.struct(F.lit(category).alias("category"), reduce(Column.__add__, [F.when(F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(word)), w).otherwise(0) for f, w in fields.items()]).alias("points"))
        for category, word in rules
    ]
    long = docs.select("id", F.explode(F.array(*each)).alias("s")).select("id", "s.*")
    return long.groupBy("id", "category").agg(F.sum("points").alias("score"))


def classify(scores: DataFrame, least: int = 3, second_least: int = 5, second_share: float = 0.65, near: int = 2) -> DataFrame:
    """(id, category, rank, score, ambiguous, confidence): a document's categories: the best with at least
    `least` points, and a second that is strong in itself and near the first."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "category")
    ranked = scores.where(F.col("score") >= least).select("*", F.row_number().over(w).alias("rank"), F.max("score").over(Window.partitionBy("id")).alias("top"), F.lead("score").over(w).alias("next"))
    margin = F.col("top") - F.coalesce(F.first("next").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0))
    ranked = ranked.withColumn("margin", margin).withColumn("ambiguous", margin <= near)
    raw = 0.42 + F.least(F.col("score"), F.lit(18)) / 30.0 + F.least(F.greatest(F.col("margin"), F.lit(0)), F.lit(8)) / 28.0
    capped = F.least(raw, F.when(F.col("ambiguous") & (F.col("rank") == 1), 0.58).otherwise(0.95))
    keep = (F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("score") >= second_least) & (F.col("score") >= second_share * F.col("top")))
    return ranked.where(keep).select("id", "category", "rank", "score", "ambiguous", F.round(F.greatest(F.lit(0.25), capped), 2).alias("confidence"))
