"""Changing tables that are rewritten: upserts, moves, lifecycle, and what a change sets off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: str, fill_only: tuple[str, ...] = ()) -> DataFrame:
    """target with source's rows: new keys are added; of known ones, source's values win where they aren't
    null, but only fill gaps (null or blank text) in the columns fill_only. source has a key at most once."""
    t, s = target.alias("t"), source.alias("s")
    rows = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")

    def value(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}")
        if c == key or c not in fill_only:
            return F.coalesce(new, old).alias(c)
        blank = F.when(F.trim(old.cast("string")) != "", old)
        return F.coalesce(blank, new).alias(c)

    return rows.select(*[value(c) for c in target.columns])


def moved(source: DataFrame, target: DataFrame, key: str, which: Column) -> tuple[DataFrame, DataFrame]:
    """(source, target) after the rows that `which` picks have gone over; rows whose key the target has stay."""
    going = source.where(which).join(target.select(key), key, "left_anti")
    return source.join(going.select(key), key, "left_anti"), target.unionByName(going)


def closing_plan(notices: DataFrame, today: Column) -> DataFrame:
    """(id, old, new, reason): published notices whose end, in UTC days, is over."""
    over = notices.where((F.col("status") == "published") & (F.to_date("end_at") < today))
    return over.select("id", F.col("status").alias("old"), F.lit("closed").alias("new"), F.lit("expired").alias("reason"))


def publish_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after that are published now and weren't before."""
    old = before.select("id", F.col("status").alias("_old"))
    return after.join(old, "id", "left").where((F.col("status") == "published") & ~F.col("_old").eqNullSafe(F.lit("published"))).drop("_old")


def invalidated(before: DataFrame, after: DataFrame, facts: list[str]) -> DataFrame:
    """after with verified set to false where any fact changed without a fresh verification."""
    old = before.select("id", F.col("verified_at").alias("_at"), F.struct(*facts).alias("_facts"))
    rows = after.join(old, "id", "left")
    changed = F.col("_facts").isNotNull() & ~F.struct(*facts).eqNullSafe(F.col("_facts")) & F.col("_at").eqNullSafe(F.col("verified_at"))
    return rows.withColumn("verified", F.col("verified") & ~changed).drop("_at", "_facts")


def fan_out(published: DataFrame, followers: DataFrame, interested: DataFrame, neighbours: DataFrame, sent: DataFrame) -> DataFrame:
    """(id, user_id, reason): whom to tell of notices (id, author): followers of the institution, else those with
    the interest, else those of the region; not the author, and nobody twice. Each of the three has (id, user_id)."""
    ranks = [followers.select("id", "user_id", F.lit(1).alias("r")), interested.select("id", "user_id", F.lit(2).alias("r")), neighbours.select("id", "user_id", F.lit(3).alias("r"))]
    best = ranks[0].unionByName(ranks[1]).unionByName(ranks[2]).groupBy("id", "user_id").agg(F.min("r").alias("r"))
    told = best.join(published.select("id", "author"), "id").where(~F.col("user_id").eqNullSafe(F.col("author"))).join(sent, ["id", "user_id"], "left_anti")
    return told.select("id", "user_id", F.element_at(F.array(F.lit("follow"), F.lit("interest"), F.lit("region")), F.col("r")).alias("reason"))
