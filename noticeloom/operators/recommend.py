"""Ranking notices for a person: follows, regions, interests, audience, urgency and vector likeness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions import vectors


@dataclass(frozen=True)
class Weights:
    """Points of each signal. The defaults are the current scheme; FIRST and AUDIENCE are earlier ones."""

    follow: float = 45.0
    region: float = 40.0
    nationwide: float = 10.0
    category: float = 30.0
    audience: float = 20.0
    other_audience: float = -15.0
    urgent: float = 10.0
    likeness: float = 30.0


FIRST = Weights(region=50.0, urgent=20.0, audience=0.0, other_audience=0.0, likeness=0.0)
AUDIENCE = Weights(follow=0.0, likeness=0.0, urgent=10.0, audience=20.0)

#: The age that stands for an age band.
BAND_AGES = {"teen": 16, "20s": 25, "30s": 35, "40s": 45, "50s": 55, "60_plus": 65}


@dataclass(frozen=True)
class Person:
    region: int | None
    age: int | None
    gender: str | None
    categories: tuple = ()
    follows: tuple = ()


def interest_vector(favorites: DataFrame, views: DataFrame, vectors_of: DataFrame, recent: int = 50) -> DataFrame:
    """(user_id, mean): of favourites, counting twice, and of the last `recent` distinct items viewed."""
    last = views.groupBy("user_id", "item").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item")
    seen = last.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent).select("user_id", "item", F.lit(1.0).alias("weight"))
    signals = favorites.select("user_id", "item", F.lit(2.0).alias("weight")).unionByName(seen)
    return vectors.mean_vector(signals.join(vectors_of, "item"), ["user_id"], "embedding", "weight")


def audience_fits(person: Person) -> Column:
    """Whether an audience row (min_age, max_age, gender) takes the person in; unknowns are let pass."""
    age = F.lit(person.age).cast("int")
    aged = (F.col("min_age").isNull() | age.isNull() | (age >= F.col("min_age"))) & (F.col("max_age").isNull() | age.isNull() | (age <= F.col("max_age")))
    anyone = F.lit(person.gender is None or person.gender == "prefer_not_to_say")
    return aged & (F.col("gender").isNull() | (F.col("gender") == "None") | anyone | (F.col("gender") == F.lit(person.gender)))


def recommend(notices: DataFrame, regions: DataFrame, categories: DataFrame, audiences: DataFrame, person: Person, now: Column, weights: Weights = Weights(), likes: Column | None = None) -> DataFrame:
    """Open notices (id, institutions array, end_at, embedding) with (score, similarity).

    Each bridge is brought down to a row for each notice before it is joined, so that rows don't multiply:
    regions (id, region, nationwide), categories (id, category), audiences (id, min_age, max_age, gender).
    """
    w, none = weights, F.lit(0.0)
    near = regions.groupBy("id").agg(F.max(F.when(F.col("region") == person.region, w.region).when(F.col("nationwide"), w.nationwide).otherwise(0.0)).alias("_region"))
    liked = categories.groupBy("id").agg(F.max(F.when(F.col("category").isin(*person.categories), w.category).otherwise(0.0)).alias("_category"))
    aimed = audiences.groupBy("id").agg(F.max(F.when(audience_fits(person), w.audience).otherwise(w.other_audience)).alias("_audience"))
    live = notices.where(F.col("end_at").isNull() | (F.col("end_at") > now))
    alike = vectors.similarity(F.col("embedding"), likes) if likes is not None else F.lit(None).cast("double")
    follow = F.when(F.exists("institutions", lambda i: i.isin(*person.follows)), w.follow).otherwise(0.0) if person.follows else none
    soon = F.when((F.col("end_at") > now) & (F.col("end_at") - now < F.expr("INTERVAL 7 DAYS")), w.urgent).otherwise(0.0)
    scored = live.join(near, "id", "left").join(liked, "id", "left").join(aimed, "id", "left").withColumn("similarity", alike)
    parts = [F.coalesce(F.col(c), none) for c in ("_region", "_category", "_audience")]
    return scored.withColumn("score", follow + parts[0] + parts[1] + parts[2] + soon + F.coalesce(F.col("similarity"), none) * w.likeness).drop("_region", "_category", "_audience")
