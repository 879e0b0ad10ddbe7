"""The way of collected posts into the tables: excluded, rejected, merged with what is stored, kept for review, or published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.operators.exclusions import exclusion
from noticeloom.operators.quality_gate import gate
from noticeloom.sources.work import written


def upload_plan(posts: DataFrame, stored: DataFrame, year: Column, date_codes: Column | None = None) -> DataFrame:
    """(id, route, reason) for each of posts, as the gate takes them: 'excluded' by a rule; else 'rejected' by the gate, with its
    first issue that rejects; else 'updated' where stored (source_url) has the source; else 'candidate' where the gate asks
    for review or the post is only text, with its first issue; else 'poster'. Posts that are excluded are no one's
    duplicates. Reasons are '' where there is none; null sources are never stored."""
    ruled = written(posts.withColumn("_rule", exclusion(F.col("title"), F.col("summary"), F.col("source_url"), year)), "ruled")
    out = ruled.where(F.col("_rule").isNotNull()).select("id", F.lit("excluded").alias("route"), F.col("_rule").alias("reason"))
    judged = gate(ruled.where(F.col("_rule").isNull()).drop("_rule"), date_codes)
    known = stored.select(F.col("source_url").alias("_known")).where("_known <> ''").distinct()
    judged = judged.join(known, F.col("source_url") == F.col("_known"), "left")
    first = lambda issues: F.coalesce(F.get(issues, 0)["code"], F.lit(""))
    route = (
        F.when(F.col("decision") == "reject", "rejected").when(F.col("_known").isNotNull(), "updated").when((F.col("decision") == "review") | F.coalesce("text_only", F.lit(False)), "candidate").otherwise("poster")
    )
    reason = F.when(route == "rejected", first(F.filter("issues", lambda i: i["decision"] == "reject"))).when(route == "candidate", first(F.col("issues"))).otherwise("")
    return out.unionByName(judged.select("id", route.alias("route"), reason.alias("reason")))
