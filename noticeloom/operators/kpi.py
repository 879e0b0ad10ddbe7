"""Measures of collection runs, coverage and accuracy, with their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.operators.ranks import nearest_ranks


def percent(part: Column, whole: Column, digits: int = 1, empty: float | None = None) -> Column:
    """part of whole in percent; `empty` where there is no whole."""
    value = F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def run_kpis(runs: DataFrame) -> DataFrame:
    """One row over (status, duration, checked, valid): partial runs count as successful here."""
    good = F.col("status").isin("success", "partial")
    sums = runs.agg(
        F.count("*").alias("runs"), percent(F.count_if(good), F.count("*")).alias("success_percent"), F.round(F.avg("duration"), 2).alias("mean_duration"),
        F.sum("checked").alias("checked"), F.sum("valid").alias("valid"), F.round(F.sum("duration") / F.nullif(F.sum("checked"), F.lit(0)), 2).alias("per_item"),
    )
    return sums.join(F.broadcast(nearest_ranks(runs, [], "duration", {"p50_duration": 0.5, "p95_duration": 0.95})), how="left")


def run_status(failed: Column, valid: Column, checked: Column) -> Column:
    return F.when((failed > 0) & (valid == 0), "error").when(failed > 0, "partial").when(checked == 0, "empty").otherwise("success")


def diagnosis(status: Column, checked: Column, valid: Column, missing: Column) -> Column:
    """struct(key, severity) of a run's first finding; null for a healthy run."""
    rate, lost = percent(valid, checked, 2, 0.0), percent(missing, checked, 2, 0.0)
    found = lambda key, severity: F.struct(F.lit(key).alias("key"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    return (
        F.when(status == "error", found("runtime_error", "critical")).when(status == "partial", found("partial_failure", "warning")).when(status == "empty", found("empty_result", "warning"))
        .when((checked >= 5) & (rate < 40), found("low_valid_rate", F.when(rate < 20, "critical").otherwise("warning")))
        .when((checked >= 5) & (lost >= 30), found("missing_required_fields", "warning"))
    )


def health_flags(sources: DataFrame, now: Column) -> DataFrame:
    """sources (status, method, interval_minutes, collected_at, success_at, errors, run_status, checked, valid_rate,
    missing_rate) with due, stale, errored, low_quality, missing_required and needs_attention."""
    minutes = F.greatest(F.coalesce("interval_minutes", F.lit(1440)), F.lit(60))
    since = lambda c: (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(c).cast("timestamp"))) / 60.0
    auto = (F.col("status") == "active") & (F.col("method") != "manual")
    errored = F.col("status").isin("error", "blocked") | (F.coalesce("errors", F.lit(0)) > 0) | F.coalesce(F.col("run_status").isin("error", "partial"), F.lit(False))
    enough = F.coalesce("checked", F.lit(0)) >= 5
    out = sources.select(
        "*", (auto & (F.col("collected_at").isNull() | (since("collected_at") >= minutes))).alias("due"),
        (auto & (F.col("success_at").isNull() | (since("success_at") >= F.greatest(2 * minutes, F.lit(48 * 60))))).alias("stale"), errored.alias("errored"),
        (enough & (F.coalesce("valid_rate", F.lit(0.0)) < 40)).alias("low_quality"), (enough & (F.coalesce("missing_rate", F.lit(0.0)) >= 30)).alias("missing_required"),
    )
    return out.withColumn("needs_attention", F.col("errored") | F.col("stale") | F.col("low_quality") | F.col("missing_required"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """thresholds (metric, comparison 'min' or 'max', threshold) against metrics (metric, actual):
    (metric, actual, comparison, threshold, passed, reason). A missing metric is a violation."""
    rows = thresholds.join(metrics, "metric", "left")
    within = F.when(F.col("comparison") == "min", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    reason = F.when(F.col("actual").isNull(), "missing").when(within, None).when(F.col("comparison") == "min", "below").otherwise("above")
    return rows.select("metric", "actual", "comparison", "threshold", F.coalesce(within, F.lit(False)).alias("passed"), reason.alias("reason"))


def accuracy(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, labeled, correct, accuracy) of 0/1 columns, blanks left out, and their macro mean as 'macro'."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("int").alias("v")) for m in metrics])).alias("s")).select("s.*")
    each = long.groupBy("metric").agg(F.count("v").alias("labeled"), F.coalesce(F.sum("v"), F.lit(0)).alias("correct")).withColumn("accuracy", percent(F.col("correct"), F.col("labeled")))
    macro = each.agg(F.lit("macro").alias("metric"), F.sum("labeled").alias("labeled"), F.sum("correct").alias("correct"), F.round(F.avg(100.0 * F.col("correct") / F.nullif(F.col("labeled"), F.lit(0))), 1).alias("accuracy"))
    return each.unionByName(macro)


def merged_counts(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, key, n): the maps of a group added up key by key."""
    return rows.select(*keys, F.explode(column).alias("key", "v")).groupBy(*keys, "key").agg(F.sum("v").alias("n"))


def error_streaks(runs: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """runs with `streak`: failures in a row up to and with each run, 0 at a success."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = runs.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    return marked.withColumn("streak", F.sum("_f").over(Window.partitionBy(key, "_island").orderBy(*order))).drop("_f", "_island")
