"""Collection measures: a supplier is a source, an order line a run, labels a golden set."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.operators import kpi as K
from noticeloom.operators.ranks import nearest_ranks
from noticeloom.sources.tables import ORDERS_NOW, table

def _runs(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS source", "l_shipdate AS ran_at", "l_orderkey", "l_linenumber", "l_extendedprice AS duration", "CAST(l_quantity AS INT) AS checked",
        "greatest(0, CAST(floor(l_quantity * (1 - 7 * l_discount)) AS INT)) AS valid", "CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey % 3 AS INT) ELSE 0 END AS failed", "CAST(floor(l_quantity * l_tax * 6) AS INT) AS missing")
    return r.withColumn("status", K.run_status(F.col("failed"), F.col("valid"), F.col("checked")))


_R = """(SELECT *, CASE WHEN failed > 0 AND valid = 0 THEN 'error' WHEN failed > 0 THEN 'partial' WHEN checked = 0 THEN 'empty' ELSE 'success' END AS status FROM (SELECT l_suppkey AS source, l_shipdate AS ran_at, l_orderkey, l_linenumber, l_extendedprice AS duration, CAST(l_quantity AS INT) AS checked,
  greatest(0, CAST(floor(l_quantity * (1 - 7 * l_discount)) AS INT)) AS valid, CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey % 3 AS INT) ELSE 0 END AS failed, CAST(floor(l_quantity * l_tax * 6) AS INT) AS missing FROM lineitem))"""


def a14_percentiles(spark, sf_dir):
    return nearest_ranks(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def a15_means(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("mean"), K.percent(F.count_if(F.col("value") > 50), F.count("*")).alias("over_50"))


def a16_run_kpis(spark, sf_dir):
    return K.run_kpis(_runs(spark, sf_dir))


def a17_coverage(spark, sf_dir):
    d, l, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct(), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    rows = d.join(l.withColumn("_l", F.lit(1)), "doc_id", "left").join(e.withColumn("_e", F.lit(1)), "doc_id", "left")
    return rows.agg(F.count("*").alias("published"), F.count("_e").alias("embedded"), F.count("_l").alias("verified"), K.percent(F.count("_e"), F.count("*")).alias("embedding_percent"), K.percent(F.count("_l"), F.count("*")).alias("verified_percent"))


def a19_golden_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("quality", F.when(F.col("doc_id") % 4 != 0, 1 - F.col("toxic")).alias("clean"))
    return K.accuracy(rows, ["quality", "clean"])


def a20_gates(spark, sf_dir):
    c = a17_coverage(spark, sf_dir)
    metrics = c.select(F.explode(F.array(F.struct(F.lit("embedding").alias("metric"), F.col("embedding_percent").alias("actual")), F.struct(F.lit("verified").alias("metric"), F.col("verified_percent").alias("actual")))).alias("s")).select("s.*")
    limits = spark.createDataFrame([("embedding", "min", 99.0), ("verified", "min", 20.0), ("images", "min", 20.0), ("verified", "max", 90.0)], "metric string, comparison string, threshold double")
    return K.gates(metrics, limits)


def _health(spark, sf_dir):
    last = _runs(spark, sf_dir).groupBy("source").agg(F.max("ran_at").alias("collected_at"), F.max(F.when(F.col("status") == "success", F.col("ran_at"))).alias("success_at"), F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("checked").alias("checked"), (100.0 * F.sum("valid") / F.sum("checked")).alias("valid_rate"), (100.0 * F.sum("missing") / F.sum("checked")).alias("missing_rate"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 1000, "paused").otherwise("active").alias("status"),
        F.when(F.col("s_nationkey") == 3, "manual").otherwise("board").alias("method"), (F.col("s_nationkey") * 400).alias("interval_minutes"))
    return K.health_flags(s.join(last, "source", "left").withColumn("run_status", F.lit(None).cast("string")), F.lit("2001-12-01 00:00:00").cast("timestamp_ntz"))


_FLAGS = ("due", "stale", "errored", "low_quality", "missing_required", "needs_attention")


def z23_source_health(spark, sf_dir):
    return _health(spark, sf_dir).select("source", *_FLAGS)


def a23_fleet_summary(spark, sf_dir):
    return _health(spark, sf_dir).groupBy("status").agg(F.count("*").alias("sources"), *[F.count_if(F.col(f)).alias(f) for f in _FLAGS], F.round(F.avg(F.when(F.col("valid_rate") > 0, F.col("valid_rate"))), 4).alias("mean_rate"))


def z24_diagnosis(spark, sf_dir):
    d = K.diagnosis(F.col("status"), F.col("checked"), F.col("valid"), F.col("missing"))
    rows = _runs(spark, sf_dir).withColumn("d", d)
    return rows.groupBy("status", F.col("d.key").alias("finding"), F.col("d.severity").alias("severity")).agg(F.count("*").alias("runs"))


def z33_health_reasons(spark, sf_dir):
    r = _health(spark, sf_dir)
    reasons = F.array_compact(F.array(*[F.when(F.col(f), f) for f in _FLAGS[1:5]]))
    level = F.when(F.col("needs_attention"), "attention").when(F.col("due"), "watch").when(F.col("status") == "paused", "planned").otherwise("healthy")
    weight = F.when(level == "attention", 100 + F.size(reasons)).when(level == "watch", 50).when(level == "planned", 10).otherwise(0)
    return r.select("source", level.alias("level"), F.array_join(reasons, ",").alias("reasons"), weight.alias("weight")).orderBy(F.desc("weight"), "source")


def a24_status_counts(spark, sf_dir):
    names = spark.createDataFrame([("error",), ("partial",), ("empty",), ("success",), ("running",)], "status string")
    counts = _runs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def a28_run_totals(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("source").agg(F.sum("checked").alias("checked"), F.sum("valid").alias("valid"), F.sum("failed").alias("failed"), F.max("ran_at").alias("last_at"))


def a33_map_rollup(spark, sf_dir):
    rows = _runs(spark, sf_dir).select("source", F.create_map(F.lit("failed"), F.col("failed"), F.lit("missing"), F.col("missing"), F.col("status"), F.lit(1)).alias("counts"))
    return K.merged_counts(rows, ["source"], "counts")


def a34_reason_counts(spark, sf_dir):
    rows = _runs(spark, sf_dir).select(F.create_map(F.col("status"), F.col("failed") + 1).alias("counts"))
    return K.merged_counts(rows, [], "counts").orderBy(F.desc("n"), "key")


def a35_stale_runs(spark, sf_dir):
    old = F.col("ran_at") < F.lit(ORDERS_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS")
    r = _runs(spark, sf_dir).where("failed > 0")
    return r.agg(F.count("*").alias("running"), F.count_if(old).alias("stale"), F.count_distinct(F.when(old, F.col("source"))).alias("stale_sources"))


def z28_golden_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    part = lambda c, kind, k: d.where(c).orderBy(F.desc("doc_id")).limit(k).select("doc_id", F.lit(kind).alias("kind"))
    return part("lang = 'en'", "poster", 70).unionByName(part("lang <> 'en'", "candidate", 30))


def r09_error_streaks(spark, sf_dir):
    rows = K.error_streaks(_runs(spark, sf_dir), "source", ["ran_at", "l_orderkey", "l_linenumber", "duration"], F.col("failed") > 0)
    return rows.groupBy("source").agg(F.max("streak").alias("longest"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "arz" and k[1:3].isdigit()}
_COV = """(SELECT count(*) AS published, count(v) AS embedded, count(l) AS verified, round(100.0 * count(v) / count(*), 1) AS embedding_percent, round(100.0 * count(l) / count(*), 1) AS verified_percent
  FROM documents d LEFT JOIN (SELECT vec_id AS v FROM embeddings) ON v = doc_id LEFT JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON l = d.doc_id)"""
_H = f"""(SELECT *, errored OR stale OR low_quality OR missing_required AS needs_attention FROM (SELECT source, status, valid_rate,
  status = 'active' AND method <> 'manual' AND (collected_at IS NULL OR epoch(TIMESTAMP '2001-12-01' - collected_at) / 60.0 >= minutes) AS due,
  status = 'active' AND method <> 'manual' AND (success_at IS NULL OR epoch(TIMESTAMP '2001-12-01' - success_at) / 60.0 >= greatest(2 * minutes, 2880)) AS stale,
  status IN ('error', 'blocked') OR coalesce(errors, 0) > 0 AS errored, coalesce(checked, 0) >= 5 AND coalesce(valid_rate, 0) < 40 AS low_quality, coalesce(checked, 0) >= 5 AND coalesce(missing_rate, 0) >= 30 AS missing_required
  FROM (SELECT s_suppkey AS source, CASE WHEN s_acctbal < 0 THEN 'error' WHEN s_acctbal < 1000 THEN 'paused' ELSE 'active' END AS status, CASE WHEN s_nationkey = 3 THEN 'manual' ELSE 'board' END AS method, greatest(s_nationkey * 400, 60) AS minutes FROM supplier) s
  LEFT JOIN (SELECT source AS src, max(ran_at) AS collected_at, max(ran_at) FILTER (status = 'success') AS success_at, count(*) FILTER (status = 'error') AS errors, sum(checked) AS checked, 100.0 * sum(valid) / sum(checked) AS valid_rate, 100.0 * sum(missing) / sum(checked) AS missing_rate FROM {_R} GROUP BY 1) ON src = source))"""
_LEVEL = "CASE WHEN needs_attention THEN 'attention' WHEN due THEN 'watch' WHEN status = 'paused' THEN 'planned' ELSE 'healthy' END"
SQL = {
    "a14_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "a15_means": "SELECT event_type, round(avg(value), 2) AS mean, round(100.0 * count(*) FILTER (value > 50) / count(*), 1) AS over_50 FROM events GROUP BY 1",
    "a16_run_kpis": f"SELECT count(*) AS runs, round(100.0 * count(*) FILTER (status IN ('success', 'partial')) / count(*), 1) AS success_percent, round(avg(duration), 2) AS mean_duration, quantile_disc(duration, 0.5) AS p50_duration, quantile_disc(duration, 0.95) AS p95_duration, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(valid) AS BIGINT) AS valid, round(sum(duration) / sum(checked), 2) AS per_item FROM {_R}",
    "a17_coverage": f"SELECT * FROM {_COV}",
    "a19_golden_accuracy": """WITH m AS (SELECT 'quality' AS metric, quality AS v FROM labels UNION ALL SELECT 'clean', CASE WHEN doc_id % 4 <> 0 THEN 1 - toxic END FROM labels),
        e AS (SELECT metric, count(v) AS labeled, CAST(sum(v) AS BIGINT) AS correct FROM m GROUP BY 1)
        SELECT metric, labeled, correct, round(100.0 * correct / labeled, 1) AS accuracy FROM e UNION ALL SELECT 'macro', CAST(sum(labeled) AS BIGINT), CAST(sum(correct) AS BIGINT), round(avg(100.0 * correct / labeled), 1) FROM e""",
    "a20_gates": f"""SELECT metric, actual, comparison, threshold, coalesce(CASE comparison WHEN 'min' THEN actual >= threshold ELSE actual <= threshold END, false) AS passed,
        CASE WHEN actual IS NULL THEN 'missing' WHEN comparison = 'min' AND actual < threshold THEN 'below' WHEN comparison = 'max' AND actual > threshold THEN 'above' END AS reason
        FROM (VALUES ('embedding', 'min', 99.0::DOUBLE), ('verified', 'min', 20.0), ('images', 'min', 20.0), ('verified', 'max', 90.0)) t(metric, comparison, threshold)
        LEFT JOIN (SELECT 'embedding' AS metric, embedding_percent AS actual FROM {_COV} UNION ALL SELECT 'verified', verified_percent FROM {_COV}) USING (metric)""",
    "z23_source_health": f"SELECT source, {', '.join(_FLAGS)} FROM {_H}",
    "a23_fleet_summary": f"SELECT status, count(*) AS sources, {', '.join(f'count(*) FILTER ({f}) AS {f}' for f in _FLAGS)}, round(avg(CASE WHEN valid_rate > 0 THEN valid_rate END), 4) AS mean_rate FROM {_H} GROUP BY 1",
    "z24_diagnosis": f"""SELECT status, finding, CASE WHEN finding = 'runtime_error' OR finding = 'low_valid_rate' AND rate < 20 THEN 'critical' WHEN finding IS NOT NULL THEN 'warning' END AS severity, count(*) AS runs FROM (SELECT status, rate,
        CASE WHEN status = 'error' THEN 'runtime_error' WHEN status = 'partial' THEN 'partial_failure' WHEN status = 'empty' THEN 'empty_result' WHEN checked >= 5 AND rate < 40 THEN 'low_valid_rate' WHEN checked >= 5 AND lost >= 30 THEN 'missing_required_fields' END AS finding
        FROM (SELECT *, coalesce(round(100.0 * valid / nullif(checked, 0), 2), 0) AS rate, coalesce(round(100.0 * missing / nullif(checked, 0), 2), 0) AS lost FROM {_R})) GROUP BY 1, 2, 3""",
    "z33_health_reasons": f"""SELECT source, level, concat_ws(',', {', '.join(f"CASE WHEN {f} THEN '{f}' END" for f in _FLAGS[1:5])}) AS reasons, CAST(CASE level WHEN 'attention' THEN 100 + {' + '.join(f'CAST({f} AS INT)' for f in _FLAGS[1:5])} WHEN 'watch' THEN 50 WHEN 'planned' THEN 10 ELSE 0 END AS INT) AS weight
        FROM (SELECT *, {_LEVEL} AS level FROM {_H}) ORDER BY 4 DESC, 1""",
    "a24_status_counts": f"SELECT status, coalesce(n, 0) AS n FROM (VALUES ('error'), ('partial'), ('empty'), ('success'), ('running')) t(status) LEFT JOIN (SELECT status, count(*) AS n FROM {_R} GROUP BY 1) USING (status)",
    "a28_run_totals": f"SELECT source, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(failed) AS BIGINT) AS failed, max(ran_at) AS last_at FROM {_R} GROUP BY 1",
    "a33_map_rollup": f"SELECT source, key, CAST(sum(v) AS BIGINT) AS n FROM (SELECT source, 'failed' AS key, failed AS v FROM {_R} UNION ALL SELECT source, 'missing', missing FROM {_R} UNION ALL SELECT source, status, 1 FROM {_R}) GROUP BY 1, 2",
    "a34_reason_counts": f"SELECT status AS key, CAST(sum(failed + 1) AS BIGINT) AS n FROM {_R} GROUP BY 1 ORDER BY 2 DESC, 1",
    "a35_stale_runs": f"SELECT count(*) AS running, count(*) FILTER (ran_at < TIMESTAMP '{ORDERS_NOW}' - INTERVAL 90 DAY) AS stale, count(DISTINCT CASE WHEN ran_at < TIMESTAMP '{ORDERS_NOW}' - INTERVAL 90 DAY THEN source END) AS stale_sources FROM {_R} WHERE failed > 0",
    "z28_golden_sample": "(SELECT doc_id, 'poster' AS kind FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 70) UNION ALL (SELECT doc_id, 'candidate' FROM documents WHERE lang <> 'en' ORDER BY doc_id DESC LIMIT 30)",
    "r09_error_streaks": f"""SELECT source, CAST(max(streak) AS BIGINT) AS longest FROM (SELECT source, sum(f) OVER (PARTITION BY source, island ORDER BY ran_at, l_orderkey, l_linenumber, duration) AS streak FROM
        (SELECT *, CAST(failed > 0 AS INT) AS f, sum(1 - CAST(failed > 0 AS INT)) OVER (PARTITION BY source ORDER BY ran_at, l_orderkey, l_linenumber, duration) AS island FROM {_R})) GROUP BY 1""",
}
