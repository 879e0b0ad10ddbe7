"""Checklists over orders as notices and order lines as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.operators import checklists as C
from noticeloom.sources.tables import ORDERS_NOW, table

_NOW = f"TIMESTAMP '{ORDERS_NOW}'"


def _now():
    return F.lit(ORDERS_NOW).cast("timestamp_ntz")


def z36_approval_checklist(spark, sf_dir):
    k = F.col("o_orderkey")
    title = F.when(k % 10 != 0, F.col("o_orderpriority")).otherwise(" ")
    checks = C.approval(title, F.when(k % 7 != 0, "org"), F.when(k % 6 != 0, "https://a.example/1").otherwise("n/a"), F.when(k % 4 == 0, k % 8 == 0), k % 3 != 0, F.col("o_orderdate"), _now(), F.lit(0), F.when(k % 5 != 0, "c"), F.lit("r"), F.col("o_orderstatus"), F.when(k % 9 == 0, k % 2 == 0), k % 2)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", checks.alias("checks"))
    counts = C.tally(F.col("checks"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in counts.items()], F.array_join(F.transform(F.filter("checks", lambda c: c["state"] != "pass"), lambda c: c["key"]), ",").alias("problems"))


def z35_run_hints(spark, sf_dir):
    q, k = F.col("l_quantity").cast("int"), F.col("l_orderkey")
    run = dict(stale=k % 31 == 0, status=F.when(k % 17 == 0, "empty").otherwise("success"), checked=q, valid=q % 4, board_failed=k % 5 % 2, detail_failed=F.lit(0), no_image=k % 3 % 2, image_rejected=F.lit(None).cast("int"), external_failed=(k % 11 == 0).cast("int"), attachment_failed=(k % 13 == 0).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.array_join(C.run_hints(run), ",").alias("hints"))
    return rows.groupBy("hints").agg(F.count("*").alias("runs"))


def z34_source_level(spark, sf_dir):
    k = F.col("s_suppkey")
    level = C.source_level(F.col("s_acctbal") < 0, k % 9 - 7, F.when(k % 13 == 0, "error"), k % 19 == 0, F.col("s_acctbal") < 2000, k % 8 == 0, k % 5)
    return table(spark, sf_dir, "supplier").select("s_suppkey", level.alias("level"))


def f19_structured_trust(spark, sf_dir):
    k = F.col("o_orderkey")
    t = C.trust(F.when(k % 3 != 0, "verified").otherwise("pending"), F.when(k % 5 != 0, F.col("o_orderdate")), F.when(k % 2 == 0, "fixed").otherwise("ongoing"), F.when(k % 7 != 0, F.col("o_orderdate")), F.when(k % 4 == 0, F.col("o_orderdate")), [F.when(k % 6 == 0, "contact")])
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", "t.*")


def f20_backfill_policy(spark, sf_dir):
    low = F.col("l_discount") * 10
    ok = F.when(F.col("l_returnflag") == "R", False).when(low < 0.5, False).otherwise(F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").groupBy(ok.alias("eligible")).agg(F.count("*").alias("n"))


def f21_corrections(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    confidence = F.pmod("o_orderkey", F.lit(100)) / 100.0
    fixed = F.col("o_orderdate") + F.expr("INTERVAL 1 DAY") * (F.col("o_orderkey") % 3)
    rows = o.select("o_orderkey", confidence.alias("confidence"), "o_orderdate", fixed.alias("corrected"))
    return rows.where((F.col("confidence") >= 0.85) & (F.to_date("corrected") != F.to_date("o_orderdate"))).select("o_orderkey", "corrected")


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "fz" and k[1:3].isdigit()}
_STATES = [
    ("title", "CASE WHEN k % 10 <> 0 THEN 'pass' ELSE 'block' END"), ("organization", "CASE WHEN k % 7 <> 0 THEN 'pass' ELSE 'warning' END"), ("source", "CASE WHEN k % 6 <> 0 THEN 'pass' ELSE 'block' END"),
    ("external-original", "CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'pass' ELSE 'warning' END END"), ("media", "CASE WHEN k % 3 <> 0 THEN 'pass' ELSE 'warning' END"), ("deadline", f"CASE WHEN o_orderdate >= {_NOW} THEN 'pass' ELSE 'warning' END"),
    ("category", "CASE WHEN k % 5 <> 0 THEN 'pass' ELSE 'warning' END"), ("region", "'pass'"), ("summary", "'pass'"), ("attachments", "CASE WHEN k % 9 = 0 THEN CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'pass' END END"), ("verification", "CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'warning' END"),
]
_LIST = "[" + ", ".join(s for _, s in _STATES) + "]"
_HINTS = [("stale-run", "k % 31 = 0"), ("empty-list", "k % 17 = 0 OR q = 0"), ("parse-failures", "k % 5 % 2 > 0"), ("text-only-notices", "k % 3 % 2 > 0"), ("external-failures", "k % 11 = 0"), ("attachment-failures", "k % 13 = 0"), ("nothing-valid", "q >= 5 AND q % 4 = 0")]
SQL = {
    "z36_approval_checklist": "SELECT o_orderkey, " + ", ".join(f"CAST(len(list_filter(s, lambda x: x = '{n}')) AS INT) AS \"{n}\"" for n in C.STATES) + ", concat_ws(',', " + ", ".join(f"CASE WHEN s[{i + 1}] <> 'pass' THEN '{n}' END" for i, (n, _) in enumerate(_STATES)) + f") AS problems FROM (SELECT o_orderkey, {_LIST} AS s FROM (SELECT *, o_orderkey AS k FROM orders))",
    "z35_run_hints": "SELECT CASE WHEN len(h) = 0 THEN 'healthy' ELSE array_to_string(h[1:6], ',') END AS hints, count(*) AS runs FROM (SELECT list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _HINTS) + "], lambda x: x IS NOT NULL) AS h FROM (SELECT l_orderkey AS k, CAST(l_quantity AS INT) AS q FROM lineitem)) GROUP BY 1",
    "z34_source_level": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 OR s_suppkey % 9 > 7 OR s_suppkey % 13 = 0 OR s_suppkey % 19 = 0 THEN 'critical' WHEN s_acctbal < 2000 OR s_suppkey % 8 = 0 OR s_suppkey % 5 = 0 THEN 'warning' ELSE 'ok' END AS level FROM supplier",
    "f19_structured_trust": "SELECT o_orderkey, v AS verified, v AND (k % 7 <> 0 OR k % 4 = 0 OR k % 6 = 0) AS seo_ready, v AND (k % 4 = 0 OR (k % 2 = 0 AND k % 7 <> 0)) AS calendar_ready, v AND k % 2 = 0 AND k % 7 <> 0 AS deadline_ready FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS v FROM orders)",
    "f20_backfill_policy": "SELECT CASE WHEN l_returnflag = 'R' THEN false WHEN l_discount * 10 < 0.5 THEN false ELSE l_linestatus = 'O' END AS eligible, count(*) AS n FROM lineitem GROUP BY 1",
    "f21_corrections": "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 3) AS corrected FROM orders WHERE o_orderkey % 100 >= 85 AND o_orderkey % 3 <> 0",
}
