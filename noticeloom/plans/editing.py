"""Images, edits, candidates and reminders over parts, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions.dates import kst_days_left
from noticeloom.operators import editing as E
from noticeloom.operators import images as I
from noticeloom.operators.media import distinct_gallery
from noticeloom.sources.tables import ORDERS_NOW, table

_NOW = f"TIMESTAMP '{ORDERS_NOW}'"


def _now():
    return F.lit(ORDERS_NOW).cast("timestamp_ntz")


def v11_image_score(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    name = F.element_at(F.array(*map(F.lit, ("a/poster1.jpg", "a/logo.png", "b/img.webp", "c_btn_x.gif"))), (k % 4 + 1).cast("int"))
    width, height = F.when(k % 7 != 0, size * 20), F.when(k % 7 != 0, (k % 50 * 20 + 1).cast("int"))
    kind = F.when(k % 5 == 0, "image/svg+xml").when(k % 5 == 1, "text/html").otherwise("image/png")
    score = I.image_score(name, F.when(k % 3 == 0, "참여자 모집").otherwise("x"), k % 11 == 0, kind, (k % 9 * 8000).cast("int"), width, height)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), (score >= I.LEAST).alias("passes"), I.strong_portrait(k % 2 == 0, width, height).alias("portrait"))


def l13_gallery(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"))
    return p.select("page_id", F.array_join(distinct_gallery(F.array(F.concat("u", F.lit("?w=10")), F.concat("u", F.lit("?v=2")), F.concat("u", F.lit("?h=3&w=7#x")))), " ").alias("images"))


def z38_edit_plan(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")

    def version(title, end, fee, verified):
        return F.struct(title.alias("title"), F.col("o_orderpriority").alias("org"), day.alias("start"), end.alias("end"), fee.alias("fee"), F.lit(20).alias("age_min"), (k % 40).alias("age_max"), (F.pmod(k, F.lit(12)) / 10).alias("confidence"), verified.alias("verified"))

    old = version(F.col("o_orderstatus"), day, F.lit("1"), k % 2 == 0)
    new = version(F.when(k % 17 != 0, F.col("o_orderstatus")), day - F.expr("INTERVAL 1 DAY") * (k % 13 == 0).cast("int"), (k % 3 % 2 + 1).cast("string"), k % 5 == 0)
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), old.alias("old"), new.alias("new"), (k % 7 != 0).alias("reviewed"), F.lit(True).alias("noted"), (k % 4 != 0).alias("has_image"), F.lit("https://a.example/1").alias("source_url"))
    plan = E.edit_plan(rows, ["title", "end", "fee"])
    return plan.select("id", F.array_join("changed", ",").alias("changed"), F.array_join("errors", ",").alias("errors"), "verified")


def z37_preflight(spark, sf_dir):
    k = F.col("o_orderkey")
    checks = E.preflight(F.when(k % 9 != 0, F.col("o_orderpriority")), F.when(k % 8 != 0, "https://a.example/1"), F.when(k % 4 == 0, k % 3 == 0), F.lit("org"), F.col("o_orderdate"), F.when(k % 5 != 0, F.col("o_orderdate")), _now(), F.when(k % 6 != 0, "c").otherwise(" "), F.lit("s"), F.when(k % 7 == 0, k % 2 == 0), k % 2, F.lit(0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", checks.alias("checks"))
    return rows.select("o_orderkey", F.array_join(F.transform("checks", lambda c: F.concat(c["key"], F.lit("="), c["state"])), ",").alias("checks"))


def z30_verified_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, F.col("o_orderpriority")).alias("org"), F.lit("found").alias("found_org"), (F.pmod(k, F.lit(10)) / 10).alias("confidence"))
    return E.filled_facts(rows, ["org"], F.col("confidence") >= 0.7).select("o_orderkey", "org")


def z39_conversion(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    candidates = o.join(c, "o_custkey").join(n, "n_nationkey").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("category"), F.array("n_name", F.lit("nowhere")).alias("region_names"))
    categories = o.where("o_orderpriority < '4'").select(F.col("o_orderpriority").alias("name"), F.substring("o_orderpriority", 1, 1).alias("code")).distinct()
    done = E.converted(candidates, categories, n.select(F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_nationkey").alias("code")))
    return done.select("id", "category_code", F.array_join("region_codes", ",").alias("region_codes"))


def z25_reminders(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    favorites = l.select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("id"))
    notices = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 != 0).alias("verified"), F.when(F.col("o_orderkey") % 4 != 0, "fixed").otherwise("ongoing").alias("kind"), F.col("o_orderdate").alias("end_at"))
    sent = l.where("l_quantity > 40").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("id"))
    return E.reminders(favorites, notices, sent, kst_days_left(F.col("end_at"), _now()).between(-40, 1))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "lvz" and k[1:3].isdigit()}
_IMAGE = """(SELECT p_partkey AS k, ['a/poster1.jpg', 'a/logo.png', 'b/img.webp', 'c_btn_x.gif'][p_partkey % 4 + 1] AS u, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS INT) * 20 END AS w, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 50 * 20 + 1 END AS h,
  ['svg', 'html', 'png', 'png', 'png'][p_partkey % 5 + 1] AS t, p_partkey % 9 * 8000 AS n FROM part)"""
_SCORE = """CASE WHEN k % 4 IN (1, 3) OR (t = 'html' AND w IS NULL) OR (w / h BETWEEN 1.35 AND 2.25 AND w <= 599 AND h <= 399 AND k % 11 <> 0) IS TRUE THEN 0 ELSE greatest(0, least(100, 30 + CASE WHEN k % 4 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END
  + CASE t WHEN 'html' THEN 8 WHEN 'svg' THEN -30 ELSE 0 END + CASE WHEN w IS NULL THEN 0 WHEN w < 220 OR h < 220 OR w * h < 90000 THEN -45 WHEN w >= 300 AND h >= 400 THEN 20 ELSE 8 END
  + CASE WHEN w IS NULL THEN 0 WHEN w / h BETWEEN 0.45 AND 1.15 THEN 18 WHEN w / h > 1.15 AND w / h <= 1.9 THEN 6 ELSE -25 END + CASE WHEN n BETWEEN 1 AND 11999 THEN -20 WHEN n >= 50000 THEN 8 ELSE 0 END)) END"""
_CHANGED = "concat_ws(',', CASE WHEN k % 17 = 0 THEN 'title' END, CASE WHEN k % 13 = 0 THEN 'end' END, CASE WHEN k % 3 = 1 THEN 'fee' END)"
_FRESH = "(k % 5 = 0 AND (k % 2 = 1 OR k % 17 = 0 OR k % 13 = 0 OR k % 3 = 1))"
SQL = {
    "v11_image_score": f"SELECT k AS p_partkey, CAST(s AS INT) AS score, s >= 45 AS passes, (k % 2 = 1 AND w >= 600 AND h >= 700 AND w / h BETWEEN 0.45 AND 0.9) IS TRUE AS portrait FROM (SELECT *, {_SCORE} AS s FROM {_IMAGE})",
    "l13_gallery": "SELECT page_id, u || '?w=10 ' || u || '?v=2' AS images FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)",
    "z38_edit_plan": f"""SELECT k AS id, {_CHANGED} AS changed, concat_ws(',', CASE WHEN k % 17 = 0 THEN 'missing-title' END, CASE WHEN k % 13 = 0 THEN 'period-order' END, CASE WHEN k % 40 < 20 THEN 'age-order' END, CASE WHEN k % 12 = 11 THEN 'confidence-range' END,
        CASE WHEN {_FRESH} AND k % 7 = 0 THEN 'review-incomplete' END, CASE WHEN {_FRESH} AND k % 4 = 0 THEN 'image-missing' END) AS errors, CASE WHEN {_FRESH} THEN 'fresh' WHEN k % 5 = 0 THEN 'kept' WHEN k % 2 = 0 THEN 'dropped' ELSE 'none' END AS verified FROM (SELECT o_orderkey AS k FROM orders)""",
    "z37_preflight": f"""SELECT o_orderkey, concat_ws(',', 'title=' || CASE WHEN k % 9 = 0 THEN 'block' ELSE 'pass' END, 'source=' || CASE WHEN k % 8 = 0 THEN 'block' ELSE 'pass' END, CASE WHEN k % 4 = 0 THEN 'external-original=' || CASE WHEN k % 3 = 0 THEN 'pass' ELSE 'warning' END END, 'organization=pass',
        'period=' || CASE WHEN k % 5 <> 0 AND o_orderdate < {_NOW} THEN 'warning' ELSE 'pass' END, 'category=' || CASE WHEN k % 6 = 0 THEN 'warning' ELSE 'pass' END, 'summary=pass', CASE WHEN k % 7 = 0 THEN 'attachments=' || CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'pass' END END,
        'duplicate=' || CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'warning' END, 'quality=pass') AS checks FROM (SELECT *, o_orderkey AS k FROM orders)""",
    "z30_verified_fields": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 10 >= 7 THEN 'found' END AS org FROM orders",
    "z39_conversion": "SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '4' THEN substring(o_orderpriority, 1, 1) ELSE 'etc' END AS category_code, 'R' || n_nationkey AS region_codes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "z25_reminders": f"""WITH f AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS id FROM lineitem) SELECT f.user_id, f.id FROM f JOIN orders ON id = o_orderkey WHERE id % 3 <> 0 AND id % 4 <> 0
        AND date_diff('day', CAST({_NOW} + INTERVAL 9 HOUR AS DATE), CAST(o_orderdate + INTERVAL 9 HOUR AS DATE)) BETWEEN -40 AND 1 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l_quantity > 40 AND l.l_suppkey = f.user_id AND l.l_orderkey = f.id)""",
}
