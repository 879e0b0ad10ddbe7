"""Institutions, links, images and outputs: suppliers are sources, pages are posts, parts are images."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.operators import institutions as I
from noticeloom.operators import media as M
from noticeloom.sources.tables import ORDERS_NOW, table


def _sources(spark, sf_dir):
    n = F.col("s_suppkey").cast("int")
    return table(spark, sf_dir, "supplier").select(
        F.when(n % 11 != 0, n).alias("institution"), F.concat(F.lit("src-"), n).alias("slug"), F.col("s_name").alias("name"), F.concat(F.lit("https://host"), n % 40, F.lit(".example/board/"), n % 3, F.lit("/list")).alias("list_url"),
        F.concat(F.lit("https://host"), n % 40, F.lit(".example/")).alias("homepage_url"), F.when(n % 7 == 0, "retired").when(n % 5 == 0, "paused").otherwise("active").alias("status"))


_S = """(SELECT CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey END AS institution, 'src-' || s_suppkey AS slug, s_name AS name, 'https://host' || s_suppkey % 40 || '.example/board/' || s_suppkey % 3 || '/list' AS list_url,
  'https://host' || s_suppkey % 40 || '.example/' AS homepage_url, CASE WHEN s_suppkey % 7 = 0 THEN 'retired' WHEN s_suppkey % 5 = 0 THEN 'paused' ELSE 'active' END AS status FROM supplier)"""


def _posts(spark, sf_dir):
    k = F.col("p_partkey").cast("int")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    p = table(spark, sf_dir, "part").withColumn("k", F.when(k % 9 == 0, (k % 97).cast("long")))
    return p.join(s, "k", "left").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.upper("s_name")).alias("org"), F.concat(F.lit("https://www.host"), k % 45, F.lit(".example/board/"), k % 4, F.lit("/view?id="), k).alias("url"))


_P = "(SELECT p_partkey AS id, ' ' || upper(s_name) AS org, 'https://www.host' || p_partkey % 45 || '.example/board/' || p_partkey % 4 || '/view?id=' || p_partkey AS url, p_partkey % 45 AS h, p_partkey % 4 AS b FROM part LEFT JOIN supplier ON s_suppkey = CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 97 END)"


def z09_institution_resolution(spark, sf_dir):
    return I.resolve(_posts(spark, sf_dir).withColumn("url", F.regexp_replace("url", "//www\\.", "//")), _sources(spark, sf_dir))


def j14_best_source(spark, sf_dir):
    posts = _posts(spark, sf_dir).select("id", F.when(F.col("id") % 13 == 0, F.concat(F.lit("src-"), F.col("id") % 50)).alias("site"), F.lit(None).cast("string").alias("site_name"), F.regexp_replace("url", "/view.*$", "/list/1").alias("url"))
    return I.best_source(posts, _sources(spark, sf_dir))


def z10_registration(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), F.upper("s_name")).alias("name"))
    return I.registration_plan(names, table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name")))


def a29_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("institution"), F.col("doc_id").alias("id"), "text")
    boards, blogs = d.where("id % 2 = 0"), d.where("id % 2 = 1")
    digest = lambda d: d.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    matches = digest(boards).join(digest(blogs).select("digest").distinct(), "digest", "left_semi").select("id")
    return I.coverage(boards, blogs, matches)


def l09_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return M.assembled_links(p.select((F.col("page_id") % 60).alias("id"), F.col("page_id").alias("position"), F.lit("other").alias("declared"), "url", F.col("page_id").cast("string").alias("label"), (F.col("page_id") % 4 == 1).alias("is_primary")))


def v12_image_order(spark, sf_dir):
    k = F.col("p_partkey")
    return M.ordered_images(table(spark, sf_dir, "part").select((k % 300).alias("id"), F.concat(F.lit("i"), k).alias("url"), F.col("p_size").alias("score"), (F.col("p_size") >= 10).alias("passes"), (k % 2 == 0).alias("proxy"), (k % 5 == 0).alias("portrait")))


def z17_representative(spark, sf_dir):
    k = F.col("p_partkey")
    return M.representative(table(spark, sf_dir, "part").select((k % 300).alias("id"), F.concat(F.lit("i"), k).alias("url"), F.col("p_size").alias("width"), F.lit(10).alias("height"), (k % 3).alias("priority")))


def k08_site_map(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    notices = n.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("active"))
    return M.site_map(notices, n.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("region")), n.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category")), 50)


def k09_calendar(spark, sf_dir):
    end = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 3 HOURS"))
    text = M.calendar(F.col("o_orderkey"), F.concat("o_orderpriority", F.lit(", now; \\ x")), F.col("o_orderdate"), end, F.lit(ORDERS_NOW).cast("timestamp_ntz"), "-//notices//EN")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", text.alias("ics"))


def k10_structured_data(spark, sf_dir):
    d = M.structured_data(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_orderdate"), F.col("o_orderkey") % 2 == 0)
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", d.alias("json"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "ajklvz" and k[1:3].isdigit()}
_LIVE = f"(SELECT *, lower(trim(name)) AS nk, regexp_replace(list_url, '[^/]*$', '') AS dir, length(regexp_replace(list_url, '[^/]*$', '')) AS depth, regexp_extract(list_url, '//([^/]+)', 1) AS h, count(*) OVER (PARTITION BY regexp_extract(list_url, '//([^/]+)', 1)) AS hn FROM {_S} WHERE institution IS NOT NULL AND status <> 'retired')"
SQL = {
    "z09_institution_resolution": f"""SELECT id, CAST(institution AS INT) AS institution FROM (SELECT p.id, s.institution, row_number() OVER (PARTITION BY p.id ORDER BY (lower(trim(p.org)) = s.nk) IS TRUE DESC, starts_with(replace(p.url, 'www.', ''), s.dir) DESC, s.depth DESC, (s.status = 'active') DESC, s.slug) AS r
        FROM {_P} p JOIN {_LIVE} s ON lower(trim(p.org)) = s.nk OR starts_with(replace(p.url, 'www.', ''), s.dir) OR (s.hn = 1 AND s.h = 'host' || p.h || '.example')) WHERE r = 1""",
    "j14_best_source": f"""SELECT id, source, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, source) AS r FROM (
        SELECT p.id, s.slug AS source, CASE WHEN p.id % 13 = 0 AND s.slug = 'src-' || p.id % 50 THEN 1000 ELSE 700 + CASE WHEN s.list_url LIKE '%/board/' || p.b || '/list' THEN 13 ELSE 0 END END AS score
        FROM {_P} p JOIN {_S} s ON s.list_url LIKE 'https://host' || p.h || '.example/%' OR (p.id % 13 = 0 AND s.slug = 'src-' || p.id % 50))) WHERE r = 1""",
    "z10_registration": "SELECT lower(s_name) AS name_key, 'org-' || substring(md5(lower(s_name)), 1, 16) AS id, upper(s_name) AS name FROM supplier WHERE s_suppkey % 3 <> 0",
    "a29_coverage": """SELECT source AS institution, count(*) FILTER (doc_id % 2 = 0) AS board, count(*) FILTER (doc_id % 2 = 1) AS blog, count(*) FILTER (doc_id % 2 = 0 AND twin) AS overlap,
        round(coalesce(count(*) FILTER (doc_id % 2 = 0 AND twin)::DOUBLE / nullif(count(*) FILTER (doc_id % 2 = 0), 0), 0), 4) AS rate, CASE WHEN count(*) FILTER (doc_id % 2 = 0) = 0 THEN 'none' WHEN count(*) FILTER (doc_id % 2 = 0 AND twin) >= 0.7 * count(*) FILTER (doc_id % 2 = 0) THEN 'blog' ELSE 'board' END AS grade
        FROM (SELECT source, doc_id, text IN (SELECT text FROM documents WHERE doc_id % 2 = 1) AS twin FROM documents) GROUP BY 1""",
    "v12_image_order": """WITH i AS (SELECT p_partkey % 300 AS id, 'i' || p_partkey AS url, p_size AS score, p_size >= 10 AS passes, p_partkey % 2 = 0 AS proxy, p_partkey % 5 = 0 AS portrait FROM part),
        s AS (SELECT id, bool_or(passes AND NOT proxy AND portrait) AS tall, bool_or(passes AND proxy) AND count(*) FILTER (passes AND NOT proxy) > 1 AS carousel FROM i GROUP BY 1),
        g AS (SELECT i.*, tall, CASE WHEN NOT passes THEN 9 WHEN tall AND proxy THEN 8 WHEN tall AND portrait THEN 0 WHEN tall THEN 1 WHEN carousel AND NOT proxy THEN 1 ELSE 0 END AS part FROM i JOIN s USING (id))
        SELECT id, url, CAST(row_number() OVER (PARTITION BY id ORDER BY part, score DESC, url) AS INT) AS place FROM g WHERE part <> 8""",
    "k09_calendar": f"""SELECT o_orderkey, array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//notices//EN', 'BEGIN:VEVENT', 'UID:' || o_orderkey, 'DTSTAMP:20010701T000000Z', 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ'),
        'DTEND:' || strftime(o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 1 HOUR END, '%Y%m%dT%H%M%SZ'), 'SUMMARY:' || o_orderpriority || '\\, now\\; \\\\ x', 'END:VEVENT', 'END:VCALENDAR'], chr(13) || chr(10)) AS ics FROM orders WHERE o_orderstatus = 'P'""",
    "k10_structured_data": """SELECT o_orderkey, '{"@context":"https://schema.org","@type":"Event","name":"' || o_orderpriority || '",' || CASE WHEN o_orderkey % 2 = 0 THEN '"startDate":"' || strftime(o_orderdate, '%Y-%m-%d') || '","endDate":"' || strftime(o_orderdate, '%Y-%m-%d') || '",' ELSE '' END
        || '"organizer":{"@type":"Organization","name":"P"}}' AS json FROM orders WHERE o_orderstatus = 'P'""",
    "z17_representative": "SELECT p_partkey % 300 AS id, 'i' || arg_max(p_partkey, (p_size, p_partkey % 3, 'i' || p_partkey)) AS url FROM part GROUP BY 1",
    "k08_site_map": "SELECT c_nationkey AS region, o_orderpriority AS category, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50",
}
