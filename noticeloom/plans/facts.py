"""Facts, links and regions in texts made of documents, pages and nations; small table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions import facts as N
from noticeloom.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", (F.col("doc_id") % 6).alias("k"))


def x10_section_breaks(spark, sf_dir):
    # each line of a document is the value of a section whose head has run into the line before
    t = F.concat(F.lit("신청기간: "), F.regexp_replace("text", "\n", " ● 문의처: "), F.lit(" 1. 대상: 누구나"))
    return _docs(spark, sf_dir).select("doc_id", N.section_breaks(t).alias("text"))


def x12_usable_fact(spark, sf_dir):
    d = _docs(spark, sf_dir)
    period = F.when(F.col("k") == 0, "2026.03.01 ~ 2026.03.09 문의처: x").when(F.col("k") == 1, "2026.03.01 ~").when(F.col("k") == 2, "상시 모집").when(F.col("k") == 3, "미정").when(F.col("k") == 4, "3월 2일까지 #태그")
    contact = F.concat("source", F.lit(" 02-123-4567 https://a.example/x"))
    content = N.usable_fact(F.concat(F.lit("내용 "), F.array_join(F.regexp_extract_all("text", F.lit(r"([A-Za-z \n]+)"), F.lit(1)), "")), "content")
    return d.select("doc_id", N.usable_fact(period, "period").alias("period"), N.usable_fact(contact, "contact").alias("contact"), content.alias("content"))


def x15_org_in_title(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", N.org_in_title(F.concat(F.repeat("source", F.col("k").cast("int")), F.lit(" <name>"))).alias("org"))


def l10_inline_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    t = F.concat(F.lit("Apply at "), "url", F.lit(". Or "), "url", F.lit(" soon"))
    return p.select("page_id", F.explode(N.inline_links(t, 5)).alias("l")).select("page_id", "l.*")


def z15_regions(spark, sf_dir):
    words = {"a": ("RUS", "IRA"), "b": ("UN", "JAP"), "c": ("CHI",), "d": ("A",)}
    r = table(spark, sf_dir, "nation").select("n_nationkey", F.upper("n_name").alias("t"))
    return r.select("n_nationkey", F.array_join(F.transform(N.regions(F.col("t"), words, ("EG",)), lambda x: F.concat(x["region"], F.lit("="), F.format_number(x["confidence"], 2))), ",").alias("regions"))


def u03_verified_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.trim("s_name").alias("name")
    return s.where("s_acctbal > 0").select(name).union(s.where("s_suppkey % 3 = 0").select(name)).distinct()


def t11_candidate_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.orderBy((F.col("o_orderstatus") == "P").desc(), F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey")


def t12_source_list(spark, sf_dir):
    weight = F.when(F.col("s_acctbal") < 0, 100 + F.col("s_suppkey") % 3).when(F.col("s_acctbal") < 2000, 50).when(F.col("s_suppkey") % 7 == 0, 10).otherwise(0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", weight.alias("weight")).orderBy(F.desc("weight"), "s_suppkey")


def j16_update_from(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    known = c.where("c_custkey % 2 = 0").groupBy(F.lower(F.trim(F.regexp_replace("c_name", "Customer", "Supplier"))).alias("k")).agg(F.min("c_custkey").alias("found"))
    return s.withColumn("k", F.lower(F.trim("s_name"))).join(known, "k", "left").select("s_suppkey", F.coalesce("found", F.lit(-1)).alias("institution"))


def j17_embedded(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.struct("r_name").alias("region"))
    return n.join(r, "n_regionkey", "left").select("n_nationkey", F.col("region.r_name").alias("region_name"))


def a25_crawler_summary(spark, sf_dir):
    d = _docs(spark, sf_dir)
    reasons = F.array_compact(F.array(F.when(F.length("text") < 100, "short"), F.when(F.col("text").rlike("(?i)licen[sc]e"), "license"), F.when(F.col("k") == 0, "no-image")))
    return d.select("source", F.explode_outer(reasons).alias("reason")).groupBy("source", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "afjltuxz" and k[1:3].isdigit()}
SQL = {
    "x10_section_breaks": """SELECT doc_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: rtrim(CASE WHEN i = 1 THEN '신청기간: ' ELSE '● 문의처: ' END || l[i], ' ' || chr(9) || chr(13))), chr(10)) || chr(10) || '1. 대상: 누구나' AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "x12_usable_fact": "SELECT doc_id, ['2026.03.01 ~ 2026.03.09', NULL, '상시 모집', NULL, '3월 2일까지', NULL][doc_id % 6 + 1] AS period, source || ' 02-123-4567' AS contact, CASE WHEN length(c) <= 700 AND c NOT LIKE '%www.' THEN c END AS content FROM (SELECT *, trim('내용 ' || trim(regexp_replace(string_split(regexp_replace(text, '[^A-Za-z \\n]', '', 'g'), chr(10))[1], ' +', ' ', 'g'))) AS c FROM documents)",
    "x15_org_in_title": "SELECT doc_id, CASE WHEN doc_id % 6 > 0 AND length(repeat(source, doc_id % 6)) <= 25 THEN repeat(source, doc_id % 6) END AS org FROM documents",
    "l10_inline_links": "SELECT page_id, url, 'y at ' AS before, '. Or ' AS after FROM pages UNION ALL SELECT page_id, url, '. Or ', ' soon' FROM pages",
    "z15_regions": """SELECT n_nationkey, CASE WHEN len(h) = 0 THEN CASE WHEN contains(t, 'EG') THEN 'nation=0.72' ELSE '' END ELSE array_to_string(list_transform(h[1:2], lambda x: x.r || '=' || printf('%.2f', least(CAST(0.68 - 0.07 * x.n AS DOUBLE), CASE WHEN len(h) > 2 THEN 0.72 ELSE 0.95 END))), ',') END AS regions
        FROM (SELECT n_nationkey, t, list_sort(list_filter([{'n': -(contains(t, 'RUS')::INT + contains(t, 'IRA')::INT), 'r': 'a'}, {'n': -(contains(t, 'UN')::INT + contains(t, 'JAP')::INT), 'r': 'b'}, {'n': -contains(t, 'CHI')::INT, 'r': 'c'}, {'n': -contains(t, 'A')::INT, 'r': 'd'}], lambda x: x.n < 0)) AS h FROM (SELECT n_nationkey, upper(n_name) AS t FROM nation))""",
    "u03_verified_names": "SELECT trim(s_name) AS name FROM supplier WHERE s_acctbal > 0 UNION SELECT trim(s_name) FROM supplier WHERE s_suppkey % 3 = 0",
    "t11_candidate_list": "SELECT o_orderkey FROM orders ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey LIMIT 100",
    "t12_source_list": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 100 + s_suppkey % 3 WHEN s_acctbal < 2000 THEN 50 WHEN s_suppkey % 7 = 0 THEN 10 ELSE 0 END AS weight FROM supplier",
    "j16_update_from": "SELECT s_suppkey, coalesce(f, -1) AS institution FROM supplier LEFT JOIN (SELECT lower(trim(replace(c_name, 'Customer', 'Supplier'))) AS k, min(c_custkey) AS f FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) ON k = lower(trim(s_name))",
    "j17_embedded": "SELECT n_nationkey, r_name AS region_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "a25_crawler_summary": """SELECT source, reason, count(*) AS n FROM (SELECT source, unnest(CASE WHEN len(r) = 0 THEN ['none'] ELSE r END) AS reason FROM (SELECT source, list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'license' END, CASE WHEN doc_id % 6 = 0 THEN 'no-image' END], lambda x: x IS NOT NULL) AS r FROM documents)) GROUP BY 1, 2""",
}
