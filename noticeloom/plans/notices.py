"""Periods, labelled fields, lines and decoding over texts made of orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions import notices as N
from noticeloom.sources.tables import table


def d04_period(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    end = day + F.expr("INTERVAL 1 DAY") * (k % 200)
    end = F.when(F.date_format(end, "MMdd") == "0229", end - F.expr("INTERVAL 1 DAY")).otherwise(end)
    text = F.when(k % 5 == 0, "연중 상시 모집").when(k % 5 == 1, F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit(" ~ 예산 소진 시까지"))).when(k % 5 == 2, F.concat(F.lit("접수: "), F.date_format(day, "yyyy-MM-dd"), F.lit(" ~ "), F.date_format(end, "M월 d일"))).when(k % 5 == 3, F.concat(F.lit("~ "), F.date_format(end, "M/d"), F.lit("까지"))).otherwise("추후 공지")
    p = N.period(text, F.to_date(day))
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return o.select("o_orderkey", p.alias("p")).select("o_orderkey", text_of(F.col("p.start")).alias("start_day"), text_of(F.col("p.end")).alias("end_day"), text_of(F.col("p.kind")).alias("kind"))


def x11_labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("대상 : 누구나\n"), F.col("text"), F.lit("\n ● 신청기간: "), F.split("text", "\n")[0], F.lit("\n문의처： "), F.col("source"), F.lit("\n"))
    return d.select("doc_id", N.labelled(text, ("문의", "문의처")).alias("contact"), N.labelled(text, ("대상",)).alias("target"), N.labelled(text, ("신청기간",)).alias("period"))


def x09_clean_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.clean_lines(F.concat(F.lit("목록\n"), "text", F.lit("\nRSS\n"), "text")).alias("lines"))


def s14_decoded(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", N.decoded(F.col("html").cast("binary"), F.lit("text/html; charset=utf-8")).alias("html"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "dsx" and k[1:3].isdigit()}
_END = "make_date(year(o_orderdate), month(e), day(e))"
_YEAR = f"CASE WHEN {_END} < CAST(o_orderdate AS DATE) - 60 THEN CAST({_END} + INTERVAL 1 YEAR AS DATE) ELSE {_END} END"
SQL = {
    "d04_period": f"""SELECT o_orderkey, CASE WHEN k % 5 IN (1, 2) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS start_day, CASE WHEN k % 5 IN (2, 3) THEN CAST({_YEAR} AS VARCHAR) ELSE '' END AS end_day, ['ongoing', 'until_exhausted', 'fixed', 'fixed', ''][k % 5 + 1] AS kind
        FROM (SELECT *, CASE WHEN strftime(raw, '%m%d') = '0229' THEN raw - INTERVAL 1 DAY ELSE raw END AS e FROM (SELECT *, o_orderkey AS k, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 200) AS raw FROM orders))""",
    "x11_labelled": "SELECT doc_id, source AS contact, '누구나' AS target, CASE WHEN trim(l, ' ' || chr(9) || chr(13)) = '' THEN '문의처： ' || source ELSE trim(ltrim(l, ' ' || chr(9) || chr(13))) END AS period FROM (SELECT *, string_split(text, chr(10))[1] AS l FROM documents)",
    "x09_clean_lines": """SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(lw, lower(x)) = i), chr(10)) AS lines FROM (SELECT doc_id, l, list_transform(l, lambda x: lower(x)) AS lw FROM (SELECT doc_id,
        list_filter(list_transform(string_split_regex('목록' || chr(10) || text || chr(10) || 'RSS' || chr(10) || text, '\\r?\\n'), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '' AND x NOT IN ('목록', 'RSS')) AS l FROM documents))""",
    "s14_decoded": "SELECT page_id, html FROM pages",
}
