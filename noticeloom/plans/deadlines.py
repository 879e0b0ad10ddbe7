"""Date quality over texts made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions import applications as A
from noticeloom.sources.tables import table


def _notices(spark, sf_dir):
    k, end = F.col("o_orderkey"), F.col("o_orderdate")
    day = lambda c: F.date_format(c, "yyyy.MM.dd")
    start = end - F.expr("INTERVAL 10 DAYS")
    text = (
        F.when(k % 6 <= 1, F.concat(F.lit("안내\n신청기간: "), day(start), F.lit(" 09:00 ~ "), day(end), F.lit(" / 교육기간 3.1"))).when(k % 6 == 2, F.concat(F.lit("모집기간 "), day(start), F.lit(" ~ 모집시까지")))
        .when(k % 6 == 3, F.concat(F.lit("접수마감 "), day(end), F.lit("까지"))).when(k % 6 == 4, F.concat(F.lit("상시 모집\n신청기간: "), day(end), F.lit(" ~ "), day(start)))
        .otherwise(F.concat_ws(", ", F.lit("행사"), day(start), day(end), day(start)))
    )
    deadline = F.when((k % 6 == 0) | (k % 6 == 4), F.date_format(end, "yyyy-MM-dd")).when(k % 6 == 1, F.date_format(end + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), deadline.alias("deadline"))


def _as_text(c):
    return F.coalesce(c.cast("string"), F.lit(""))


def d06_segments(spark, sf_dir):
    return _notices(spark, sf_dir).select("o_orderkey", F.array_join(A.segments(F.col("text")), "|").alias("segments"))


def d07_application_period(spark, sf_dir):
    p = _notices(spark, sf_dir).select("o_orderkey", A.application_period(F.col("text")).alias("p"))
    return p.select("o_orderkey", _as_text(F.col("p.start")).alias("start_day"), _as_text(F.col("p.end")).alias("end_day"))


def d08_date_quality(spark, sf_dir):
    q = _notices(spark, sf_dir).select("o_orderkey", A.date_quality(F.col("text"), F.col("deadline")).alias("q"))
    return q.select("o_orderkey", F.array_join("q.issues", ",").alias("issues"), _as_text(F.col("q.suggested")).alias("suggested"))


def d09_stored_deadline(spark, sf_dir):
    return _notices(spark, sf_dir).select("o_orderkey", _as_text(A.date_quality(F.col("text"), F.col("deadline"))["stored"]).alias("stored"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "d" and k[1:3].isdigit()}
_O = "(SELECT o_orderkey, o_orderkey % 6 AS k, strftime(o_orderdate, '%Y-%m-%d') AS e, strftime(o_orderdate - INTERVAL 10 DAY, '%Y-%m-%d') AS s, strftime(o_orderdate, '%Y.%m.%d') AS ed, strftime(o_orderdate - INTERVAL 10 DAY, '%Y.%m.%d') AS sd FROM orders)"
_SUGGESTED = "['' || e, e, '', e, s, ''][k + 1]"
SQL = {
    "d06_segments": f"SELECT o_orderkey, ['신청기간: ' || sd || ' 09:00 ~ ' || ed || ' / ', '신청기간: ' || sd || ' 09:00 ~ ' || ed || ' / ', '모집기간 ' || sd || ' ~ 모집시까지', '접수마감 ' || ed || '까지', '신청기간: ' || ed || ' ~ ' || sd, ''][k + 1] AS segments FROM {_O}",
    "d07_application_period": f"SELECT o_orderkey, [s, s, '', '', e, ''][k + 1] AS start_day, {_SUGGESTED} AS end_day FROM {_O}",
    "d08_date_quality": f"SELECT o_orderkey, ['', 'deadline-mismatch', 'open-ended-application-period', 'missing-clear-deadline', 'date-end-before-start,always-open-conflict,deadline-mismatch', 'ambiguous-multiple-dates'][k + 1] AS issues, {_SUGGESTED} AS suggested FROM {_O}",
    "d09_stored_deadline": f"SELECT o_orderkey, {_SUGGESTED} AS stored FROM {_O}",
}
