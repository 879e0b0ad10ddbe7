"""Traffic and engagement over the event log.

A visitor is a user, a session a visitor's Korean day, a path an event type; 'error' rows stand for
automated traffic. The number in props stands for user agents, referrers and campaign parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions.dates import kst_date, kst_day_start
from noticeloom.operators import traffic as T
from noticeloom.sources.tables import EVENTS_NOW, table

_AGENTS = ("Googlebot/2.1", "Mozilla/5.0 (iPhone; Mobile)", "Mozilla/5.0 (iPad)", "HeadlessChrome/120", "", "Mozilla/5.0 (Windows NT 10.0)")
_HOSTS = ("www.google.com", "search.naver.com", "m.daum.net", "l.instagram.com", "own.example", "", "blog.example.org")
_OWN = ("own.example", "localhost")

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_AGENT_SQL = "CASE " + _K + " % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_AGENTS)) + " END"
_HOST_SQL = "CASE " + _K + " % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_HOSTS)) + " END"
_ROLE_SQL = "CASE WHEN user_id % 17 = 0 THEN 'admin' WHEN user_id % 13 = 0 THEN 'operator' WHEN user_id % 3 = 0 THEN 'user' END"
_UTM_SQL = "CASE WHEN " + _K + " % 11 = 0 THEN 'newsletter' ELSE '' END"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a visit with (visitor, session, path, day, user_agent, referrer, role, utm)."""
    e = table(spark, sf_dir, "events")
    day = kst_date("ts")
    return e.select(
        "event_id", "ts", "value", F.col("user_id").alias("visitor"), F.concat_ws("-", F.col("user_id"), day).alias("session"), F.col("event_type").alias("path"), day.alias("day"),
        F.expr(_AGENT_SQL).alias("user_agent"), F.expr(_HOST_SQL).alias("referrer"), F.expr(_ROLE_SQL).alias("role"), F.expr(_UTM_SQL).alias("utm"),
    )


_V = f"""(SELECT event_id, ts, value, user_id AS visitor, concat_ws('-', user_id, CAST(ts + INTERVAL 9 HOUR AS DATE)) AS session, event_type AS path,
          CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, {_AGENT_SQL} AS user_agent, {_HOST_SQL} AS referrer, {_ROLE_SQL} AS role, {_UTM_SQL} AS utm FROM events)"""
_BOT = f"regexp_matches(coalesce(user_agent, ''), '(?i){T.BOTS}')"
_AUTO = f"({_BOT} OR regexp_matches(coalesce(user_agent, ''), '(?i){T.AUTOMATION}'))"
_ACTOR = f"CASE WHEN role IN ('admin', 'super_admin') THEN 'admin' WHEN role = 'operator' THEN 'operator' WHEN role = 'user' THEN 'member' WHEN {_BOT} THEN 'bot' WHEN {_AUTO} THEN 'automation' ELSE 'visitor' END"
_PLATFORM = f"CASE WHEN utm = 'app' THEN 'app' WHEN regexp_matches(lower(user_agent), '{T.BOTS}') THEN 'bot' WHEN regexp_matches(lower(user_agent), '{T.TABLETS}') THEN 'tablet_web' WHEN regexp_matches(lower(user_agent), '{T.PHONES}') THEN 'mobile_web' WHEN user_agent <> '' THEN 'desktop_web' ELSE 'unknown' END"
_SOURCE = "CASE WHEN utm <> '' THEN utm WHEN referrer IN ('', 'own.example', 'localhost') THEN 'direct' WHEN referrer LIKE '%google.%' THEN 'Google' WHEN referrer LIKE '%naver.%' THEN 'Naver' WHEN referrer LIKE '%daum.net%' THEN 'Daum/Kakao' WHEN referrer LIKE '%instagram.%' THEN 'Instagram' ELSE regexp_replace(referrer, '^www\\.', '') END"


def _actor():
    source = T.automation_source(F.col("user_agent"), F.lit(False), F.lit(""))
    return T.actor(F.col("role"), source.isNotNull(), T.is_bot(F.col("user_agent")), F.lit("visitor"))


def _source():
    return T.source_label(F.col("utm"), F.col("referrer"), _OWN)


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.external(visits(spark, sf_dir), F.col("path") == "error", F.col("role"))


_EXT = f"(SELECT * FROM {_V} WHERE path <> 'error' AND coalesce(role NOT IN ('admin', 'super_admin', 'operator'), true))"


def a05_traffic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.breakdown(visits(spark, sf_dir).where("path <> 'error'"), F.col("day").cast("string")).withColumnRenamed("key", "day").orderBy("day")


def a02_popular_keywords(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    recent = e.where((F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{EVENTS_NOW}' - INTERVAL 30 DAYS")) & (F.trim("props") != ""))
    return recent.groupBy(F.trim("props").alias("keyword")).agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "keyword").limit(10)


def a03_traffic_overview(spark, sf_dir):
    return T.overview(_external(spark, sf_dir), "2024-01-29 16:00:00")


def a04_traffic_overview_unfiltered(spark, sf_dir):
    return T.overview(visits(spark, sf_dir), "2024-01-29 16:00:00").select("pageviews", "visitors", "today_pageviews", "today_visitors")


def _by(key):
    return lambda spark, sf_dir: T.breakdown(visits(spark, sf_dir), key())


def a06_first_touch(spark, sf_dir):
    return T.first_touch(visits(spark, sf_dir).withColumn("source", _source())).groupBy("source", "landing").agg(F.count("*").alias("sessions"), F.sum("pageviews").alias("pageviews"))


def a07_top_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "events").groupBy("props").agg(F.count("*").alias("pageviews"), F.count_distinct("user_id").alias("visitors"))
    return T.top(pages, "visitors", "props")


def _per_user(spark, sf_dir):
    kinds = lambda k: F.count_if(F.col("event_type") == k)
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(kinds("view").alias("views"), kinds("click").alias("clicks"), kinds("purchase").alias("favorites"))
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("views", "clicks", "favorites")]
    return items.join(counts, "id", "left").select("id", "status", *filled)


_PER = """(SELECT c_custkey AS id, c_mktsegment AS status, coalesce(views, 0) AS views, coalesce(clicks, 0) AS clicks, coalesce(favorites, 0) AS favorites FROM customer
  LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS favorites FROM events GROUP BY 1) ON user_id = c_custkey)"""


def a08_item_counts(spark, sf_dir):
    return _per_user(spark, sf_dir)


def a09_engagement_report(spark, sf_dir):
    v, c, f = F.col("views"), F.col("clicks"), F.col("favorites")
    ratio = lambda a, b: F.round(F.coalesce(100.0 * a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    total = _per_user(spark, sf_dir).groupBy("status").agg(F.count("*").alias("items"), F.sum(v).alias("views"), F.sum(c).alias("clicks"), F.sum(f).alias("favorites"))
    return total.select("*", T.engagement(v, c, f).alias("engagement"), ratio(c, v).alias("ctr"), ratio(f, v).alias("save_rate"))


def a10_popularity(spark, sf_dir):
    rows = _per_user(spark, sf_dir).select("id", T.popularity(F.col("views"), F.col("clicks"), F.col("favorites")).alias("popularity"))
    return rows.orderBy(F.desc("popularity"), "id").limit(50)


def a30_points(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("points"))


def a31_unread(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "view").alias("unread"), F.count_if(kind == "error").alias("failed"), F.count("*").alias("total"))


def a32_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def d01_day_start(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", kst_day_start("ts").alias("day_start"), (kst_day_start("ts") - F.expr("INTERVAL 6 DAYS")).alias("week_start"))


def f06_bot_filter(spark, sf_dir):
    return visits(spark, sf_dir).where(~T.is_bot(F.col("user_agent"))).groupBy("user_agent").agg(F.count("*").alias("n"))


def f13_external_traffic(spark, sf_dir):
    return _external(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("visitor").alias("visitors"))


def f14_ignored_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/?#]*(/[^?#]*)?", 1).alias("path"))
    clean = F.when(F.col("path") == "", "/").otherwise(F.substring("path", 1, 200))
    return p.select("page_id", clean.alias("path")).where(~F.col("path").rlike(r"^/(admin|api|_next|favicon)(/|$)"))


def w04_session_edges(spark, sf_dir):
    v = visits(spark, sf_dir)
    return v.groupBy("session").agg(F.min_by("path", F.struct("ts", "event_id")).alias("first_path"), F.max_by("path", F.struct("ts", "event_id")).alias("last_path"))


def z32_dashboard(spark, sf_dir):
    v = visits(spark, sf_dir).select("visitor", "session", _actor().alias("actor"), T.platform(F.col("user_agent"), F.col("utm") == "app").alias("platform"), "path", F.col("day").cast("string").alias("day"))
    return T.measures(v, [["actor"], ["platform"], ["path"], ["day"]])


_KEYED = "count(DISTINCT visitor) AS visitors, count(DISTINCT session) AS sessions, count(*) AS pageviews"
_TODAY = "day = CAST(TIMESTAMP '2024-01-29 16:00:00' + INTERVAL 9 HOUR AS DATE)"

QUERIES = {
    "a02_popular_keywords": a02_popular_keywords, "a03_traffic_overview": a03_traffic_overview, "a04_traffic_overview_unfiltered": a04_traffic_overview_unfiltered,
    "a05_traffic_daily": a05_traffic_daily, "a05_traffic_by_actor": _by(_actor), "a05_traffic_by_page": _by(lambda: F.col("path")),
    "a06_first_touch": a06_first_touch, "a07_top_pages": a07_top_pages, "a08_item_counts": a08_item_counts, "a09_engagement_report": a09_engagement_report,
    "a10_popularity": a10_popularity, "a30_points": a30_points, "a31_unread": a31_unread, "a32_histogram": a32_histogram, "d01_day_start": d01_day_start,
    "f06_bot_filter": f06_bot_filter, "f13_external_traffic": f13_external_traffic, "f14_ignored_paths": f14_ignored_paths, "w04_session_edges": w04_session_edges,
    "z20_visit_actor": _by(_actor), "z21_source_label": _by(_source), "z22_platform": _by(lambda: T.platform(F.col("user_agent"), F.col("utm") == "app")), "z32_dashboard": z32_dashboard,
}
_BY = lambda key: f"SELECT {key} AS key, {_KEYED} FROM {_V} GROUP BY 1"
SQL = {
    "a02_popular_keywords": f"SELECT trim(props) AS keyword, count(*) AS searches FROM events WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 DAY AND trim(props) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "a03_traffic_overview": f"""SELECT count(*) AS pageviews, count(DISTINCT visitor) AS visitors, count(DISTINCT session) AS sessions, count(*) FILTER ({_TODAY}) AS today_pageviews,
        count(DISTINCT visitor) FILTER ({_TODAY}) AS today_visitors, count(DISTINCT session) FILTER ({_TODAY}) AS today_sessions, min(ts) AS first_at, max(ts) AS last_at FROM {_EXT}""",
    "a04_traffic_overview_unfiltered": f"SELECT count(*) AS pageviews, count(DISTINCT visitor) AS visitors, count(*) FILTER ({_TODAY}) AS today_pageviews, count(DISTINCT visitor) FILTER ({_TODAY}) AS today_visitors FROM {_V}",
    "a05_traffic_daily": f"SELECT CAST(day AS VARCHAR) AS day, {_KEYED} FROM {_V} WHERE path <> 'error' GROUP BY 1 ORDER BY 1",
    "a05_traffic_by_actor": _BY(_ACTOR), "a05_traffic_by_page": _BY("path"),
    "a06_first_touch": f"""SELECT source, path AS landing, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS pageviews FROM (SELECT {_SOURCE} AS source, path, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS r,
        count(*) OVER (PARTITION BY session) AS n FROM {_V}) WHERE r = 1 GROUP BY 1, 2""",
    "a07_top_pages": "SELECT props, count(*) AS pageviews, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20",
    "a08_item_counts": f"SELECT * FROM {_PER}",
    "a09_engagement_report": f"""SELECT *, views + 3 * clicks + 5 * favorites AS engagement, round(coalesce(100.0 * clicks / nullif(views, 0), 0), 4) AS ctr, round(coalesce(100.0 * favorites / nullif(views, 0), 0), 4) AS save_rate
        FROM (SELECT status, count(*) AS items, CAST(sum(views) AS BIGINT) AS views, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(favorites) AS BIGINT) AS favorites FROM {_PER} GROUP BY 1)""",
    "a10_popularity": f"SELECT id, views + 2 * clicks + 3 * favorites AS popularity FROM {_PER} ORDER BY 2 DESC, 1 LIMIT 50",
    "a30_points": "SELECT user_id, round(sum(value), 4) AS points FROM events GROUP BY 1",
    "a31_unread": "SELECT user_id, count(*) FILTER (event_type = 'view') AS unread, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY 1",
    "a32_histogram": "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1",
    "d01_day_start": "SELECT event_id, date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS day_start, date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR - INTERVAL 6 DAY AS week_start FROM events",
    "f06_bot_filter": f"SELECT user_agent, count(*) AS n FROM {_V} WHERE NOT {_BOT} GROUP BY 1",
    "f13_external_traffic": f"SELECT path, count(*) AS n, count(DISTINCT visitor) AS visitors FROM {_EXT} GROUP BY 1",
    "f14_ignored_paths": "SELECT * FROM (SELECT page_id, CASE WHEN p = '' THEN '/' ELSE substring(p, 1, 200) END AS path FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)?', 1) AS p FROM pages)) WHERE NOT regexp_matches(path, '^/(admin|api|_next|favicon)(/|$)')",
    "w04_session_edges": f"SELECT session, arg_min(path, (ts, event_id)) AS first_path, arg_max(path, (ts, event_id)) AS last_path FROM {_V} GROUP BY 1",
    "z20_visit_actor": _BY(_ACTOR), "z21_source_label": _BY(_SOURCE), "z22_platform": _BY(_PLATFORM),
    "z32_dashboard": f"SELECT actor, platform, path, day, {_KEYED} FROM (SELECT * REPLACE (CAST(day AS VARCHAR) AS day), {_ACTOR} AS actor, {_PLATFORM} AS platform FROM {_V}) GROUP BY GROUPING SETS ((actor), (platform), (path), (day))",
}
