"""Visits: who came, from where, on what, and how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.dates import kst_date

# User agents of crawlers, of automation, of tablets and of phones.
BOTS = "bot|crawler|spider|slurp|facebookexternalhit|kakaotalk-scrap|naverbot|googlebot"
AUTOMATION = "headlesschrome|playwright|puppeteer|selenium|phantomjs|webdriver|codex|chatgpt|openai"
TABLETS = "ipad|tablet|kindle|silk|playbook"
PHONES = "mobi|iphone|ipod|android.*mobile|windows phone|blackberry"
# Hosts and the source they stand for, the first that fits.
SOURCES = (
    (("google.",), "Google"), (("naver.",), "Naver"), (("daum.net", "kakao."), "Daum/Kakao"), (("instagram.",), "Instagram"),
    (("facebook.", "fb."), "Facebook"), (("threads.",), "Threads"), (("x.com", "twitter."), "X/Twitter"), (("youtube.",), "YouTube"),
)
DIRECT = "direct"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_bot(user_agent: Column) -> Column:
    return F.coalesce(user_agent, F.lit("")).rlike(f"(?i){BOTS}")


def automation_source(user_agent: Column, webdriver: Column, explicit: Column) -> Column:
    """What tells an automated visit: a named source, a crawler's or automation's agent; null for people."""
    agent = F.coalesce(user_agent, F.lit(""))
    return (
        F.when(_blank_to_null(explicit).isNotNull(), F.substring(F.trim(explicit), 1, 80)).when(is_bot(agent), "bot-user-agent")
        .when(F.coalesce(webdriver, F.lit(False)), "webdriver").when(agent.rlike(f"(?i){AUTOMATION}"), "automation-user-agent")
    )


def actor(role: Column, automated: Column, bot: Column, stored: Column) -> Column:
    """A visit's actor: role beats automation, which beats what was stored."""
    return (
        F.when(role.isin("admin", "super_admin"), "admin").when(role == "operator", "operator").when(role == "user", "member")
        .when(bot, "bot").when(automated, "automation").when(stored.isin("visitor", "automation", "bot"), stored).otherwise("visitor")
    )


def source_label(utm_source: Column, referrer: Column, own_hosts: tuple[str, ...]) -> Column:
    host = F.regexp_replace(F.lower(F.coalesce(referrer, F.lit(""))), r"^www\.", "")
    label = F.when(_blank_to_null(utm_source).isNotNull(), F.trim(utm_source)).when((host == "") | host.isin(*own_hosts), DIRECT)
    for parts, name in SOURCES:
        found = F.lit(False)
        for part in parts:
            found = found | F.contains(host, F.lit(part))
        label = label.when(found, name)
    return label.otherwise(host)


def platform(user_agent: Column, in_app: Column) -> Column:
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    return (
        F.when(F.coalesce(in_app, F.lit(False)), "app").when(agent.rlike(BOTS), "bot").when(agent.rlike(TABLETS), "tablet_web")
        .when(agent.rlike(PHONES), "mobile_web").when(agent != "", "desktop_web").otherwise("unknown")
    )


def external(visits: DataFrame, automated: Column, role: Column) -> DataFrame:
    """Visits of people from outside: no automation, no admin or operator."""
    return visits.where(~F.coalesce(automated, F.lit(False)) & ~F.coalesce(role.isin("admin", "super_admin", "operator"), F.lit(False)))


def overview(visits: DataFrame, today: str) -> DataFrame:
    """One row of eight measures over (ts, visitor, session); today: a UTC instant, whose Korean day counts as the
    current one. Distinct counts are taken from visitors' sessions, not from single visits."""
    now = kst_date(F.lit(today).cast("timestamp_ntz"))
    each = visits.groupBy("visitor", "session").agg(F.count("*").alias("n"), F.count_if(kst_date("ts") == now).alias("today"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    only = lambda k: F.count_distinct(F.when(F.col("today") > 0, F.col(k)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(
        total("n").alias("pageviews"), F.count_distinct("visitor").alias("visitors"), F.count_distinct("session").alias("sessions"),
        total("today").alias("today_pageviews"), only("visitor").alias("today_visitors"), only("session").alias("today_sessions"),
        F.min("first").alias("first_at"), F.max("last").alias("last_at"),
    )


def breakdown(visits: DataFrame, key: Column) -> DataFrame:
    """(key, visitors, sessions, pageviews) over (visitor, session)."""
    return measures(visits.withColumn("key", key), [["key"]])


def measures(visits: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(keys of all sets, visitors, sessions, pageviews) for each value of each set of keys. Visits are first added up for
    each session under its keys, so that neither the sets nor the distinct counts multiply single visits."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    each = visits.groupBy(*keys, "visitor", "session").agg(F.count("*").alias("n"))
    rows = each.groupBy(*keys) if sets == [keys] else each.groupingSets(sets, *keys)
    return rows.agg(F.count_distinct("visitor").alias("visitors"), F.count_distinct("session").alias("sessions"), F.sum("n").alias("pageviews"))


def first_touch(visits: DataFrame, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """(session, source, landing, pageviews): what a session's first row shows."""
    first = F.min(F.struct(order, tie, "source", "path")).alias("first")
    return visits.groupBy("session").agg(first, F.count("*").alias("pageviews")).select("session", F.col("first.source").alias("source"), F.col("first.path").alias("landing"), "pageviews")


def top(rows: DataFrame, measure: str, tie: str, k: int = 20) -> DataFrame:
    return rows.orderBy(F.desc(measure), tie).limit(k)


def engagement(views: Column, clicks: Column, favorites: Column) -> Column:
    """The operators' report's weights; the list's popularity has its own."""
    return views + 3 * clicks + 5 * favorites


def popularity(views: Column, clicks: Column, favorites: Column) -> Column:
    return views + 2 * clicks + 3 * favorites
