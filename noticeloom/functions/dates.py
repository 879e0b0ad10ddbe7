"""Korean calendar days on UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Korea has kept UTC+9 without daylight saving since 1988.
KST = "INTERVAL 9 HOURS"


def kst(ts: Column | str) -> Column:
    """The Korean wall clock of a UTC timestamp."""
    return (F.col(ts) if isinstance(ts, str) else ts) + F.expr(KST)


def kst_date(ts: Column | str) -> Column:
    return F.to_date(kst(ts))


def kst_day_start(ts: Column | str) -> Column:
    """The UTC instant at which the Korean day of ts began."""
    return F.date_trunc("day", kst(ts)) - F.expr(KST)


def kst_days_left(end: Column, now: Column) -> Column:
    """Korean calendar days from now to the end."""
    return F.datediff(kst_date(end), kst_date(now))


def deadline_type(value: Column) -> Column:
    """fixed, ongoing, until_exhausted or scheduled from a type or its Korean name; else unknown."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(v.isin("fixed", "고정"), "fixed").when(v.isin("ongoing", "상시"), "ongoing")
        .when(v.isin("until_exhausted", "소진시", "소진 시"), "until_exhausted").when(v.isin("scheduled", "예정"), "scheduled").otherwise("unknown")
    )


def application_state(start: Column, end: Column, kind: Column, now: Column) -> Column:
    """A notice's state by Korean days: scheduled before its start, then by the days left, else by its type."""
    left, k = kst_days_left(end, now), deadline_type(kind)
    return (
        F.when(kst_date(start) > kst_date(now), "scheduled").when(left < 0, "closed").when(left == 0, "due_today").when(left <= 3, "closing_soon").when(left.isNotNull(), "open")
        .when(k.isin("ongoing", "until_exhausted", "scheduled"), k).otherwise("needs_confirmation")
    )


def candidate_status(start: Column, end: Column, now: Column) -> Column:
    """before, open or closed; open where neither bound says otherwise."""
    return F.when(end < now, "closed").when(start > now, "before").otherwise("open")


def compact_date(text: Column) -> Column:
    """A date of eight digits; null for anything else and for days that don't exist."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def full_dates(text: Column) -> Column:
    """All dates with a year in a text, in order: array<date>, without days that don't exist."""
    parts = F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2}\s*[.\-/년]\s*[0-9]{1,2}\s*[.\-/월]\s*[0-9]{1,2})"), F.lit(1))
    dates = F.transform(parts, lambda p: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(p, r"\s+", ""), r"[.\-/년월]", "-"), F.lit("y-M-d")).cast("date"))
    return F.array_compact(dates)


def is_stale(text: Column, published: Column, now: Column, always_open: Column) -> Column:
    """Whether a notice is old: its latest year is before last year, or it is over 540 days old."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2})"), F.lit(1)), lambda y: y.cast("int"))
    old = F.coalesce(F.array_max(years) < F.year(now) - 1, F.lit(False)) | F.coalesce(F.datediff(now, published) > 540, F.lit(False))
    return ~F.coalesce(always_open, F.lit(False)) & old


def period_label(start: Column, end: Column) -> Column:
    day = lambda c: F.date_format(kst(c), "yyyy.MM.dd")
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(day(start), F.lit(" ~ "), day(end))).when(end.isNotNull(), F.concat(F.lit("~ "), day(end))).when(start.isNotNull(), F.concat(day(start), F.lit(" ~")))
