"""Application periods in long texts: labelled segments, ranges, deadlines near a keyword, and a verdict on
them. All of it stays in built-in functions; what depends on positions works on segments of bounded length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of application periods and of others, connectors and cue words, lengths.
LABEL = r"(?:신청|접수|모집|응모|지원|등록)\s*(?:기간|기한|마감|일정|방법(?:은)?\s*\??)"
OTHER_LABEL = r"(?:여행|행사|교육|운영|활동|사용|사업|프로그램)\s*(?:기간|일정)"
ALWAYS_OPEN = r"상시\s*(?:모집|접수|신청|운영)?|수시\s*(?:모집|접수|신청)?"
CONNECTOR = r"~|〜|∼|-|부터|에서|까지"
DEADLINE_WORD = r"까지|마감|종료|기한|선착순"
SEGMENT, GAP, NEAR = 260, 12, 30

# How dates are written, and what follows one that begins a range without an end.
_YMD = r"([0-9]{2,4})\s*(?:년|[./-])\s*([0-9]{1,2})\s*(?:월|[./-])\s*([0-9]{1,2})\s*일?\s*\.?"
_DATE = rf"(?<![0-9]){_YMD}\s*(?:\(([월화수목금토일])\))?"
_OPEN_END = r"^(?:\s*\([월화수목금토일]\))?(?:\s*[0-9]{1,2}\s*:\s*[0-9]{2})?\s*(?:~|〜|∼|부터)(?!\s*[‘’']?[0-9]{2,4}\s*(?:년|[./-]))"
_WEEKDAYS = ("일", "월", "화", "수", "목", "금", "토")


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _day(found: Column) -> Column:
    """The date of one match; years of two digits from 70 on are in the last century; null if there is no such day."""
    year, month, day = (F.regexp_extract(found, _DATE, i) for i in (1, 2, 3))
    full = F.when(F.length(year) == 2, F.concat(F.when(year >= "70", "19").otherwise("20"), year)).otherwise(F.lpad(year, 4, "0"))
    return F.try_to_timestamp(F.concat_ws("-", full, month, day), F.lit("yyyy-M-d")).cast("date")


def plain_date(text: Column) -> Column:
    """The first full date of a short text; null where it has none."""
    return F.when(text.rlike(_DATE), _day(F.regexp_extract(text, _DATE, 0)))


def _dates(segment: Column) -> Column:
    """array<struct<day, start, end, after>> of a segment's dates: places, and the text up to the next one."""
    length = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))

    def placed(p: Column) -> Column:
        at = F.transform(p["raw"], lambda t, i: F.struct(_day(t).alias("day"), (length(p["gaps"], i + 1) + length(p["raw"], i)).alias("start"), F.length(t).alias("n"), F.get(p["gaps"], i + 1).alias("after")))
        return F.transform(at, lambda d: F.struct(d["day"].alias("day"), d["start"].alias("start"), (d["start"] + d["n"]).alias("end"), d["after"].alias("after")))

    return _let(F.struct(F.regexp_extract_all(segment, F.lit(_DATE), F.lit(0)).alias("raw"), F.split(segment, _DATE).alias("gaps")), placed)


def segments(text: Column) -> Column:
    """array<string>: from each label of an application period on, at most SEGMENT characters, up to another period's label."""
    both = F.lit(rf"(?is)({LABEL})(?=(.{{0,{SEGMENT}}}))")
    zipped = F.arrays_zip(F.regexp_extract_all(text, both, F.lit(1)).alias("head"), F.regexp_extract_all(text, both, F.lit(2)).alias("tail"))
    return F.transform(zipped, lambda z: F.concat(z["head"], F.regexp_replace(F.substr(z["tail"], F.lit(1), SEGMENT - F.length(z["head"])), rf"(?is){OTHER_LABEL}.*$", "")))


def open_ended(segment: Column) -> Column:
    """Whether a segment's first date begins a range without an end."""
    first = F.get(F.filter(_dates(segment), lambda d: d["day"].isNotNull()), F.lit(0))
    tail = F.substr(segment, first["end"] + 1, F.lit(40))
    return F.coalesce(tail.rlike(_OPEN_END), F.lit(False))


def _tight(gap: Column) -> Column:
    """Whether what lies between two dates only joins them."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(gap, r"[0-9]{1,2}\s*:\s*[0-9]{2}", " "), r"\([월화수목금토일]\)", " "))
    return (F.length(rest) <= GAP) & ~rest.rlike("[0-9]") & rest.rlike(CONNECTOR)


def _period(segment: Column) -> Column:
    word = F.length(F.regexp_extract(segment, rf"(?s)^(.*?)(?:{DEADLINE_WORD})", 1))

    def joined(dates: Column) -> Column:
        pairs = F.transform(dates, lambda d, i: F.struct(d["day"].alias("start"), F.get(dates, i + 1)["day"].alias("end"), d["after"].alias("gap")))
        first = F.get(F.filter(pairs, lambda p: p["start"].isNotNull() & p["end"].isNotNull() & _tight(p["gap"])), F.lit(0))
        return F.when(first.isNotNull(), F.struct(first["start"].alias("start"), first["end"].alias("end")))

    def single(dates: Column) -> Column:
        far = F.transform(F.filter(dates, lambda d: d["day"].isNotNull()), lambda d: F.struct(F.when(d["end"] <= word, word - d["end"]).otherwise(d["start"] - word).alias("far"), d["start"].alias("start"), d["day"].alias("day")))
        nearest = F.array_min(F.filter(far, lambda d: d["far"].between(0, NEAR)))["day"]
        return F.when(segment.rlike(DEADLINE_WORD) & nearest.isNotNull() & ~open_ended(segment), F.struct(F.lit(None).cast("date").alias("start"), nearest.alias("end")))

    return _let(_dates(segment), lambda dates: F.coalesce(joined(dates), single(dates)))


def _period_in(parts: Column) -> Column:
    return F.get(F.array_compact(F.transform(parts, _period)), F.lit(0))


def application_period(text: Column) -> Column:
    """struct(start, end) of the first segment that tells one: two dates joined as a range, or the date nearest to a
    word for a deadline. Null where none does."""
    return _period_in(segments(text))


def date_issues(text: Column, deadline: Column, parts: Column, period: Column) -> Column:
    """array<string>: what is doubtful about a notice's dates. parts: segments(text); period: application_period(text)."""
    known, end = plain_date(deadline), period["end"]
    given = F.coalesce(F.trim(deadline), F.lit("")) != ""
    dates = F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))
    weekday = lambda d: F.element_at(F.array(*map(F.lit, _WEEKDAYS)), F.dayofweek(_day(d)))
    stripped = lambda s: F.regexp_replace(s, rf"(?:^|[^0-9]){_YMD}", " ")
    sure = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        ("invalid-extracted-deadline", given & known.isNull()),
        ("weekday-mismatch", F.exists(dates, lambda d: sure((F.regexp_extract(d, _DATE, 4) != "") & (F.regexp_extract(d, _DATE, 4) != weekday(d))))),
        ("open-ended-application-period", period.isNull() & F.exists(parts, open_ended)),
        ("date-without-year", F.exists(parts, lambda s: stripped(s).rlike(r"(?:^|[^0-9])[0-9]{1,2}\s*(?:월|[./-])\s*[0-9]{1,2}\s*일?"))),
        ("default-midnight-time", F.exists(parts, lambda s: s.rlike(r"(?:^|[^0-9])00\s*:\s*00(?:[^0-9]|$)"))),
        ("date-end-before-start", sure(end < period["start"])), ("always-open-conflict", text.rlike(ALWAYS_OPEN) & end.isNotNull()),
        ("deadline-mismatch", sure(known != end)), ("missing-clear-deadline", known.isNull() & end.isNotNull()),
        ("ambiguous-multiple-dates", period.isNull() & (F.size(F.filter(dates, lambda d: _day(d).isNotNull())) >= 3)),
    ]
    return F.array_compact(F.array(*[F.when(sure(c), name) for name, c in checks]))


def date_quality(text: Column, deadline: Column) -> Column:
    """struct(issues, suggested, stored): the doubts, the deadline that the text gives, and the one to keep: the text's,
    else the extracted one unless a doubt speaks against it. A null text has no dates."""
    t, known = F.coalesce(text, F.lit("")), plain_date(deadline)

    def verdict(found: Column) -> Column:
        end = found["period"]["end"]
        forward = F.coalesce(end >= found["period"]["start"], F.lit(True))
        suggested = F.when(forward | known.isNull() | (known != end), end)
        blocked = F.arrays_overlap(found["issues"], F.array(*map(F.lit, ("invalid-extracted-deadline", "date-end-before-start", "open-ended-application-period"))))
        return F.struct(found["issues"].alias("issues"), suggested.alias("suggested"), F.coalesce(suggested, F.when(~blocked, known)).alias("stored"))

    with_period = _let(segments(t), lambda parts: F.struct(parts.alias("parts"), _period_in(parts).alias("period")))
    with_issues = _let(with_period, lambda f: F.struct(f["period"].alias("period"), date_issues(t, deadline, f["parts"], f["period"]).alias("issues")))
    return _let(with_issues, verdict)
