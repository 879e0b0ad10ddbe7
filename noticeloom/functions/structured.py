"""A notice's structured fields and its readable summary, put together from what is known about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.facts import usable_fact

# Open-ended and planned periods; the labels of the six facts, in the order of a summary; lengths.
ONGOING, EXHAUSTED, PLANNED = r"(?:상시|수시)\s*(?:모집|접수|신청|운영)", r"(?:예산|재원|인원)?\s*소진\s*시", r"(?:모집|접수|신청)\s*(?:예정|추후\s*공고)"
KINDS_OF_DEADLINE = ("fixed", "ongoing", "until_exhausted", "scheduled")
SUMMARY = (("대상", "target"), ("기간", "period"), ("내용", "content"), ("신청", "application"), ("장소", "location"), ("문의", "contact"))
SHORT, FACT, TELLING, SENTENCE = 300, 120, 16, 40
BOARD_LINES = r"(목록|공유|첨부파일|이전글|다음글)"
# How application periods are written, with an end that may leave out year and month.
_LEAD = r"(?:신청기간|접수기간|모집기간|신청\s*[:：]|접수\s*[:：]|모집\s*[:：])[^0-9]{0,40}"
_SHORT_RANGE = _LEAD + r"[‘’']?([0-9]{2,4})\s*[-./년]\s*([0-9]{1,2})\s*[-./월]\s*([0-9]{1,2})\s*[-./일]?(?:\s*\([^)]*\))?(?:\s*[0-9]{1,2}:[0-9]{2})?\s*(?:~|[-–—]|부터)\s*(?:[‘’']?([0-9]{2,4})\s*[-./년]\s*)?(?:([0-9]{1,2})\s*[-./월]\s*)?([0-9]{1,2})"
_PERIOD_NAMED = r"신청기간|접수기간|모집기간"
_UNTIL = r"(20[0-9]{2})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일?\s*(?:까지|마감)"


def first_text(*values: Column, most: int) -> Column:
    """The first value that isn't blank, on one line, cut to a length; null for none."""
    tidy = [F.nullif(F.trim(F.regexp_replace(v, r"\s+", " ")), F.lit("")) for v in values]
    return F.left(F.coalesce(*tidy), F.lit(most))


def deadline_kind(declared: Column, end: Column, period: Column, text: Column) -> Column:
    """The declared kind of deadline where it is one, else what the period and the text say, else whether there is an end."""
    both = F.concat_ws(" ", F.coalesce(period, F.lit("")), F.coalesce(text, F.lit("")))
    said = lambda b: F.when(b.rlike(ONGOING), "ongoing").when(b.rlike(EXHAUSTED), "until_exhausted").when(end.isNotNull(), "fixed").when(b.rlike(PLANNED), "scheduled").otherwise("unknown")
    return F.when(declared.isin(*KINDS_OF_DEADLINE), declared).otherwise(F.get(F.transform(F.array(both), said), 0))  # with both worked out once


def structured_fields(n: dict[str, Column], facts: Column, guessed: Column) -> dict[str, Column]:
    """The fields of a notice. n: organizer, display_org, corrected_org, fallback_org, application_org, deadline_type, start, end,
    text, target, support, confidence, org_confidence, status. facts: map of them; guessed: the names of those that a model
    filled in, which don't count. Null values are unknown; a confidence is brought between 0 and 1."""
    def fact(name: str) -> Column:
        return F.when(~F.coalesce(F.array_contains(guessed, name), F.lit(False)), F.element_at(facts, F.lit(name)))

    def safe(key: str, most: int, *values: Column) -> Column:
        return F.left(F.coalesce(*[usable_fact(v, key) for v in values]), F.lit(most))

    period = usable_fact(fact("period"), "period")
    return {
        "organizer_name": first_text(n["organizer"], n["display_org"], n["corrected_org"], n["fallback_org"], most=300), "application_organization_name": first_text(n["application_org"], most=300),
        "deadline_type": deadline_kind(n["deadline_type"], n["end"], period, n["text"]), "application_start_at": n["start"], "application_end_at": n["end"],
        "eligibility_summary": safe("target", 2000, n["target"], fact("target")), "benefits_summary": safe("content", 4000, n["support"], fact("benefits"), fact("content")),
        "application_method": safe("application", 4000, fact("application")), "contact_info": safe("contact", 1000, fact("contact")), "event_location": safe("location", 1000, fact("location")),
        "verification_status": F.coalesce(n["status"], F.lit("needs_review")), "data_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(n["confidence"], n["org_confidence"]))),
    }


def _clipped(value: Column) -> Column:
    """A fact of at most FACT characters, cut after its last sentence where that leaves enough."""
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    head = F.left(flat, F.lit(FACT))
    whole = F.regexp_extract(head, r"(?s)^(.*[.。,])", 1)
    return F.when(F.length(flat) <= FACT, flat).otherwise(F.concat(F.trim(F.when(F.length(whole) > SENTENCE, whole).otherwise(head)), F.lit("...")))


def short_summary(title: Column, lines: Column, facts: dict[str, Column]) -> Column:
    """A notice in at most SHORT characters: its labelled facts, without those that repeat an earlier one; without facts its
    first lines of substance; else its content or title. lines: array of its cleaned lines."""
    bare = lambda v: F.lower(F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))
    known = F.filter(F.array(*[F.struct(F.lit(label).alias("label"), facts[key].alias("value"), bare(facts[key]).alias("bare")) for label, key in SUMMARY]), lambda f: F.coalesce(f["value"], F.lit("")) != "")

    def added(kept: Column, fact: Column) -> Column:
        repeats = F.exists(kept, lambda k: (F.length(k["bare"]) >= TELLING) & (F.contains(fact["bare"], k["bare"]) | F.contains(k["bare"], fact["bare"])))
        return F.when((F.length(fact["bare"]) >= TELLING) & repeats, kept).otherwise(F.concat(kept, F.array(fact)))

    kept = F.aggregate(known, F.filter(known, lambda _: F.lit(False)), added)
    told = F.array_join(F.transform(kept, lambda k: F.concat(k["label"], F.lit(": "), _clipped(k["value"]))), " · ")
    plain = F.slice(F.filter(lines, lambda x: (F.length(x) >= 12) & ~x.rlike(BOARD_LINES)), 1, 3)
    other = F.coalesce(F.nullif(F.array_join(plain, " · "), F.lit("")), F.nullif(F.array_join(lines, "\n"), F.lit("")), title)
    cut = F.when(F.length(other) > SHORT, F.concat(F.trim(F.left(other, F.lit(SHORT - 3))), F.lit("..."))).otherwise(other)
    return F.when(F.size(kept) > 0, F.left(told, F.lit(SHORT))).otherwise(cut)


def _day(year: Column, month: Column, day: Column) -> Column:
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.try_to_timestamp(F.concat_ws("-", full, month, day), F.lit("yyyy-M-d")).cast("date")


def deadline(text: Column) -> Column:
    """The end of an application period that is named in a text, also where the end leaves out what it shares with the start;
    without a named period, a day that is called the last one. Null for none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    part = lambda i: F.regexp_extract(t, _SHORT_RANGE, i)
    shared = lambda own, start: F.when(part(own) != "", part(own)).otherwise(part(start))
    ranged = F.when(t.rlike(_SHORT_RANGE), _day(shared(4, 1), shared(5, 2), part(6)))
    single = F.when(~t.rlike(_PERIOD_NAMED) & t.rlike(_UNTIL), _day(*(F.regexp_extract(t, _UNTIL, i) for i in (1, 2, 3))))
    return F.coalesce(ranged, single)


# Titles that are controls of a page, and what is cut from titles' ends.
_CONTROLS, _TAIL = r"(?i)^(logo|home|menu|search|skip navigation|본문 바로가기)$", r"(?i)\s*(?:페이지\s*이동|새창(?:으로)?\s*열림|상세\s*보기|자세히\s*보기)\s*$"


def clean_title(title: Column, site: Column) -> Column:
    """A title without its label, links' hints and a date at its end; '' where it is no more than these, or names a control,
    the site or a path."""
    flat = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"^제목\s*:\s*", ""), _TAIL, ""), r"(?:^|\s+)[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}\s*$", "")
    t = F.trim(t)
    bad = [flat.rlike(_CONTROLS), t.rlike(_CONTROLS), F.length(t) < 4, F.coalesce(t == site, F.lit(False)), t.rlike(r"^[^/]+(?:\s*/\s*[^/]+){2,}$"), t.rlike(r"상세보기|공지사항\s*\|")]
    return F.when(reduce(Column.__or__, bad), "").otherwise(t)


def specific_title(title: Column, content: Column, attachments: Column, generic: str) -> Column:
    """A title that names its notice: where the given one is generic (a pattern), the first name that the content has in
    quotation marks, else that of the first attachment without its ending; else the title itself."""
    quoted = F.nullif(F.trim(F.regexp_extract(F.coalesce(content, F.lit("")), r"[「『“‘<\[]([^」』”’>\]\n]{4,60})[」』”’>\]]", 1)), F.lit(""))
    file = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.get(attachments, 0), r"\.[A-Za-z0-9]{2,5}$", ""), r"[_\s]+", " ")), F.lit(""))
    return F.when(F.coalesce(title, F.lit("")).rlike(generic), F.coalesce(quoted, F.when(F.length(file) >= 4, file), title)).otherwise(title)
