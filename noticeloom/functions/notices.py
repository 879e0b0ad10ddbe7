"""What a notice's free text says: its application period, labelled fields and readable lines."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words for open-ended periods, and lines of boards and forms that aren't content.
ALWAYS_OPEN = r"상시(\s*모집|\s*접수)?|연중(?!무휴)"
UNTIL_EXHAUSTED = r"예산\s*소진\s*시|소진\s*시까지|소진\s*시\s*마감|조기\s*마감(될\s*수\s*있음)?"
NOISE_LINES = (
    r"^(목록|공유|첨부파일|이전글|다음글|조회수|작성자|관리자|번호|제목|공지사항|등록일|담당부서|담당자|상세정보|상세보기|상세내용|본문보기)$", r"^첨부파일\s*[:：]?", r"^이전글|^다음글|^목록\s*보기",
    r"^(facebook|twitter|kakaotalk|url\s*copy|rss)$", r"^(Google Forms|Forms 개선|양식이 의심스러운가요|이 설문지는)",
)
# How the days of a period are written, with a year or without.
_TOKEN = r"([0-9]{4}\s*[.\-/년]\s*[0-9]{1,2}\s*[.\-/월]\s*[0-9]{1,2}|[0-9]{1,2}\s*[.\-/월]\s*[0-9]{1,2}\s*일?(?!\s*[0-9]))"


def period(text: Column, posted: Column) -> Column:
    """struct(start, end, kind): the application period in a text, seen from the day it was posted.

    Open-ended words come first. Of dates, two or more are a range of the first two, one is the end. A date
    without a year is in the year of posting, or the next one if that lies over 60 days before it.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    plain = F.transform(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s일]", ""), r"[.\-/년월]", "-"))

    def resolved(token: Column) -> Column:
        dated = token.rlike("^[0-9]{4}-")
        day = F.try_to_timestamp(F.when(dated, token).otherwise(F.concat(F.year(posted).cast("string"), F.lit("-"), token)), F.lit("y-M-d")).cast("date")
        return F.when(~dated & (day < F.date_sub(posted, 60)), F.add_months(day, 12)).otherwise(day)

    days = F.array_compact(F.transform(plain, resolved))
    none = F.lit(None).cast("date")
    made = lambda start, end, kind: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
    return (
        F.when(t.rlike(ALWAYS_OPEN), made(none, none, "ongoing")).when(t.rlike(UNTIL_EXHAUSTED), made(F.get(days, F.lit(0)), none, "until_exhausted"))
        .when(F.size(days) >= 2, made(F.get(days, F.lit(0)), F.get(days, F.lit(1)), "fixed")).when(F.size(days) == 1, made(none, F.get(days, F.lit(0)), "fixed"))
    )


def labelled(text: Column, labels: tuple[str, ...]) -> Column:
    """What follows a label and a colon on its line; of several labels the longest is tried first."""
    names = "|".join(sorted(labels, key=lambda x: (-len(x), x)))
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^[^\p{{L}}\n]*(?:{names})\s*[:：]\s*([^\n]+)", 1)), F.lit(""))


def clean_lines(text: Column) -> Column:
    """The lines of a text without noise, each once, whatever the case of its letters; the first stays."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: (x != "") & ~reduce(Column.__or__, [x.rlike("(?i)" + p) for p in NOISE_LINES]))
    both = F.transform(F.array(lines), lambda xs: F.struct(xs.alias("lines"), F.transform(xs, lambda x: F.lower(x)).alias("lower")))  # worked out once
    first = F.transform(both, lambda b: F.filter(b["lines"], lambda x, i: F.array_position(b["lower"], F.lower(x)) == i + 1))
    return F.array_join(F.get(first, 0), "\n")


def decoded(data: Column, content_type: Column) -> Column:
    """Bytes of a page as text, by the character set of its content type or of its first 2048 bytes; UTF-8 where
    neither names one that is known. What can't be decoded becomes U+FFFD."""
    @F.pandas_udf(T.StringType())
    def text(pages: pd.Series, kinds: pd.Series) -> pd.Series:
        import codecs
        import re

        out = []
        for page, kind in zip(pages, kinds):
            if page is None:
                out.append(None)
                continue
            found = re.search(r"charset=([^\s;]+)", kind or "", re.I) or re.search(r"charset=[\"']?([^\s\"';>]+)", bytes(page[:2048]).decode("ascii", "replace"), re.I)
            try:
                name = codecs.lookup(found[1]).name if found else "utf-8"
            except LookupError:
                name = "utf-8"
            out.append(bytes(page).decode(name, "replace"))
        return pd.Series(out, dtype=object)

    return text(data, content_type)
