"""Which images of a notice can be its poster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of addresses of page furniture, and words in addresses and texts that speak for a poster.
FURNITURE = (
    r"(?i)(?:^|[/$_.-])(?:logo|icon|favicon|sprite|btn|button|sns|kakao|wa[_-]?mark)(?:[/$_.-]|$)|(?:^|[/$_.-])(?:bul|bg)[_-]|addfile|anyboard/skin|skin001"
    r"|web[_-]?accessibility|accessibility[_-]?mark|wa[_-]?cert|wa[_-]?logo|calendar|schedule|timetable|facebook|twitter|instagram|youtube|naver_blog"
    r"|웹\s*접근성|접근성\s*인증|품질\s*인증|인증\s*마크|대체\s*텍스트|캘린더|달력|스케줄|시간표|일정표"
)
POSTER_URL = r"(?i)poster|flyer|notice|event|program|recruit|banner|popup|attach|atch|getimg|file"
POSTER_TEXT = r"(?i)모집|신청|접수|행사|교육|강좌|공고|안내|지원|참여|프로그램|축제|캠페인|채용|대상|문의|기간|poster|flyer|event|program|recruit|notice|announcement|campaign"
#: Points from which an image passes.
LEAST = 45


def image_score(url: Column, text: Column, preferred: Column, content_type: Column, size: Column, width: Column, height: Column) -> Column:
    """0 to 100 points for an image by its address, its notice's text, type, bytes and shape. Null type, size and
    dimensions are unknown. Furniture, things that aren't images, and small shapes like certification marks get 0."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    ratio = width / F.nullif(height, F.lit(0))
    kind, wanted = F.lower(F.coalesce(content_type, F.lit(""))), sure(preferred)
    measured = width.isNotNull() & height.isNotNull()
    image = kind.startswith("image/")
    mark = sure(ratio.between(1.35, 2.25) & (width <= 599) & (height <= 399)) & ~wanted
    points = [
        F.when(sure(url.rlike(POSTER_URL)), 10), F.when(wanted, 15), F.when(sure(text.rlike(POSTER_TEXT)), 15), F.when((kind != "") & ~image & measured, 8), F.when(kind == "image/svg+xml", -30),
        F.when(measured, F.when((width < 220) | (height < 220) | (width * height < 90000), -45).when((width >= 300) & (height >= 400), 20).otherwise(8)),
        F.when(measured, F.when(ratio.between(0.45, 1.15), 18).when((ratio > 1.15) & (ratio <= 1.9), 6).otherwise(-25)),
        F.when(size.between(1, 11999), -20).when(size >= 50000, 8),
    ]
    total = reduce(Column.__add__, [F.coalesce(p, F.lit(0)) for p in points], F.lit(30))
    never = (F.coalesce(url, F.lit("")) == "") | sure(url.rlike(FURNITURE)) | ((kind != "") & ~image & ~measured) | mark
    return F.when(never, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("int")


def strong_portrait(proxy: Column, width: Column, height: Column) -> Column:
    """Whether an image is a tall original of good size."""
    return ~proxy & F.coalesce((width >= 600) & (height >= 700) & (width / F.nullif(height, F.lit(0))).between(0.45, 0.9), F.lit(False))
