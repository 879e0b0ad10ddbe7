"""Rule classifier of notices: categories by weighted words in seven fields, audiences, regions, and what is doubtful about them.

All words of all categories and regions make two automata, built once in a task; each field is read once, whatever the number
of words. What follows from the points is columns.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import squeezed
from noticeloom.sources.work import ship, sliced

# Weights of fields; categories and their words; what a source's own category means.
WEIGHTS = {"title": 5, "category": 6, "summary": 3, "content": 2, "site": 1, "board": 1, "url": 1}
CATEGORIES = {
    "CAT_WELFARE": ("복지", "지원금", "보조금", "수당", "급여", "바우처", "상담", "돌봄", "취약", "장애", "저소득", "고립", "위기", "긴급"),
    "CAT_EDUCATION": ("교육", "취업", "채용", "일자리", "훈련", "강좌", "강의", "수강", "아카데미", "커리어", "직무", "멘토링", "자격증", "인턴", "장학"),
    "CAT_CULTURE": ("문화", "행사", "축제", "전시", "공연", "체험", "클래스", "예술", "미디어", "영화", "음악", "공예", "탐방", "투어", "모임", "콘서트"),
    "CAT_HOUSING": ("주거", "월세", "전세", "임대", "부동산", "대출", "금융", "자금", "신용", "보증", "계좌", "청년월세"),
    "CAT_BUSINESS": ("소상공인", "자영업", "창업", "스타트업", "기업", "중소기업", "입주기업", "액셀러레이팅", "컨설팅", "투자", "사업화", "판로", "마케팅", "IR"),
    "CAT_FAMILY": ("육아", "가족", "부모", "아동", "어린이", "청소년", "보육", "출산", "1인가구", "반려"),
    "CAT_HEALTH": ("건강", "의료", "병원", "검진", "치료", "재활", "운동", "체육", "보건", "심리", "마음", "힐링"),
}
OTHER = "CAT_OTHER"
SOURCE_CATEGORIES = {"채용": "CAT_EDUCATION", "일자리": "CAT_EDUCATION", "교육": "CAT_EDUCATION", "장학": "CAT_EDUCATION", "문화": "CAT_CULTURE", "행사": "CAT_CULTURE", "체육": "CAT_HEALTH", "복지": "CAT_WELFARE", "노동": "CAT_WELFARE",
                     "급식": "CAT_FAMILY", "청소년": "CAT_FAMILY", "안전": "CAT_OTHER", "입법": "CAT_OTHER"}
SOURCE_POINTS = 9
# Audiences and their patterns.
AUDIENCES = {
    "youth": (r"청년(?!몽땅정보통)", r"만\s*19\s*세", r"만\s*34\s*세", r"만\s*39\s*세", r"청년센터", r"청년창업"),
    "teen": (r"청소년", r"중학생", r"고등학생", r"학교\s*밖\s*청소년"),
    "middle_aged": (r"중장년", r"중년", r"40대", r"50대", r"4050"),
    "senior": (r"어르신", r"노인", r"시니어", r"65\s*세\s*이상", r"고령"),
    "child": (r"아동", r"어린이", r"초등학생", r"초등\s*\d?\s*학년"),
    "women": (r"여성", r"새일센터", r"여성새로일하기", r"여성센터"),
    "small_business": (r"소상공인", r"자영업", r"점포", r"상인"),
    "startup": (r"창업기업", r"스타트업", r"벤처", r"예비창업", r"초기창업"),
}
# Regions and their words; words for the whole country and the whole city.
REGIONS = {
    "REG_SEOUL_JONGNO": ("종로구", "종로문화재단", "아름꿈도서관", "원당마을한옥도서관"),
    "REG_SEOUL_JUNG": ("중구", "서울중구", "중구청", "중구가족센터", "서울청년센터 중구"),
    "REG_SEOUL_YONGSAN": ("용산구", "용산청년지음", "용산 청년지음"),
    "REG_SEOUL_SEONGDONG": ("성동구", "성동구청년카페", "서울청년센터 성동"),
    "REG_SEOUL_GWANGJIN": ("광진구", "서울청년센터 광진"),
    "REG_SEOUL_DONGDAEMUN": ("동대문구", "동대문구가족센터", "동대문여성", "청년취업사관학교 동대문"),
    "REG_SEOUL_JUNGNANG": ("중랑구", "중랑청년청", "중랑문화재단"),
    "REG_SEOUL_SEONGBUK": ("성북구", "서울청년센터 성북"),
    "REG_SEOUL_GANGBUK": ("강북구", "서울청년센터 강북"),
    "REG_SEOUL_DOBONG": ("도봉구", "도봉문화정보도서관", "서울청년센터 도봉", "도봉여성센터"),
    "REG_SEOUL_NOWON": ("노원구", "노원청년", "서울청년센터노원"),
    "REG_SEOUL_EUNPYEONG": ("은평구", "서울청년센터 은평"),
    "REG_SEOUL_SEODAEMUN": ("서대문구",),
    "REG_SEOUL_MAPO": ("마포구", "마포청년", "서울청년센터 마포", "마포구가족센터", "마포구청", "구립마포", "망원", "도화청소년", "mapo.go.kr", "mycc.or.kr", "mapojh.or.kr"),
    "REG_SEOUL_YANGCHEON": ("양천구", "서울청년센터 양천"),
    "REG_SEOUL_GANGSEO": ("강서구", "서울청년센터 강서", "강서새일센터"),
    "REG_SEOUL_GURO": ("구로구", "구로청년이룸"),
    "REG_SEOUL_GEUMCHEON": ("금천구", "금천구청", "가산", "독산", "시흥도서관", "금천구 구민정보화교육"),
    "REG_SEOUL_YEONGDEUNGPO": ("영등포구", "영등포청년", "서울청년센터영등포"),
    "REG_SEOUL_DONGJAK": ("동작구",),
    "REG_SEOUL_GWANAK": ("관악구", "서울청년센터 관악", "신림동쓰리룸"),
    "REG_SEOUL_SEOCHO": ("서초구", "서울청년센터 서초", "서초문화재단", "서초1인가구"),
    "REG_SEOUL_GANGNAM": ("강남구", "강남취", "강남청소년", "강남구청"),
    "REG_SEOUL_SONGPA": ("송파구", "송파구청", "송파구가족센터"),
    "REG_SEOUL_GANGDONG": ("강동구", "서울청년센터 강동", "강동중앙도서관"),
}
SCOPES = (("REG_NATION", 0.72, r"전국|온라인|비대면"), ("REG_SEOUL", 0.64, r"서울|서울시|서울특별시|youth\.seoul\.go\.kr"))
LEAST, SECOND_LEAST, SECOND_SHARE, NEAR, UNSURE = 3, 5, 0.65, 2, 0.58


@lru_cache(maxsize=8)
def _automaton(groups: tuple):
    """An automaton over the words of all groups; each word stands for the groups that have it, and itself."""
    import ahocorasick

    words: dict[str, set] = {}
    for k, group in enumerate(groups):
        for w in group:
            words.setdefault(w, set()).add(k)
    made = ahocorasick.Automaton()
    for w, ks in words.items():
        made.add_word(w, (w, tuple(sorted(ks))))
    made.make_automaton()
    return made


def counts_of_words(groups: tuple, text: str) -> list[int]:
    """For each group of words, how many of its words the text holds; one pass over the text."""
    out = [0] * len(groups)
    for _, ks in {hit for _, hit in _automaton(groups).iter(text)} if text else ():
        for k in ks:
            out[k] += 1
    return out


def word_points(fields: dict[str, Column], weights: dict[str, int], groups: dict[str, tuple[str, ...]]) -> Column:
    """array<int>: of each group the weights of the fields that hold a word of it, once for each word; null fields hold none.
    Case matters where words have capitals."""
    ship()
    words, shares = tuple(map(tuple, groups.values())), [weights[f] for f in fields]

    @F.arrow_udf("array<int>")
    def points(*columns: pa.Array) -> pa.Array:
        def of(*lists):
            rows = ([counts_of_words(words, text or "") for text in row] for row in zip(*lists))
            return [[sum(w * n[k] for w, n in zip(shares, each)) for k in range(len(words))] for each in rows]

        return sliced(of, pa.list_(pa.int32()), *columns)

    return points(*fields.values())


def _confidence(score: Column, margin: Column, ambiguous: Column) -> Column:
    raw = 0.42 + F.least(score, F.lit(18)) / 30.0 + F.least(F.greatest(margin, F.lit(0)), F.lit(8)) / 28.0
    return F.greatest(F.lit(0.25), F.least(F.lit(0.95), F.round(F.when(ambiguous, F.least(raw, F.lit(0.58))).otherwise(raw), 2)))


def categories(points: Column, source: Column) -> Column:
    """array<struct<code, score, confidence, ambiguous>>: the category with most points, and a second that is strong in itself and
    near the first; OTHER without any. On ties the source's own category comes first, then the earlier one. points has them in
    the order of CATEGORIES; the source's category adds SOURCE_POINTS to what it means."""
    means = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_CATEGORIES.items() for x in kv]), squeezed(source))
    own = [F.coalesce(means == c, F.lit(False)) for c in CATEGORIES]
    each = F.array(*[F.struct((-F.get(points, k) - F.when(own[k], SOURCE_POINTS).otherwise(0)).alias("n"), F.when(own[k], 0).otherwise(1).alias("later"), F.lit(k).alias("place"), F.lit(c).alias("code")) for k, c in enumerate(CATEGORIES)])
    ranked = F.array_sort(F.filter(each, lambda e: e["n"] <= -LEAST))
    top, second = -F.get(ranked, 0)["n"], F.coalesce(-F.get(ranked, 1)["n"], F.lit(0))
    near = (F.size(ranked) > 1) & (top - second <= NEAR)
    made = lambda i, margin, ambiguous: F.struct(F.get(ranked, i)["code"].alias("code"), (-F.get(ranked, i)["n"]).alias("score"), _confidence(-F.get(ranked, i)["n"], margin, ambiguous).alias("confidence"), ambiguous.alias("ambiguous"))
    first, other = made(0, top - second, near), F.struct(F.lit(OTHER).alias("code"), F.lit(0).alias("score"), F.lit(0.35).alias("confidence"), F.lit(False).alias("ambiguous"))
    both = (second >= SECOND_LEAST) & (second >= SECOND_SHARE * top)
    return F.when(F.size(ranked) == 0, F.array(other)).when(both, F.array(first, made(1, F.lit(0), F.lit(False)))).otherwise(F.array(first))


def audiences(text: Column) -> Column:
    """array<struct<code, confidence>>: whom a text addresses, in the order of AUDIENCES; surer with each further sign, up to four."""
    signs = lambda patterns: F.least(F.lit(4), reduce(Column.__add__, [text.rlike(p).cast("int") for p in patterns]))
    each = F.transform(F.array(*[F.struct(F.lit(a).alias("code"), signs(p).alias("n")) for a, p in AUDIENCES.items()]), lambda a: F.struct(a["code"].alias("code"), F.least(F.lit(0.94), F.round(0.58 + a["n"] * 0.1, 2)).alias("confidence"), a["n"].alias("n")))
    return F.transform(F.filter(each, lambda a: a["n"] > 0), lambda a: F.struct(a["code"].alias("code"), a["confidence"].alias("confidence")))


def regions(text: Column, hits: Column) -> Column:
    """array<struct<code, confidence, ambiguous>>: the two regions with most words of theirs in a text, the earlier of equals; with
    two, both are doubtful. Without any, the whole country or city by a sign of these. hits: words of each of REGIONS."""
    each = F.array(*[F.struct((-F.least(F.get(hits, k), F.lit(4))).alias("n"), F.lit(k).alias("place"), F.lit(r).alias("code")) for k, r in enumerate(REGIONS)])
    ranked = F.slice(F.array_sort(F.filter(each, lambda e: e["n"] < 0)), 1, 2)
    several = F.size(ranked) > 1
    named = F.transform(ranked, lambda e: F.struct(e["code"].alias("code"), F.least(F.when(several, 0.72).otherwise(0.95), F.round(0.68 - 0.07 * e["n"], 2)).alias("confidence"), several.alias("ambiguous")))
    wide = reduce(lambda c, s: c.when(text.rlike(s[2]), F.array(F.struct(F.lit(s[0]).alias("code"), F.lit(s[1]).alias("confidence"), F.lit(False).alias("ambiguous")))), SCOPES, F)
    return F.when(F.size(ranked) > 0, named).otherwise(F.coalesce(wide, named))


def classify_notices(notices: DataFrame) -> DataFrame:
    """(id, categories, regions, audiences, issues, confidence) of notices (id, title, category, summary, content, site, board, url).

    Texts count whole, nulls as blank. issues: low-category-confidence or ambiguous-category, missing-region or
    ambiguous-region. confidence is the least of the first category's, the first region's (0 without one) and the first
    audience's (1 without one). Repeated rows give repeated rows, an empty table none.
    """
    low = {f: F.lower(squeezed(F.col(f))) for f in WEIGHTS}
    join = lambda *names: F.concat_ws(" ", *[F.when(F.col(n) != "", F.col(n)) for n in names])
    lowered = {c: tuple(w.lower() for w in words) for c, words in CATEGORIES.items()}
    d = notices.withColumns({"_points": word_points(low, WEIGHTS, lowered), "_where": join("title", "content", "summary", "site", "board", "category", "url"), "_whom": squeezed(join("title", "summary", "content", "category"))})
    d = d.withColumn("_hits", word_points({"where": F.col("_where")}, {"where": 1}, REGIONS))
    d = d.select("id", categories(F.col("_points"), F.col("category")).alias("categories"), regions(F.col("_where"), F.col("_hits")).alias("regions"), audiences(F.col("_whom")).alias("audiences"))
    c, r, a = F.get("categories", 0), F.get("regions", 0), F.get("audiences", 0)
    doubts = F.array_compact(F.array(
        F.when((c["code"] == OTHER) | (c["confidence"] < UNSURE), "low-category-confidence").when(c["ambiguous"], "ambiguous-category"),
        F.when(F.size("regions") == 0, "missing-region").when(F.exists("regions", lambda x: x["ambiguous"]) | (r["confidence"] < UNSURE), "ambiguous-region"),
    ))
    return d.withColumns({"issues": doubts, "confidence": F.least(c["confidence"], F.coalesce(r["confidence"], F.lit(0.0)), F.coalesce(a["confidence"], F.lit(1.0)))})
