"""The quality gate over notices: each document's text follows one of the notices listed here, so that every issue
arises. The SQL holds, for each of them, the codes it must get."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions.applications import date_quality
from noticeloom.operators import quality_gate as Q
from noticeloom.operators.upload import upload_plan
from noticeloom.sources.tables import table

_LONG = "우리 동네 이야기와 소식을 담은 여러 가지 활동을 함께 소개합니다."
_PERIOD = "신청기간: 2026.03.01 ~ 2026.03.10"
#: title, unique (the title is made unique), summary, whole (the document's text follows), org, source, image, its own (the
#: address is unique), link, label, text_only, is_poster, poster_confidence, same_notice, match_confidence, deadline, dates.
SAMPLES = [
    ("동네 미술 교실", True, _LONG, True, "문화재단", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("", False, _LONG, True, "", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("짧은 안내문 하나", True, "짧다", False, "구청", "", "", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("공지사항", False, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", True, True, 0.9, True, 0.9, "", ""),
    ("홈 / 알림 / 게시판", True, _LONG, True, "구청", "https://a.example/view/", "", True, "", "", True, True, 0.9, True, 0.9, "", ""),
    ("구청 사회복지사 긴급 채용 진행", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("마을 모임 후기", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("가스 안전 사용 요령", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("마을 사진 이야기", True, _LONG, True, "구청", "https://a.example/board/news/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("독서 모임 열기", True, _LONG, True, "구청", "https://forms.gle/x", "https://img.example/p/", True, "https://localhost/x", "신청하기", False, True, 0.9, True, 0.9, "", ""),
    ("시스템 오류 화면", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "javascript:void(0)", "접수", False, True, 0.9, True, 0.9, "", ""),
    ("웹 접근성 인증", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/wa_mark.png?", True, "https://a.example/", "신청", False, True, 0.9, True, 0.9, "", ""),
    ("수영장 운영 안내", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/logo.png?", True, "https://b.example/apply", "신청", False, True, 0.9, True, 0.9, "", ""),
    ("홈페이지 주차장 이용 안내", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "/apply/12", "신청", False, True, 0.9, True, 0.9, "", ""),
    ("전국동시지방선거 알림", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("3월 볼링 시간표", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("공공근로 참여자 모집", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("환경미화원 모집 공고", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("광복절 태극기 달기 운동", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("에듀윌과 함께하는 밤", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, False, 0.4, False, 0.3, "", ""),
    ("표시 있는 마당", True, "다음 양식 지우기 📌 대상 누구나 📌 장소 시청 " + _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("깨진 � 글자", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, None, None, None, None, "", ""),
    ("부호로 된 글", True, "aGVsbG8wd29y" * 15 + " " + _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("같은 제목의 밤", False, _LONG, True, "구청", "https://a.example/view/", "https://img.example/same.jpg", False, "", "", False, True, 0.9, True, 0.9, "2026-03-10", _PERIOD),
    ("같은 출처의 밤", True, _LONG, True, "구청", "https://a.example/same", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
    ("날짜가 다른 밤", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "2026-03-12", "상시 모집 " + _PERIOD),
    ("날짜가 없는 밤", True, _LONG, True, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "3월 말", _PERIOD),
    ("창업 지원 사업 홈페이지 주차장", True, _LONG, False, "기업마당", "https://a.example/view/", "https://img.example/p/", True, "", "", True, True, 0.9, True, 0.9, "", ""),
    ("체육관 운영 안내 응시 자격", True, _LONG, False, "job-alio", "https://a.example/view/", "https://img.example/p/", True, "", "", True, True, 0.9, True, 0.9, "", ""),
    ("요가 강좌 수강생 모집", True, "체육관 대관 홈페이지 이용 안내, 강사 모집 아님. " + _LONG, False, "구청", "https://a.example/view/", "https://img.example/p/", True, "", "", False, True, 0.9, True, 0.9, "", ""),
]
_COLUMNS = "title, unique_title, summary, whole, org, source, image, own, link, label, text_only, is_poster, poster_confidence, same_notice, match_confidence, deadline, dates"
_KIND = "k int, title string, unique_title boolean, summary string, whole boolean, org string, source string, image string, own boolean, link string, label string, text_only boolean, is_poster boolean, poster_confidence double, same_notice boolean, match_confidence double, deadline string, dates string"


def notices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(len(SAMPLES))).cast("int").alias("k"))
    s = spark.createDataFrame([(k, *row) for k, row in enumerate(SAMPLES)], _KIND)
    own = F.col("doc_id").cast("string")
    link = F.struct(F.col("link").alias("url"), "label", F.lit("").alias("type"))
    source = F.when(F.col("source").rlike("/(view|board/news)/$"), F.concat("source", own)).otherwise(F.col("source"))
    return d.join(F.broadcast(s), "k").select(
        F.col("doc_id").alias("id"), F.when(F.col("unique_title"), F.concat_ws(" ", "title", F.left(F.md5(own.cast("binary")), F.lit(8)))).otherwise(F.col("title")).alias("title"), "org",
        F.when(F.col("whole"), F.concat_ws(" ", "summary", "text")).otherwise(F.col("summary")).alias("summary"), source.alias("source_url"),
        F.when(F.col("image") == "", F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("own"), F.concat("image", own)).otherwise(F.col("image")))).alias("images"),
        F.when(F.col("label") == "", F.array().cast("array<struct<url:string,label:string,type:string>>")).otherwise(F.array(link)).alias("links"),
        "text_only", "is_poster", "poster_confidence", "same_notice", "match_confidence", "deadline", "dates",
    )


def _gated(spark, sf_dir, most=None):
    n = notices(spark, sf_dir)
    doubts = F.when(F.col("dates") != "", date_quality(F.col("dates"), F.col("deadline"))["issues"])
    return Q.gate(n, doubts, most)


def z11_quality_gate(spark, sf_dir):
    return _gated(spark, sf_dir, Q.BUNDLE).select("id", "decision", "score", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


def a21_issue_counts(spark, sf_dir):
    return _gated(spark, sf_dir).select(F.explode("issues").alias("i")).groupBy("i.code").agg(F.count("*").alias("n"))


def a18_review_queue(spark, sf_dir):
    return _gated(spark, sf_dir, Q.BUNDLE).groupBy("decision").agg(F.count("*").alias("n"), F.sum("score").alias("points"))


def t08_worst_issues(spark, sf_dir):
    return _gated(spark, sf_dir, Q.BUNDLE).orderBy(F.desc("score"), F.desc("id")).limit(80).select("id", "score")


def z19_upload(spark, sf_dir):
    n = notices(spark, sf_dir)
    doubts = F.when(F.col("dates") != "", date_quality(F.col("dates"), F.col("deadline"))["issues"])
    return upload_plan(n, n.where("id % 50 = 0"), F.lit(2026), doubts)


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "atz" and k[1:3].isdigit()}

#: What each sample must give, by its number; codes that depend on the document's text or on other rows are in the SQL.
_EXPECTED = [
    "", "missing-title missing-org generic-title", "weak-summary missing-source missing-image", "generic-title", "text-notice-no-image breadcrumb-title", "employment-recruitment-notice",
    "retrospective-news", "public-safety-guide", "news-board-without-action", "application-url-as-source bad-application-url", "bad-application-url system-error", "bad-application-url web-accessibility bad-image-url",
    "facility-use bad-image-url", "parking-or-homepage", "election-facility", "monthly-schedule", "public-workfare-doc", "employment-recruitment-notice", "administrative-campaign-attachment",
    "known-source-title-risk image-not-poster image-content-mismatch low-image-confidence low-content-match-confidence", "collapsed-structured-summary form-ui-noise", "mojibake", "encoded-or-binary-text",
    "duplicate-title-org duplicate-title-org-deadline duplicate-image", "duplicate-source", "always-open-conflict deadline-mismatch", "invalid-extracted-deadline missing-clear-deadline",
    "parking-or-homepage", "facility-use", "",
]
_ORDER = (
    "missing-title missing-org weak-summary missing-source collapsed-structured-summary form-ui-noise application-url-as-source text-notice-no-image missing-image generic-title breadcrumb-title mojibake "
    "encoded-or-binary-text employment-recruitment-notice retrospective-news public-safety-guide news-board-without-action bad-application-url system-error web-accessibility facility-use parking-or-homepage "
    "election-facility monthly-schedule public-workfare-doc administrative-campaign-attachment known-source-title-risk bad-image-url image-not-poster image-content-mismatch "
    "low-image-confidence low-content-match-confidence invalid-extracted-deadline always-open-conflict deadline-mismatch missing-clear-deadline duplicate-source duplicate-title-org duplicate-title-org-deadline duplicate-image"
).split()
_HIGH = (
    "missing-title missing-source form-ui-noise application-url-as-source missing-image generic-title breadcrumb-title mojibake encoded-or-binary-text employment-recruitment-notice retrospective-news "
    "public-safety-guide news-board-without-action system-error web-accessibility administrative-campaign-attachment bad-image-url image-not-poster image-content-mismatch "
    "invalid-extracted-deadline always-open-conflict deadline-mismatch duplicate-title-org-deadline duplicate-image"
).split()
_REJECT = (
    "missing-title missing-image generic-title breadcrumb-title mojibake encoded-or-binary-text employment-recruitment-notice retrospective-news public-safety-guide news-board-without-action "
    "system-error web-accessibility facility-use parking-or-homepage election-facility monthly-schedule public-workfare-doc administrative-campaign-attachment bad-image-url image-not-poster image-content-mismatch"
).split()
_ACTION = "regexp_matches(text, '(?i)apply|regist(er|ration)')"
_EXTRA = {  # code: when a document's text or other rows decide it
    "collapsed-structured-summary": "NOT regexp_matches(text, '[\\r\\n]')", "retrospective-news": f"NOT {_ACTION}", "public-safety-guide": f"NOT {_ACTION}", "news-board-without-action": f"NOT {_ACTION}",
    **{c: "count(*) OVER (PARTITION BY k) > 1" for c in ("duplicate-source", "duplicate-title-org", "duplicate-title-org-deadline", "duplicate-image")},
}
_EVERYWHERE = {"mojibake": "k NOT IN (2, 27, 28, 29) AND regexp_matches({seen}, '[�占]')", "encoded-or-binary-text": "k NOT IN (2, 27, 28, 29) AND regexp_matches(text, '\\b[A-Za-z0-9+/]{{160,}}')"}
#: The boards' own title and the shared form address repeat as well.
_ALSO = {"duplicate-title-org": "k = 3 AND count(*) OVER (PARTITION BY k) > 1", "duplicate-source": "k = 9 AND count(*) OVER (PARTITION BY k) > 1"}


def _code(code: str, seen: str) -> str:
    tests = [f"list_contains(string_split(expected, ' '), '{code}')" + (f" AND {_EXTRA[code]}" if code in _EXTRA else "")]
    tests += [f"({extra[code].format(seen=seen)})" for extra in (_EVERYWHERE, _ALSO) if code in extra]
    return f"CASE WHEN {' OR '.join(tests)} THEN '{code}' END"


_SAMPLES = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{e}')" for k, e in enumerate(_EXPECTED)) + ") AS v(k, expected))"
_codes = lambda seen: f"(SELECT id, k, list_filter([{', '.join(_code(c, seen) for c in _ORDER)}], lambda c: c IS NOT NULL) AS codes FROM (SELECT doc_id AS id, text, k, expected FROM (SELECT *, doc_id % {len(_EXPECTED)} AS k FROM documents) JOIN {_SAMPLES} USING (k)))"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_gate = lambda seen: f"""(SELECT *, list_sum(list_transform(codes, lambda c: CASE WHEN list_contains({_LIST(_HIGH)}, c) THEN 5 ELSE 3 END)) AS points,
    CASE WHEN len(codes) = 0 THEN 'pass' WHEN k IN (27, 28) THEN 'review' WHEN len(list_intersect(codes, {_LIST(_REJECT)})) > 0 THEN 'reject' ELSE 'review' END AS decision FROM {_codes(seen)})"""  # noqa: E731
#: The gate over whole texts, and over their beginnings.
_WHOLE, _GATE = _gate("text"), _gate("left(text, 3500)")
#: The exclusion rules of samples, by number; the last three don't apply where the document's text calls for action.
_EXCLUDED = {3: "metadata-title", 4: "breadcrumb-title", 10: "system-error-page", 11: "web-accessibility-mark", 12: "sports-program-timetable", 13: "application-guide", 15: "facility-schedule-or-parking-control",
             28: "sports-facility-hours-or-closure", 29: "sports-facility-hours-or-closure", 6: "retrospective-news-no-action", 7: "public-safety-guide", 8: "news-board-without-action"}
_RULE = "CASE " + " ".join(f"WHEN k = {k}" + (f" AND NOT {_ACTION}" if k in (6, 7, 8) else "") + f" THEN '{rule}'" for k, rule in _EXCLUDED.items()) + " END"
_SOURCES = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{p[5]}')" for k, p in enumerate(SAMPLES)) + ") AS v(k, source))"
_PLACED = f"""(SELECT g.*, {_RULE} AS rule, CASE WHEN ends_with(v.source, '/view/') OR ends_with(v.source, '/board/news/') THEN v.source || g.id ELSE v.source END AS url FROM {_WHOLE} g JOIN documents ON doc_id = g.id JOIN {_SOURCES} v USING (k))"""
_ROUTED = f"""(SELECT *, CASE WHEN rule IS NOT NULL THEN 'excluded' WHEN decision = 'reject' THEN 'rejected' WHEN url <> '' AND url IN (SELECT url FROM {_PLACED} WHERE id % 50 = 0) THEN 'updated' WHEN decision = 'review' OR k = 27 THEN 'candidate' ELSE 'poster' END AS route FROM {_PLACED})"""
SQL = {
    "z19_upload": f"""SELECT id, route, CASE route WHEN 'excluded' THEN rule WHEN 'rejected' THEN list_filter(codes, lambda c: list_contains({_LIST(_REJECT)}, c))[1] WHEN 'candidate' THEN coalesce(codes[1], '') ELSE '' END AS reason FROM {_ROUTED}""",
    "z11_quality_gate": f"SELECT id, decision, CAST(coalesce(points, 0) AS INT) AS score, array_to_string(codes, ',') AS codes FROM {_GATE}",
    "a21_issue_counts": f"SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM {_WHOLE}) GROUP BY 1",
    "a18_review_queue": f"SELECT decision, count(*) AS n, CAST(sum(coalesce(points, 0)) AS BIGINT) AS points FROM {_GATE} GROUP BY 1",
    "t08_worst_issues": f"SELECT id, CAST(coalesce(points, 0) AS INT) AS score FROM {_GATE} ORDER BY 2 DESC, 1 DESC LIMIT 80",
}
