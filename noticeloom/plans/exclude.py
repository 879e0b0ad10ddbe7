"""Exclusion and first relevance of posts: each document's text follows one of the posts listed here."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.operators import exclusions as X
from noticeloom.sources.tables import table

#: title, text before the document's, source, and the rule that excludes it ('' for none; '?' after it: unless
#: the document's text calls for action).
POSTS = [
    ("[소식] 마을 축제 운영 (2026.03.01.)", "", "", "news-operation-report"), ("센터장 모집 공고", "", "", "organization-head-recruitment"), ("통장 모집 재공고", "", "", "local-administrative-recruitment"),
    ("제 12 호 주간구인정보", "", "", "weekly-job-information"), ("국외부재자신고 알림", "", "", "election-administrative-guide"), ("프로젝트 성료 (2026.03.01)", "", "", "completed-activity-report"),
    ("마을 간담회", "", "", "retrospective-news-no-action?"), ("장마철 안전 관리 요령", "", "", "public-safety-guide?"), ("참가상 명단", "", "", "selected-list-or-award-list"),
    ("시상 내용 변경 공지", "", "", "event-change-notice"), ("행사 취소 알림", "", "", "event-cancellation-notice"), ("번호 운영 종료", "", "", "service-operation-end"), ("밴드존 행사 일정", "", "", "street-event-schedule"),
    ("모집 심사 일정 공고", "", "", "recruitment-screening-schedule"), ("오류 페이지", "", "", "system-error-page"), ("WA 마크 획득", "", "", "web-accessibility-mark"),
    ("볼링장 시간표", "", "", "facility-schedule-or-parking-control"), ("주민등록 직권조치 공고", "", "", "resident-registration-administrative-notice"), ("지진 옥외대피소", "", "", "civil-defense-or-shelter-guide"),
    ("쓰레기 배출 일정", "", "", "local-waste-disposal-guide"), ("법정 공휴일 운영", "", "", "partial-operation-or-public-holiday"), ("5월 달력", "", "", "monthly-calendar-or-schedule-image"),
    ("강북 ANC 5월 공예 클래스", "", "", "gangbuk-anc-monthly-craft-class-schedule"), ("작성자", "", "", "metadata-title"), ("작성자: 홍길동", "", "", "metadata-title-prefix"), ("rss", "", "", "rss-or-feed"),
    ("홈 / 알림 / 게시", "", "", "breadcrumb-title"), ("체육관 공휴일", "", "", "sports-facility-hours-or-closure"), ("생활체육 모집 일정", "", "", "sports-program-timetable"), ("직원 사칭 주의 안내", "", "", "facility-administrative-notice"),
    ("공휴일 이용안내", "", "", "holiday-operation-notice"), ("공휴일 지정 알림", "", "", "holiday-designation-or-partial-operation"), ("선거일 시설 안내", "", "", "election-facility-notice"),
    ("전국동시지방선거 무투표", "", "", "election-administrative-notice"), ("센터 이용 제한", "", "", "facility-access-control-or-refund"), ("동네 알림", "체육관 대관 일정표", "", "rental-schedule-table"),
    ("수영장 오전", "", "", "sports-facility-use-schedule"), ("등록 안내", "", "", "application-guide"), ("전수조사", "", "", "reporting-or-voting-guide"), ("당첨자", "", "", "result-or-selected-list"),
    ("서류 합격", "", "", "korean-result-or-selected-list"), ("장학서 수여식", "", "", "selected-or-result-announcement"), ("휴관 안내", "", "", "closure-or-operation-notice"), ("게시 요청", "", "", "posting-guide"),
    ("모금함", "", "", "donation-or-campaign-link"), ("서류 전형 결과", "", "", "job-result-announcement"), ("업무추진비", "", "", "budget-or-expense-disclosure"), ("채용 서류 반환", "", "", "job-document-notice"),
    ("지역공동체 일자리 사업 참여자 모집", "", "", "public-workfare-recruitment-document"), ("시설 대관 안내", "", "", "facility-use-guide"), ("반려식물 클리닉", "", "", "low-poster-specific-known-terms"),
    # exceptions, and what the rules' order doesn't reach
    ("창업 행사 봄 행사 일정", "", "https://k-startup.go.kr/1", ""), ("창업 행사 봄 행사 일정", "", "https://a.example/1", "street-event-schedule"), ("당첨자 지원서", "", "https://job.alio.go.kr/1", ""),
    ("시설 대관 안내 채용 공고", "", "https://mapo-employ.example/1", ""), ("장학생 모집 휴관 안내", "", "https://mapo-scholarship.example/1", ""), ("장학생 발표 휴관 안내", "", "https://mapo-scholarship.example/1", "closure-or-operation-notice"),
    ("모집 선발 공개", "", "", ""), ("등록 안내", "교육", "", ""), ("휴관 안내 교육생 모집", "", "", ""), ("하루 이야기", "", "https://news.seoul.go.kr/1", "seoul-news-without-public-action"),
    ("하루 이야기", "선착순", "https://news.seoul.go.kr/1", ""), ("하루 이야기", "", "https://a.example/board/news/1", "news-board-without-action?"), ("2020년 봄 축제", "", "", "stale-year-event-title"), ("2020년 봄 축제 모집", "", "", ""),
    ("봄날 하루", "", "", ""),
]
#: title, text before the document's, route and rule.
GREETINGS = [
    ("구청장 인사말", "", "discard", "head-greeting-message"), ("신년사", "", "discard", "new-year-address"), ("합격 축하", "", "discard", "congratulation-message"), ("감사의 글", "", "discard", "thanks-message"),
    ("직원 동정", "", "discard", "staff-daily-life"), ("감사의 글패", "", "", ""), ("동네 모임", "3월까지 신청", "notice", "deadline+action-verb"), ("상시 모집", "", "notice", "deadline+action-verb"), ("봄날", "", "", ""),
]


def _posts(spark, sf_dir, posts, kind):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(len(posts))).cast("int").alias("k"))
    return d.join(F.broadcast(spark.createDataFrame([(k, *p[:len(kind.split(",")) - 1]) for k, p in enumerate(posts)], kind)), "k")


def f16_exclusion(spark, sf_dir):
    p = _posts(spark, sf_dir, POSTS, "k int, title string, lead string, source string")
    rule = X.exclusion(F.col("title"), F.concat_ws(" ", "lead", "text"), F.col("source"), F.lit(2026))
    return p.select("doc_id", F.coalesce(rule, F.lit("")).alias("rule"))


def f17_relevance(spark, sf_dir):
    p = _posts(spark, sf_dir, GREETINGS, "k int, title string, lead string")
    p = p.select("doc_id", X.relevance(F.col("title"), F.concat_ws(" ", "lead", "text")).alias("r"))
    return p.select("doc_id", F.coalesce("r.route", F.lit("")).alias("route"), F.coalesce("r.rule", F.lit("")).alias("rule"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "f" and k[1:3].isdigit()}
_WANT = ", ".join(f"({k}, '{p[3].rstrip('?')}', {p[3].endswith('?')})" for k, p in enumerate(POSTS))
_ROUTES = ", ".join(f"({k}, '{p[2]}', '{p[3]}')" for k, p in enumerate(GREETINGS))
SQL = {
    "f16_exclusion": f"SELECT doc_id, CASE WHEN unless AND regexp_matches(text, '(?i)apply|register|registration') THEN '' ELSE rule END AS rule FROM documents JOIN (VALUES {_WANT}) AS v(k, rule, unless) ON doc_id % {len(POSTS)} = k",
    "f17_relevance": f"SELECT doc_id, route, rule FROM documents JOIN (VALUES {_ROUTES}) AS v(k, route, rule) ON doc_id % {len(GREETINGS)} = k",
}
