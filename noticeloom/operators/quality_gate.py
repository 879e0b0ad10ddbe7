"""Quality gate: a notice's issues, their score, and whether it is rejected, reviewed or passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.patterns import found as matches, holds_anchor
from noticeloom.functions.text import org_key, title_key
from noticeloom.functions.urls import bad_application, image_identity

# Severities, in points; the codes that reject whatever their own decision.
POINTS = {"high": 5, "medium": 3, "low": 1}
REJECT_CODES = (
    "missing-title", "generic-title", "breadcrumb-title", "mojibake", "system-error", "web-accessibility", "bad-image-url", "missing-image", "facility-use",
    "parking-or-homepage", "election-facility", "monthly-schedule", "public-workfare-doc", "employment-recruitment-notice", "administrative-campaign-attachment",
    "image-not-poster", "image-content-mismatch",
)
# Titles of boards and providers rather than notices.
GENERIC_TITLES = (
    r"^\s*$", r"^공지사항$", r"^채용공고$", r"^자세히\s*보기$", r"^작성자$", r"^관리자$", r"^번호$", r"^제목$", r"^첨부파일$", r"^maposc$", r"^@청년몽땅정보통$", r"^동아일보$", r"^\(주\)에듀윌$",
    r"^퍼스트인잡\s*\(주\)$", r"^에이블런(?:\s*안내)?$", r"^서울특별시\s+\S+구$",
)
BREADCRUMB = r"^[^/<>()\[\]]+\s+/\s+[^/<>()\[\]]+\s+/\s+[^/<>()\[\]]+(?:\s+/\s+[^/<>()\[\]]+)*$"
# Signs of recruitment, news, safety guides, jobs, courses, forms and broken text.
RECRUITING = r"(?:모집|신청|접수|참여자|교육생|수강생|지원\s*대상|대상자\s*모집|참가자\s*모집|이용자\s*모집|공모|선착순|접수\s*중|apply|register|registration)"
NEWS = r"(?:소식|후기|결과|현장\s*스케치|활동\s*보고|행사\s*스케치|모임\s*소식|간담회|대표자\s*모임)"
SAFETY = r"(?:가스|부탄|장마철|행락철|생활\s*안전).*(?:안전\s*관리\s*요령|안전\s*사용\s*요령|사용\s*요령|관리\s*요령)|(?:안전\s*관리\s*요령|안전\s*사용\s*요령|사용\s*요령|관리\s*요령).*(?:가스|부탄|장마철|행락철|생활\s*안전)"
JOBS = r"(?:채용\s*(?:공고|기간|안내)|직원\s*채용|사회복지사.*채용|정규직.*채용|계약직.*채용|강사\s*모집|팀원\s*채용)"
COURSES = r"(?:교육생|수강생|특강|멘토링|아카데미|강좌|교육|프로그램|캠프)"
FORM_NOISE = r"(?:표시는\s*필수\s*질문|Google Forms를\s*통해|다음\s*양식\s*지우기|이메일\s*\*\s*응답과\s*함께)"
MARKERS = r"(?:📌\s*(?:대상|인원|장소|참여\s*비용|참여\s*선정\s*안내|신청\s*기간|신청\s*방법|운영\s*기간|교육\s*일시|교육\s*장소|문의(?:처)?)|❤️\s*문의(?:처)?|🚨|※)"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"  # of a word of ASCII characters
ENCODED = _EDGE + r"[A-Za-z0-9+/]{160,}={0,2}" + _EDGE
RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{160}"  # without it, nothing is encoded; found in one pass
MOJIBAKE = r"[�占]"
NEWS_BOARD = r"/(?:community/news|notice/news|board/news)(?:/|$|\?)"
SHARED_FORM = r"(?:^|//)(?:forms\.gle|docs\.google\.com/forms|form\.naver\.com|forms\.office\.com)(?:/|$)"
# Sources of text notices and their signs, for which some codes only ask for review.
CENTRAL_SOURCE = r"(?:k-startup|K-Startup|k-startup\.go\.kr|bizinfo|bizinfo\.go\.kr|youthcenter|youthcenter\.go\.kr|기업마당|온통청년)"
CENTRAL_SIGN = r"(?:신청|접수)\s*기간|신청\s*방법|주관기관|창업|스타트업|참가기업|참여기업|창업기업|입주기업|지원\s*사업|사업\s*공고|액셀러레이팅|컨설팅|투자|보육센터|(?<![A-Za-z0-9_])IR(?![A-Za-z0-9_])"
PUBLIC_JOB_SOURCE = r"(?:job-alio|JOB-ALIO|job\.alio\.go\.kr)"
PUBLIC_JOB_SIGN = r"(?:채용\s*기간|응시\s*자격|채용\s*인원|고용\s*형태|근무\s*지|학력\s*정보|전형\s*절차|지원서|직무\s*기술서)"
CENTRAL_REVIEW, PUBLIC_JOB_REVIEW = ("parking-or-homepage", "web-accessibility"), ("facility-use",)
SHARED_DETAIL = ("facility-use", "parking-or-homepage")
# Code, severity, decision, whether only titles count, pattern.
TEXT_RULES = (
    ("system-error", "high", "reject", False, r"시스템\s*오류|시스템오류"),
    ("web-accessibility", "high", "reject", False, r"웹\s*접근성|웹접근성|접근성\s*인증|품질\s*인증\s*마크|대체\s*텍스트|(?<![A-Za-z0-9_])WA\s*마크"),
    ("facility-use", "medium", "reject", False, r"(?:배드민턴|볼링장|종합체육관|체육관|수영장|헬스장|대관).*(?:부분\s*운영일|법정\s*공휴일|운영\s*안내|이용\s*시간|이용\s*안내|시간표|일정표|대관)|(?:부분\s*운영일|법정\s*공휴일|운영\s*안내|이용\s*시간|이용\s*안내|시간표|일정표|대관).*(?:배드민턴|볼링장|종합체육관|체육관|수영장|헬스장|대관)|(?:부분\s*운영일|법정\s*공휴일).*(?:이용\s*안내|운영\s*안내|이용\s*시간)|회원\s*접수.*이용\s*안내"),
    ("parking-or-homepage", "medium", "reject", False, r"홈페이지.*(?:주차\s*통제|주차장|이용\s*안내)|(?:주차\s*통제|주차장|주차\s*이용\s*제한).*(?:홈페이지|이용\s*안내|시설|센터)"),
    ("election-facility", "medium", "reject", False, r"전국\s*동시\s*지방선거|전국동시지방선거|지방선거.*(?:시설|주차|환불|이용\s*제한|안내)"),
    ("monthly-schedule", "medium", "reject", True, r"(?:\d{1,2}\s*월|[0-9]{2}\s*월).*(?:시간표|일정표|대관\s*일정|관내\s*대관|부분\s*운영일|법정\s*공휴일)|(?:시간표|일정표|대관\s*일정|관내\s*대관|부분\s*운영일|법정\s*공휴일).*(?:\d{1,2}\s*월|[0-9]{2}\s*월)"),
    ("public-workfare-doc", "medium", "reject", False, r"지역\s*공동체\s*일자리\s*사업.*참여자\s*모집|공공근로.*참여자\s*모집"),
    ("employment-recruitment-notice", "high", "reject", True, r"(?:채용\s*(?:공고|재공고|기간|안내)|직원\s*채용|계약직\s*(?:직원|사회복지사|매니저)?\s*채용|청년안전\s*매니저\s*채용|강사\s*모집|(?:관리인|관리원|청소원|환경미화원)\s*모집\s*공고|통장\s*모집\s*공고)"),
    ("administrative-campaign-attachment", "high", "reject", True, r"(?:삼일절|3\s*·?\s*1절|광복절|제헌절|한글날|국군의\s*날).*(?:나라사랑\s*)?태극기\s*달기\s*운동|(?:나라사랑\s*)?태극기\s*달기\s*운동"),
    ("known-source-title-risk", "medium", "review", False, r"동아일보|에듀윌|에이블런"),
)
# Image addresses of logos, buttons and calendars.
BAD_IMAGES = (
    r"(?:^|[/$_.-])wa[_-]?mark(?:[/$_.-]|$)", r"web[_-]?accessibility|accessibility[_-]?mark|wa[_-]?cert|wa[_-]?logo", r"favicon|sprite|(?:^|[/$_.-])logo(?:[/$_.-]|$)|(?:^|[/$_.-])icon(?:[/$_.-]|$)",
    r"(?:^|[/$_.-])btn(?:[/$_.-]|$)|(?:^|[/$_.-])button(?:[/$_.-]|$)|sns|facebook|twitter|instagram|youtube|kakao", r"calendar|schedule|timetable",
)
# Severities of the doubts about dates that aren't medium; the least confidence; lengths.
GRAVE_DATES = ("invalid-extracted-deadline", "date-end-before-start", "always-open-conflict", "deadline-mismatch")
CONFIDENT, SHORT_SUMMARY, SHORT_TITLE, LONG_TITLE, BUNDLE = 0.55, 25, 4, 180, 4000


def issue(code: str, severity: str, decision: str, found: Column) -> Column:
    """struct(code, severity, decision) where found, else null."""
    return F.when(F.coalesce(found, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(decision).alias("decision")))


def _has(text: Column, *patterns: str) -> Column:
    return reduce(Column.__or__, [text.rlike("(?i)" + p) for p in patterns])


def repeated_keys(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(id, repeated array<string>): of each row with any, the names of those keys that other rows share. A key is a
    column of strings or of arrays of them; blank keys are shared with no one. Only keys are shuffled."""
    arrays = {n for n, (_, kind) in zip(keys, rows.select(*keys.values()).dtypes) if kind.startswith("array")}
    named = lambda n: lambda x: F.struct(F.lit(n).alias("name"), x.alias("key"))
    single = [F.transform(k if n in arrays else F.array(k), named(n)) for n, k in keys.items()]
    long = rows.select("id", F.explode(F.flatten(F.array(*single))).alias("k")).select("id", "k.*").where("key <> ''").distinct()
    often = long.groupBy("name", "key").agg(F.count("*").alias("n")).where("n > 1")
    return long.join(often.select("name", "key"), ["name", "key"], "left_semi").groupBy("id").agg(F.collect_set("name").alias("repeated"))


def gate(rows: DataFrame, date_codes: Column | None = None, most: int | None = None) -> DataFrame:
    """rows with (issues array<struct<code, severity, decision>>, score, decision).

    rows: id, title, org, summary, source_url, images array<string>, links array<struct<url, label, type>>, text_only, is_poster,
    poster_confidence, same_notice, match_confidence, deadline. date_codes: doubts about dates, from date_quality.
    most: characters of a notice's joined fields that are searched; all, where it isn't given.
    Null strings count as blank, null arrays as empty, unknown verdicts and confidences raise nothing.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flat = lambda c: F.trim(F.regexp_replace(text(c), r"\s+", " "))
    images = F.filter(F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<struct<url:string,label:string,type:string>>")
    links = F.coalesce("links", none)
    urls = F.filter(F.transform(links, lambda x: F.trim(F.coalesce(x["url"], F.lit("")))), lambda x: x != "")
    keys = {
        "source": F.trim(text("source_url")), "title": F.when((F.col("_tk") != "") & (F.col("_ok") != ""), F.concat_ws("/", "_tk", "_ok")),
        "deadline": F.when((F.col("_tk") != "") & (F.col("_ok") != "") & (text("deadline") != ""), F.concat_ws("/", "_tk", "_ok", "deadline")), "image": F.transform(images, image_identity),
    }
    named = rows.select("id", "source_url", "images", "deadline", title_key(F.col("title"), F.col("org")).alias("_tk"), org_key(F.col("org")).alias("_ok"))
    d = rows.withColumns({
        "_t": flat("title"), "_o": flat("org"), "_s": flat("summary"), "_u": F.trim(text("source_url")), "_i": images, "_urls": urls, "_l": links,
        "_alone": F.coalesce("text_only", F.lit(False)),
    })
    joined = F.concat_ws(" ", "_t", "_o", "_s", "_u", "_i", "_urls")
    d = d.withColumns({"_both": F.concat_ws(" ", "_t", "_s"), "_x": joined if most is None else F.left(joined, F.lit(most))})
    d = d.withColumns({"_bl": F.lower("_both"), "_xl": F.lower("_x")})
    t, s, u, x, alone = F.col("_t"), F.col("_s"), F.col("_u"), F.col("_x"), F.col("_alone")
    in_both, in_x = (lambda *patterns: matches(F.col("_both"), F.col("_bl"), *patterns)), (lambda *patterns: matches(x, F.col("_xl"), *patterns))
    origin = F.concat_ws(" ", "_o", "_u")
    d = d.withColumns({
        "_active": in_both(RECRUITING), "_course": in_both(COURSES),
        "_central": alone & _has(origin, CENTRAL_SOURCE) & in_x(CENTRAL_SIGN), "_job": alone & _has(origin, PUBLIC_JOB_SOURCE) & in_x(PUBLIC_JOB_SIGN),
    })
    active, course = F.col("_active"), F.col("_course")
    raw, encoded = text("summary"), lambda c: F.when(c.rlike(RUN), c.rlike(ENCODED)).otherwise(False)
    checks = [
        issue("missing-title", "high", "reject", t == ""), issue("missing-org", "medium", "review", F.col("_o") == ""), issue("weak-summary", "medium", "review", F.length(s) < SHORT_SUMMARY),
        issue("missing-source", "high", "review", (u == "") & (F.size("_urls") == 0)),
        issue("collapsed-structured-summary", "medium", "review", F.when(holds_anchor(F.col("_bl"), MARKERS) & ~raw.rlike(r"[\r\n]"), F.regexp_count(raw, F.lit(MARKERS)) >= 2)),
        issue("form-ui-noise", "high", "review", matches(raw, F.col("_bl"), FORM_NOISE)), issue("application-url-as-source", "high", "review", _has(u, SHARED_FORM)),
        issue("text-notice-no-image", "medium", "review", (F.size("_i") == 0) & alone), issue("missing-image", "high", "reject", (F.size("_i") == 0) & ~alone),
        issue("generic-title", "high", "reject", (F.length(t) <= SHORT_TITLE) | _has(t, *GENERIC_TITLES)), issue("breadcrumb-title", "high", "reject", (F.length(t) < LONG_TITLE) & _has(t, BREADCRUMB)),
        issue("mojibake", "high", "reject", matches(x, F.col("_xl"), MOJIBAKE, cased=True)), issue("encoded-or-binary-text", "high", "reject", encoded(s) | encoded(x)),
        issue("employment-recruitment-notice", "high", "reject", _has(t, JOBS) | (~(active & course) & in_x(JOBS))),
        issue("retrospective-news", "high", "reject", _has(t, NEWS) & ~active), issue("public-safety-guide", "high", "reject", ~active & in_both(SAFETY)),
        issue("news-board-without-action", "high", "reject", _has(u, NEWS_BOARD) & ~active),
        issue("bad-application-url", "medium", "review", F.exists("_l", lambda link: bad_application(link, F.col("_u")))),
    ]
    for code, severity, verdict, title_only, pattern in TEXT_RULES:
        hit = _has(t, pattern)
        if not title_only:  # a shared page around a course doesn't make it a facility's notice
            beside = in_x(pattern)
            hit = hit | (beside & ~(active | course) if code in SHARED_DETAIL else beside)
        mild = F.col("_central") if code in CENTRAL_REVIEW else F.col("_job") if code in PUBLIC_JOB_REVIEW else None
        if mild is None:
            checks.append(issue(code, severity, verdict, hit))
        else:
            checks.append(F.coalesce(issue(code, "medium", "mild", hit & mild), issue(code, severity, verdict, hit)))
    checks += [
        issue("bad-image-url", "high", "reject", F.exists("_i", lambda i: _has(i, *BAD_IMAGES))),
        issue("image-not-poster", "high", "reject", ~alone & ~F.coalesce("is_poster", F.lit(True))), issue("image-content-mismatch", "high", "reject", ~alone & ~F.coalesce("same_notice", F.lit(True))),
        issue("low-image-confidence", "medium", "review", ~alone & (F.col("poster_confidence") < CONFIDENT)), issue("low-content-match-confidence", "medium", "review", ~alone & (F.col("match_confidence") < CONFIDENT)),
    ]
    doubt = lambda c: F.struct(c.alias("code"), F.when(c.isin(*GRAVE_DATES), "high").otherwise("medium").alias("severity"), F.lit("review").alias("decision"))
    dates = F.transform(F.coalesce(date_codes if date_codes is not None else F.lit(None).cast("array<string>"), F.array().cast("array<string>")), doubt)
    again = [("duplicate-source", "medium", "source"), ("duplicate-title-org", "medium", "title"), ("duplicate-title-org-deadline", "high", "deadline"), ("duplicate-image", "high", "image")]
    copies = F.array(*[issue(code, severity, "review", F.array_contains("_again", name)) for code, severity, name in again])
    # the texts are read before the join, so that no one who doesn't ask for them shuffles them
    judged = d.withColumns({"_checks": F.array_compact(F.array(*checks)), "_dates": dates}).drop(*[c for c in d.columns if c.startswith("_")])
    d = judged.join(repeated_keys(named, keys), "id", "left").withColumn("_again", F.coalesce("repeated", F.array().cast("array<string>")))
    d = d.withColumn("issues", F.array_compact(F.concat("_checks", "_dates", copies)))
    d = d.withColumns({"score": score(F.col("issues")), "decision": decision(F.col("issues"))})
    mildened = F.transform("issues", lambda i: i.withField("decision", F.when(i["decision"] == "mild", "review").otherwise(i["decision"])))
    return d.withColumn("issues", mildened).drop("repeated", *[c for c in d.columns if c.startswith("_")])


def score(found: Column) -> Column:
    points = lambda i: reduce(lambda c, kv: c.when(i["severity"] == kv[0], kv[1]), POINTS.items(), F)
    return F.aggregate(found, F.lit(0), lambda total, i: total + points(i).otherwise(1))


def decision(found: Column) -> Column:
    """'mild' issues are of a code that rejects elsewhere, and only ask for review here."""
    rejected = F.exists(found, lambda i: (i["decision"] == "reject") | (i["code"].isin(*REJECT_CODES) & (i["decision"] != "mild")))
    return F.when(rejected, "reject").when(F.size(found) > 0, "review").otherwise("pass")
