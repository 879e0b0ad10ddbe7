"""Text, address, date, vector and hash functions over documents, pages, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions import dates as D
from noticeloom.functions import text as X
from noticeloom.functions import urls as L
from noticeloom.sources.tables import ORDERS_NOW, table

_NOW = f"TIMESTAMP '{ORDERS_NOW}'"


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "source", F.split("text", "\n")[0].alias("title"), F.coalesce(F.get(F.split("text", "\n"), 1), F.lit("")).alias("other"))


_D = "(SELECT doc_id, text, source, string_split(text, chr(10))[1] AS title, coalesce(string_split(text, chr(10))[2], '') AS other FROM documents)"
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '[「」『』“”\"'']', '', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _now():
    return F.lit(ORDERS_NOW).cast("timestamp_ntz")


def _text(name, fn):
    def query(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", fn().alias(name))
    return query


def x01_normalized_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.normalized(F.col("text")).alias("normalized"))


def x01_normalized_compatibility(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.normalized(F.col("text"), True).alias("normalized"))


def x02_title_key(spark, sf_dir):
    korean = F.concat(F.lit("서울 "), F.col("title"), F.lit(" 참여자 모집 안내 매주 월요일"))
    return _docs(spark, sf_dir).select("doc_id", X.title_key(korean, F.lit("서울")).alias("title_key"))


def x03_org_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.org_key(F.concat(F.lit("사단법인 "), F.col("source"), F.lit(" 재단법인"))).alias("org_key"))


def x04_bigrams(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(X.bigrams(F.col("title")), "|").alias("grams"))


def x05_dice(spark, sf_dir):
    a, b = X.normalized(F.col("title")), X.normalized(F.col("other"))
    return _docs(spark, sf_dir).select("doc_id", F.round(X.dice(X.bigrams(a), X.bigrams(b)), 6).alias("dice"))


def x06_jaccard(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(X.token_jaccard(X.normalized(F.col("title")), X.normalized(F.col("other"))), 6).alias("jaccard"))


def x07_similarity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(X.similarity(X.normalized(F.col("title")), X.normalized(F.col("other"))), 6).alias("similarity"))


def x08_grounding(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", (X.grounding(F.col("other"), F.col("title")) >= 0.4).alias("grounded"))


def x14_encoded_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.col("text").rlike("[A-Za-z0-9+/]{160,}={0,2}").alias("encoded"), F.col("text").rlike("�").alias("broken"))


def x18_slug(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.slug(F.col("title")).alias("slug"))


def x19_compact(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.nullif(F.substring(F.trim("title"), 1, 20), F.lit("")).alias("short"))


def x20_name_id(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.name_id("org-", F.col("s_name")).alias("org_id"))


def x21_content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def f10_search_term(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.search_term(F.col("text")).alias("term"))


def v03_embedding_input(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.substring(F.concat_ws("\n", "title", "source", "text"), 1, 4000).alias("input"))


def v06_hamming(spark, sf_dir):
    h = lambda c: F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 16)
    return table(spark, sf_dir, "part").select("p_partkey", X.hamming(h("p_partkey"), h("p_size")).alias("distance"))


def v10_confidence(spark, sf_dir):
    score, margin = F.col("p_size").cast("double"), F.pmod("p_partkey", F.lit(12)).cast("double") - 2
    c = 0.42 + F.least(score, F.lit(18.0)) / 30 + F.least(F.greatest(margin, F.lit(0.0)), F.lit(8.0)) / 28
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.greatest(F.lit(0.25), F.least(F.lit(0.95), c)), 2).alias("confidence"))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def l01_host(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", L.host(F.col("url")).alias("host"))


def l02_directory(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", L.directory(F.col("url")).alias("directory"))


def l03_source_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", L.source_url(F.col("url")).alias("source_url"))


def l04_source_key(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", L.source_key(F.col("url")).alias("source_key"))


def l05_image_identity(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", L.image_identity(F.concat("url", F.lit("&w=100&Quality=3"))).alias("identity"))


def _links(spark, sf_dir):
    tails = ("/apply/1", "/notice?id=3", "/forms/about", "/viewform?x=1", "/booking")
    hosts = ("https://forms.gle", "https://www.example.com", "https://docs.google.com", "https://form.naver.com", "https://pf.kakao.com")
    k = F.col("page_id").cast("int")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), F.pmod(n, F.lit(5)) + 1)
    label = F.when(k % 4 == 0, "신청하기").when(k % 4 == 1, "Apply now").otherwise("details")
    return _pages(spark, sf_dir).select("page_id", F.concat(pick(hosts, k), pick(tails, F.floor(k / 5).cast("int"))).alias("link"), label.alias("label"))


_LINKS = """(SELECT page_id, ['https://forms.gle', 'https://www.example.com', 'https://docs.google.com', 'https://form.naver.com', 'https://pf.kakao.com'][page_id % 5 + 1]
  || ['/apply/1', '/notice?id=3', '/forms/about', '/viewform?x=1', '/booking'][page_id // 5 % 5 + 1] AS link, CASE page_id % 4 WHEN 0 THEN '신청하기' WHEN 1 THEN 'Apply now' ELSE 'details' END AS label FROM pages)"""
_APPLY = """CASE WHEN link LIKE 'https://pf.kakao.com%' THEN false WHEN link LIKE '%docs.google.com/forms/about' THEN false WHEN label <> 'details' THEN true WHEN link LIKE 'https://forms.gle%' OR link LIKE 'https://form.naver.com%' THEN true
  ELSE regexp_matches(link, '/(apply|booking)(/|$)|/viewform\\?|^https://[^/]+/forms/') END"""


def l06_application_link(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", L.is_application_link(F.col("link"), F.col("label")).alias("application"))


def l07_short_link(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", L.short_link(F.col("link")).alias("short"))


def l08_link_type(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", L.link_type(F.when(F.col("page_id") % 3 == 0, "homepage"), F.col("link"), F.col("label")).alias("type"))


def l12_query_param(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", L.query_param(F.col("url"), "utm_source").alias("utm"), L.query_param(F.col("url"), "page").alias("page"))


def a22_duplicate_keys(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", L.source_url(F.col("url")).alias("key"))
    counts = p.where("key <> ''").groupBy("key").agg(F.count("*").alias("same_source"))
    return p.join(counts, "key", "left").select("page_id", F.coalesce("same_source", F.lit(0)).alias("same_source"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", (F.col("o_orderdate") - F.expr("INTERVAL 10 DAYS")).alias("start_at"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderdate")).alias("end_at"))


_O = "(SELECT o_orderkey, o_orderpriority, o_custkey, o_orderdate - INTERVAL 10 DAY AS start_at, CASE WHEN o_custkey % 7 <> 0 THEN o_orderdate END AS end_at FROM orders)"


def d11_application_state(spark, sf_dir):
    kind = F.when(F.col("o_custkey") % 2 == 0, "상시").otherwise("")
    start = F.when(F.col("end_at").isNotNull(), F.col("start_at"))
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", D.application_state(start, F.col("end_at"), kind, _now()).alias("state"), F.coalesce(D.kst_days_left(F.col("end_at"), _now()), F.lit(9999)).alias("days_left"))


def d12_period_label(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", D.period_label(F.col("start_at"), F.col("end_at")).alias("label"))


def d13_candidate_status(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", D.candidate_status(F.col("start_at"), F.col("end_at"), _now()).alias("status"))


def d03_due_tomorrow(spark, sf_dir):
    return _orders(spark, sf_dir).where(D.kst_days_left(F.col("end_at"), _now()) == 1).select("o_orderkey", "end_at")


def d14_compact_date(spark, sf_dir):
    text = F.concat(F.date_format("start_at", "yyyyMM"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return _orders(spark, sf_dir).select("o_orderkey", D.compact_date(text).cast("string").alias("day"))


def d15_deadline_type(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, ("fixed", "상시", "소진 시", "예정", ""))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", D.deadline_type(v).alias("kind"))


def d05_full_dates(spark, sf_dir):
    text = F.concat(F.lit("접수 "), F.date_format("start_at", "yyyy.MM.dd"), F.lit(" ~ "), F.date_format("end_at", "yyyy년 M월 d일"), F.lit(" / 2001.02.30"))
    return _orders(spark, sf_dir).where("end_at IS NOT NULL").select("o_orderkey", F.array_join(F.transform(D.full_dates(text), lambda d: d.cast("string")), ",").alias("dates"))


def f15_stale(spark, sf_dir):
    text = F.concat(F.lit("year "), F.year("start_at").cast("string"))
    return _orders(spark, sf_dir).select("o_orderkey", D.is_stale(text, F.to_date("start_at"), F.to_date(_now()), F.col("o_custkey") % 5 == 0).alias("stale"))


def s07_readable_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.readable(F.col("html")).alias("text"))


def s08_page_urls(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("base"))
    return p.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat("base", F.lit("?page="), i.cast("string")))).alias("page_url"))


def s09_link_template(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.regexp_replace("url", r"^https?://([^/]+)/(.*)$", "https://mirror.example/$1?path=$2").alias("link"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "adflsvx" and k[1:3].isdigit()}
_SORTED = lambda drop, blank: f"list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({list(drop)}, string_split(p, '=')[1]){blank}))"
_REBUILT = lambda params: f"regexp_replace(url, '[?#].*$', '') || CASE WHEN len({params}) = 0 THEN '' ELSE '?' || array_to_string({params}, '&') END"
_KEY_URL = f"lower({_REBUILT(_SORTED(L.SOURCE_URL_PARAMS, ''))})"
_T, _OT = _NORM("title"), _NORM("other")
_GRAMS = lambda c: f"list_transform(generate_series(1, greatest(length({c}) - 1, 1)), lambda i: substring({c}, i, 2))"
_DICE = """CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE 2.0 * list_sum(list_transform(list_distinct(ga), lambda g: least(len(list_filter(ga, lambda x: x = g)), len(list_filter(gb, lambda x: x = g))))) / (len(ga) + len(gb)) END"""
_JAC = """CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(wa, wb))::DOUBLE / len(list_distinct(list_concat(wa, wb))) END"""
_PAIR = f"""(SELECT *, {_GRAMS('a')} AS ga, {_GRAMS('b')} AS gb, list_distinct(list_filter(string_split_regex(ta, '\\s+'), lambda w: length(w) >= 2)) AS wa, list_distinct(list_filter(string_split_regex(tb, '\\s+'), lambda w: length(w) >= 2)) AS wb
  FROM (SELECT doc_id, {_T} AS ta, {_OT} AS tb, regexp_replace({_T}, '\\s+', '', 'g') AS a, regexp_replace({_OT}, '\\s+', '', 'g') AS b FROM {_D}))"""
_READ = r"regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript|nav\b.*?</nav|footer\b.*?</footer|header\b.*?</header)\s*>', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article)\s*>', chr(10), 'g')"
_LEFT = f"date_diff('day', CAST({_NOW} + INTERVAL 9 HOUR AS DATE), CAST(end_at + INTERVAL 9 HOUR AS DATE))"
SQL = {
    "x01_normalized_text": f"SELECT doc_id, {_NORM('text')} AS normalized FROM {_D}",
    "x02_title_key": f"SELECT doc_id, trim({_T}) AS title_key FROM {_D}",
    "x03_org_key": f"SELECT doc_id, lower(source) AS org_key FROM {_D}",
    "x04_bigrams": f"SELECT doc_id, CASE WHEN t = '' THEN '' ELSE array_to_string({_GRAMS('t')}, '|') END AS grams FROM (SELECT doc_id, regexp_replace(title, '\\s+', '', 'g') AS t FROM {_D})",
    "x05_dice": f"SELECT doc_id, round({_DICE}, 6) AS dice FROM {_PAIR}",
    "x06_jaccard": f"SELECT doc_id, round({_JAC}, 6) AS jaccard FROM {_PAIR}",
    "x07_similarity": f"SELECT doc_id, round(CASE WHEN ta = '' OR tb = '' THEN 0.0::DOUBLE WHEN ta = tb THEN 1.0 ELSE greatest({_DICE}, {_JAC}) END, 6) AS similarity FROM {_PAIR}",
    "x08_grounding": f"""SELECT doc_id, CASE WHEN b = '' THEN false ELSE len(list_filter(list_distinct({_GRAMS('b')}), lambda g: contains(a, g))) >= 0.4 * len(list_distinct({_GRAMS('b')})) END AS grounded
        FROM (SELECT doc_id, regexp_replace(lower(title), '\\s+', '', 'g') AS a, regexp_replace(lower(other), '\\s+', '', 'g') AS b FROM {_D})""",
    "x14_encoded_text": "SELECT doc_id, regexp_matches(text, '[A-Za-z0-9+/]{160,}={0,2}') AS encoded, contains(text, chr(65533)) AS broken FROM documents",
    "x18_slug": f"SELECT doc_id, regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {_D}",
    "x19_compact": f"SELECT doc_id, nullif(substring(trim(title), 1, 20), '') AS short FROM {_D}",
    "x20_name_id": "SELECT s_suppkey, 'org-' || substring(md5(lower(trim(s_name))), 1, 16) AS org_id FROM supplier",
    "x21_content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "f10_search_term": "SELECT doc_id, substring(trim(regexp_replace(regexp_replace(text, '[,%_()*]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 80) AS term FROM documents",
    "v03_embedding_input": f"SELECT doc_id, substring(concat_ws(chr(10), title, source, text), 1, 4000) AS input FROM {_D}",
    "v06_hamming": "SELECT p_partkey, CAST(bit_count(xor(('0x' || substring(md5(p_partkey::VARCHAR), 1, 16))::UBIGINT, ('0x' || substring(md5(p_size::VARCHAR), 1, 16))::UBIGINT)) AS INT) AS distance FROM part",
    "v10_confidence": "SELECT p_partkey, round(greatest(0.25, least(0.95, CAST(0.42 AS DOUBLE) + least(p_size, 18)::DOUBLE / 30 + least(greatest(p_partkey % 12 - 2, 0), 8)::DOUBLE / 28)), 2) AS confidence FROM part",
    "l01_host": "SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^https?://([^/?#]+)', 1), ':[0-9]+$', ''), '^www\\.', ''), '') AS host FROM pages",
    "l02_directory": "SELECT page_id, nullif(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '[^/]*$', ''), '') AS directory FROM pages",
    "l03_source_url": f"SELECT page_id, {_KEY_URL} AS source_url FROM pages",
    "l04_source_key": "SELECT page_id, " + _REBUILT(_SORTED(L.SOURCE_KEY_PARAMS, " AND regexp_extract(p, '^[^=]*=(.*)$', 1) <> ''")) + " AS source_key FROM pages",
    "l05_image_identity": f"SELECT page_id, lower({_REBUILT(_SORTED(L.IMAGE_PARAMS, ''))}) AS identity FROM (SELECT page_id, url || '&w=100&Quality=3' AS url FROM pages)",
    "l06_application_link": f"SELECT page_id, {_APPLY} AS application FROM {_LINKS}",
    "l07_short_link": f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://forms.gle/' || t WHEN 4 THEN 'https://pf.kakao.com/' || t || '/' ELSE link END AS short FROM (SELECT page_id, link, ['apply', 'notice', 'forms', 'viewform', 'booking'][CAST(floor(page_id / 5) AS INT) % 5 + 1] AS t FROM {_LINKS})",
    "l08_link_type": f"SELECT page_id, CASE WHEN {_APPLY} THEN 'official_apply' WHEN page_id % 3 = 0 THEN 'homepage' ELSE 'other' END AS type FROM {_LINKS}",
    "l12_query_param": "SELECT page_id, CASE WHEN regexp_matches(url, '[?&]utm_source=') THEN regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) END AS utm, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page FROM pages",
    "a22_duplicate_keys": f"SELECT page_id, count(*) OVER (PARTITION BY {_KEY_URL}) AS same_source FROM pages",
    "d11_application_state": f"""SELECT o_orderkey, CASE WHEN end_at IS NOT NULL AND CAST(start_at + INTERVAL 9 HOUR AS DATE) > CAST({_NOW} + INTERVAL 9 HOUR AS DATE) THEN 'scheduled' WHEN days_left < 0 THEN 'closed' WHEN days_left = 0 THEN 'due_today'
        WHEN days_left <= 3 THEN 'closing_soon' WHEN days_left IS NOT NULL THEN 'open' WHEN o_custkey % 2 = 0 THEN 'ongoing' ELSE 'needs_confirmation' END AS state, CAST(coalesce(days_left, 9999) AS INT) AS days_left FROM (SELECT *, {_LEFT} AS days_left FROM {_O})""",
    "d12_period_label": f"SELECT o_orderkey, CASE WHEN end_at IS NULL THEN strftime(start_at + INTERVAL 9 HOUR, '%Y.%m.%d') || ' ~' ELSE strftime(start_at + INTERVAL 9 HOUR, '%Y.%m.%d') || ' ~ ' || strftime(end_at + INTERVAL 9 HOUR, '%Y.%m.%d') END AS label FROM {_O}",
    "d13_candidate_status": f"SELECT o_orderkey, CASE WHEN end_at < {_NOW} THEN 'closed' WHEN start_at > {_NOW} THEN 'before' ELSE 'open' END AS status FROM {_O}",
    "d03_due_tomorrow": f"SELECT o_orderkey, end_at FROM {_O} WHERE {_LEFT} = 1",
    "d14_compact_date": f"SELECT o_orderkey, CAST(CAST(try_strptime(strftime(start_at, '%Y%m') || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0'), '%Y%m%d') AS DATE) AS VARCHAR) AS day FROM {_O}",
    "d15_deadline_type": f"SELECT o_orderkey, ['fixed', 'ongoing', 'until_exhausted', 'scheduled', 'unknown'][o_orderkey % 5 + 1] AS kind FROM {_O}",
    "d05_full_dates": f"SELECT o_orderkey, CAST(CAST(start_at AS DATE) AS VARCHAR) || ',' || CAST(CAST(end_at AS DATE) AS VARCHAR) AS dates FROM {_O} WHERE end_at IS NOT NULL",
    "f15_stale": f"SELECT o_orderkey, o_custkey % 5 <> 0 AND (year(start_at) < year({_NOW}) - 1 OR date_diff('day', CAST(start_at AS DATE), CAST({_NOW} AS DATE)) > 540) AS stale FROM {_O}",
    "s08_page_urls": "SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?page=' || i AS page_url FROM pages, generate_series(1, 3) g(i)",
    "s09_link_template": r"SELECT page_id, regexp_replace(url, '^https?://([^/]+)/(.*)$', 'https://mirror.example/\1?path=\2') AS link FROM pages",
}
