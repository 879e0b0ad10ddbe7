"""The rule classifier over notices: each document's text follows one of the notices listed here."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions.images import average_hashes
from noticeloom.operators import classifier as K
from noticeloom.sources.tables import table

#: title, category, summary, site, board, url; the content is the document's text.
NOTICES = [
    ("청년 취업 교육 수강생 모집", "교육", "직무 멘토링과 자격증", "마포구", "공지", "https://a.example/1"), ("", "", "", "", "", ""), ("어르신 건강 체조", "복지", "보건소 운동", "강남구청", "", ""),
    ("소상공인 자금 지원", "", "창업 기업 컨설팅 IR", "", "", "https://mapo.go.kr/x"), ("온라인 전시 안내", "행사", "", "문화재단", "", ""), ("서울 청소년 상담", "청소년", "위기 상담 4050 여성", "서울청년센터 강동", "송파구", ""),
    ("알림", "안전", "", "", "", ""), ("부모와 아동 체험", " 문화 ", "어린이 초등 3 학년 만 19 세 만 34세 만39세", "노원구 도봉구 동작구", "", ""), ("스타트업 투자", "", "", "금천구 가산", "", "독산"),
]
_FIELDS = ("title", "category", "summary", "site", "board", "url")


def z14_rule_classifier(spark, sf_dir):
    s = spark.createDataFrame([(k, *n) for k, n in enumerate(NOTICES)], "k int, " + ", ".join(f"{f} string" for f in _FIELDS))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.pmod("doc_id", F.lit(len(NOTICES))).cast("int").alias("k")).join(F.broadcast(s), "k")
    c = K.classify_notices(d)
    shown = lambda name: F.array_join(F.transform(name, lambda x: F.concat(x["code"], F.lit("="), F.format_number(x["confidence"], 2))), " ")
    return c.select("id", shown("categories").alias("categories"), shown("regions").alias("regions"), shown("audiences").alias("audiences"), F.array_join("issues", " ").alias("issues"), F.round("confidence", 2).alias("confidence"))


def v05_average_hash(spark, sf_dir):
    """Each document's digests as the gray values of an image of 16 by 16 pixels, stored without compression."""
    d, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    cells = F.concat(F.sha2(text.cast("binary"), 256), F.sha2(F.concat(text, F.lit("x")).cast("binary"), 256))
    line = lambda k: F.concat(F.lit("00"), F.regexp_replace(F.substring(cells, 16 * k + 1, 16), "(..)", "$1$1"))
    rows = F.concat(*[line(k) for k in range(8) for _ in range(2)])
    size = 16 * 17
    packed = F.concat(F.lit(f"780101{size.to_bytes(2, 'little').hex()}{(65535 - size).to_bytes(2, 'little').hex()}"), rows)
    png = F.concat(F.lit("89504e470d0a1a0a0000000d49484452" + "00000010" * 2 + "0800000000" + "00000000" + f"{size + 7:08x}" + "49444154"), packed, F.lit("00000000"))
    return d.select("doc_id", average_hashes(F.unhex(png)).alias("hash"))


QUERIES = {"v05_average_hash": v05_average_hash, "z14_rule_classifier": z14_rule_classifier}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ROWS = "(VALUES " + ", ".join(f"({k}, {', '.join(map(_q, n))})" for k, n in enumerate(NOTICES)) + f") AS v(k, {', '.join(_FIELDS)})"
_POINTS = " + ".join("len(list_filter([" + "{words}" + f"], lambda w: contains(lower(trim(regexp_replace({f}, '\\s+', ' ', 'g'))), w))) * {w}" for f, w in K.WEIGHTS.items())
_EACH = ", ".join(f"(SELECT struct_pack(n := {_POINTS.format(words=', '.join(_q(w.lower()) for w in words))} + CASE WHEN trim(category) IN ({', '.join(_q(s) for s, m in K.SOURCE_CATEGORIES.items() if m == c) or _q('-')}) THEN 9 ELSE 0 END, own := trim(category) IN ({', '.join(_q(s) for s, m in K.SOURCE_CATEGORIES.items() if m == c) or _q('-')}), place := {k}, code := '{c}'))" for k, (c, words) in enumerate(K.CATEGORIES.items()))
_HITS = ", ".join(f"struct_pack(n := least(4, len(list_filter([{', '.join(map(_q, words))}], lambda w: contains(place_text, w)))), place := {k}, code := '{r}')" for k, (r, words) in enumerate(K.REGIONS.items()))
_SIGNS = ", ".join(f"struct_pack(code := '{a}', n := least(4, {' + '.join('CAST(regexp_matches(whom, ' + _q(p.replace('(?!몽땅정보통)', '($|[^몽])')) + ') AS INT)' for p in patterns)}))" for a, patterns in K.AUDIENCES.items())
_NUMBER = lambda x: f"printf('%.2f', {x})"
_SURE = "greatest(0.25, least(0.95, round({raw}, 2)))"
_VALUE = "(strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1"
SQL = {
    "v05_average_hash": f"""SELECT doc_id, array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', CAST(1 + 8 * b[4 * k + 1] + 4 * b[4 * k + 2] + 2 * b[4 * k + 3] + b[4 * k + 4] AS BIGINT), 1)), '') AS hash
        FROM (SELECT doc_id, list_transform(v, lambda x: CAST(64 * x > list_sum(v) AS INT)) AS b FROM (SELECT doc_id, list_transform(range(64), lambda i: {_VALUE}) AS v FROM (SELECT doc_id, sha256(coalesce(text, '')) || sha256(coalesce(text, '') || 'x') AS h FROM documents)))""",
    "z14_rule_classifier": f"""
        WITH n AS (SELECT doc_id AS id, coalesce(text, '') AS content, v.* FROM documents JOIN {_ROWS} ON v.k = doc_id % {len(NOTICES)}),
        t AS (SELECT *, array_to_string(list_filter([title, content, summary, site, board, category, url], lambda x: x <> ''), ' ') AS place_text, trim(regexp_replace(array_to_string(list_filter([title, summary, content, category], lambda x: x <> ''), ' '), '\\s+', ' ', 'g')) AS whom FROM n),
        r AS (SELECT id, place_text, list_sort(list_transform(list_filter([{_EACH}], lambda e: e.n >= 3), lambda e: {{'a': -e.n, 'b': CASE WHEN e.own THEN 0 ELSE 1 END, 'c': e.place, 'code': e.code}})) AS cats,
                     list_sort(list_transform(list_filter([{_HITS}], lambda e: e.n > 0), lambda e: {{'a': -e.n, 'c': e.place, 'code': e.code}}))[1:2] AS regs, list_filter([{_SIGNS}], lambda e: e.n > 0) AS auds FROM t),
        f AS (SELECT *, -cats[1].a AS top, coalesce(-cats[2].a, 0) AS second FROM r),
        g AS (SELECT *, len(cats) > 1 AND top - second <= 2 AS near, 0.42 + least(top, 18) / 30.0 + least(greatest(top - second, 0), 8) / 28.0 AS raw FROM f),
        h AS (SELECT id, auds, regs, near, len(cats) AS m, CASE WHEN len(cats) = 0 THEN 0.35 ELSE {_SURE.format(raw='CASE WHEN near THEN least(raw, 0.58) ELSE raw END')} END AS c1,
                     coalesce(cats[1].code, 'CAT_OTHER') AS code1, CASE WHEN second >= 5 AND second >= 0.65 * top THEN ' ' || cats[2].code || '=' || {_NUMBER(_SURE.format(raw='0.42 + least(second, 18) / 30.0'))} ELSE '' END AS two,
                     CASE WHEN len(regs) > 0 THEN list_transform(regs, lambda e: {{'code': e.code, 's': least(CASE WHEN len(regs) > 1 THEN 0.72 ELSE 0.95 END, round(0.68 - 0.07 * e.a, 2))}}) WHEN regexp_matches(place_text, '전국|온라인|비대면') THEN [{{'code': 'REG_NATION', 's': 0.72}}]
                          WHEN regexp_matches(place_text, '서울|youth\\.seoul\\.go\\.kr') THEN [{{'code': 'REG_SEOUL', 's': 0.64}}] ELSE [] END AS places FROM g)
        SELECT id, code1 || '=' || {_NUMBER('c1')} || two AS categories, array_to_string(list_transform(places, lambda e: e.code || '=' || {_NUMBER('e.s')}), ' ') AS regions,
               array_to_string(list_transform(auds, lambda e: e.code || '=' || {_NUMBER('least(0.94, 0.58 + e.n * 0.1)')}), ' ') AS audiences,
               array_to_string(list_filter([CASE WHEN m = 0 OR c1 < 0.58 THEN 'low-category-confidence' WHEN near THEN 'ambiguous-category' END, CASE WHEN len(places) = 0 THEN 'missing-region' WHEN len(regs) > 1 THEN 'ambiguous-region' END], lambda x: x IS NOT NULL), ' ') AS issues,
               round(least(c1, CASE WHEN len(places) > 0 THEN places[1].s ELSE 0 END, CASE WHEN len(auds) > 0 THEN least(0.94, 0.58 + auds[1].n * 0.1) ELSE 1 END), 2) AS confidence FROM h""",
}
