"""Cases of single functions and operators."""

import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.functions import applications
from noticeloom.functions import dates as D
from noticeloom.functions import notices
from noticeloom.functions import text as X
from noticeloom.functions import urls as L
from noticeloom.functions import vectors as V
from noticeloom.operators import changes, duplicates, kpi, quality_gate, rules, traffic
from noticeloom.operators.recommend import Person, recommend
from noticeloom.sources import files, html
from noticeloom.streaming import suppression


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("end,now,state,left", [
    ("2026-08-04 15:30:00", "2026-08-04 16:00:00", "due_today", 0), ("2026-08-06 14:59:59", "2026-08-04 03:00:00", "closing_soon", 2),
    ("2026-08-06 15:00:00", "2026-08-04 03:00:00", "closing_soon", 3), ("2026-08-03 14:59:59", "2026-08-04 03:00:00", "closed", -1), ("2026-09-01 00:00:00", "2026-08-04 03:00:00", "open", 28),
])
def test_application_state(spark, end, now, state, left):
    r = one(spark, s=D.application_state(F.lit(None).cast("timestamp_ntz"), at(end), F.lit(""), at(now)), d=D.kst_days_left(at(end), at(now)))
    assert (r["s"], r["d"]) == (state, left)


def test_state_without_an_end(spark):
    none = F.lit(None).cast("timestamp_ntz")
    r = one(spark, a=D.application_state(none, none, F.lit("상시"), at("2026-01-01")), b=D.application_state(none, none, F.lit(None).cast("string"), at("2026-01-01")))
    assert (r["a"], r["b"]) == ("ongoing", "needs_confirmation")


def test_korean_day(spark):
    r = one(spark, a=D.kst_day_start(at("2026-08-04 13:25:00")), b=D.kst_date(at("2026-08-04 14:59:59")), c=D.kst_date(at("2026-08-04 15:00:00")))
    assert (str(r["a"]), str(r["b"]), str(r["c"])) == ("2026-08-03 15:00:00", "2026-08-04", "2026-08-05")


def test_dates_that_do_not_exist(spark):
    r = one(spark, a=D.full_dates(F.lit("2026.02.10 ~ 2026.02.20, 2026.02.30")), b=D.compact_date(F.lit("20260230")), c=D.compact_date(F.lit("20260228")))
    assert [str(d) for d in r["a"]] == ["2026-02-10", "2026-02-20"] and r["b"] is None and str(r["c"]) == "2026-02-28"


@pytest.mark.parametrize("url,key", [
    ("HTTPS://A.example/x?b=2&page=3&a=1#top", "https://a.example/x?a=1&b=2"), ("https://a.example/x?utm_source=z", "https://a.example/x"), ("", ""), ("not a url", "not a url"),
])
def test_source_url(spark, url, key):
    assert one(spark, k=L.source_url(F.lit(url)))["k"] == key


@pytest.mark.parametrize("url,label,expected", [
    ("https://forms.gle/abc", "", True), ("https://example.com/apply/1", "", True), ("https://example.com/notice", "신청하기", True), ("https://example.com/notice", "more", False),
    ("https://open.kakao.com/apply", "apply", False), ("https://docs.google.com/forms/d/1", "", True), ("https://docs.google.com/forms/about", "apply", False), ("", "apply", False),
])
def test_application_link(spark, url, label, expected):
    assert one(spark, k=L.is_application_link(F.lit(url), F.lit(label)))["k"] is expected


def test_similarity_is_symmetric_and_bounded(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcd ") for _ in range(r.randint(0, 12))).strip()
    rows = spark.createDataFrame([(word(), word()) for _ in range(60)], "a string, b string")
    both = rows.select(X.similarity(F.col("a"), F.col("b")).alias("x"), X.similarity(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(t["x"] == t["y"] and 0 <= t["x"] <= 1 for t in both)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB가 -'\"()!9", max_size=12), min_size=1, max_size=8))
def test_normalizing_twice_changes_nothing(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    once = rows.select(X.normalized(F.col("v")).alias("n")).select("n", X.normalized(F.col("n")).alias("m"))
    assert all(r["n"] == r["m"] for r in once.collect())


def test_hash_distance(spark):
    r = one(spark, a=X.hamming(F.lit("0" * 16), F.lit("f" * 16)), b=X.hamming(F.lit("00000000000000ff"), F.lit("0" * 16)), c=X.hamming(F.lit("zz"), F.lit("0" * 16)))
    assert (r["a"], r["b"], r["c"]) == (64, 8, 64)


def test_vectors_without_length(spark):
    r = one(spark, a=V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), b=V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))), c=V.is_valid(F.array(F.lit(float("nan")))))
    assert r["a"] is None and r["b"] == pytest.approx(1) and r["c"] is False


def test_actors(spark):
    bot = F.lit("Googlebot")
    source = traffic.automation_source(bot, F.lit(False), F.lit(""))
    r = one(spark, a=traffic.actor(F.lit("admin"), source.isNotNull(), traffic.is_bot(bot), F.lit("visitor")), b=traffic.actor(F.lit(None).cast("string"), source.isNotNull(), traffic.is_bot(bot), F.lit("visitor")), c=source, d=traffic.automation_source(F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(" ci ")))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("admin", "bot", "bot-user-agent", "ci")


def test_gates_at_their_bounds(spark):
    metrics = spark.createDataFrame([("a", 99.0), ("b", 19.9)], "metric string, actual double")
    limits = spark.createDataFrame([("a", "min", 99.0), ("b", "min", 20.0), ("c", "max", 1.0)], "metric string, comparison string, threshold double")
    got = {r["metric"]: (r["passed"], r["reason"]) for r in kpi.gates(metrics, limits).collect()}
    assert got == {"a": (True, None), "b": (False, "below"), "c": (False, "missing")}


def test_quality_gate(spark):
    kind = "id long, title string, org string, summary string, source_url string, images array<string>, links array<struct<url:string,label:string,type:string>>, text_only boolean, is_poster boolean, poster_confidence double, same_notice boolean, match_confidence double, deadline string"
    rows = [
        (1, "청년 창업 교육생 모집", "서울시", "교육 프로그램 참여자를 모집합니다. 자세한 내용은 본문을 참고하세요.", "https://a.example/1", ["https://a.example/p.jpg"], [], False, None, None, None, None, None),
        (2, "공지사항", "", "x", "", [], None, None, None, None, None, None, None), (3, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r["id"]: r for r in quality_gate.gate(spark.createDataFrame(rows, kind)).collect()}
    assert got[1]["decision"] == "pass" and got[2]["decision"] == "reject"
    assert {i["code"] for i in got[2]["issues"]} == {"missing-org", "weak-summary", "missing-source", "missing-image", "generic-title"}
    assert {i["code"] for i in got[3]["issues"]} == {"missing-title", "missing-org", "weak-summary", "missing-source", "missing-image", "generic-title"} and got[3]["score"] == 26


def _prints(spark, *rows):
    """Rows of (title, org, source, image, hash, deadline, attachment, form); several values of one kind are joined by blanks."""
    kind = "id long, title string, org string, source_url string, image string, image_hash string, deadline string, attachment string, form_url string"
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kind)
    many = {"source_urls": "source_url", "images": "image", "image_hashes": "image_hash", "attachments": "attachment", "forms": "form_url"}
    return duplicates.fingerprints(d.select("id", "title", "org", "deadline", *[F.split(c, " ").alias(name) for name, c in many.items()]))


@pytest.mark.parametrize("left,right,decision", [
    (("a", "o", "u1", "", "", "", "", ""), ("b", "p", "u1", "", "", "", "", ""), "merge"),
    (("청년 예술 캠프 2026", "마포구", "1", "", "00ff00ff00ff00ff", "", "", ""), ("청년 예술 캠프 2026", "마포구", "2", "", "00ff00ff00ff00fe", "", "", ""), "merge"),
    (("봄맞이 정원 산책", "", "1", "", "00ff00ff00ff00ff", "", "", ""), ("겨울 바다 여행기", "", "2", "", "00ff00ff00ff00ff", "", "", ""), "none"),
    (("청년 예술 캠프 2026", "마포구", "1", "img", "", "", "", ""), ("청년 예술 캠프 2026", "다른기관", "2", "img", "", "", "", ""), "merge"),
    (("청년 예술 캠프 2026", "마포구", "1", "", "", "d", "", ""), ("전혀 다른 제목입니다", "마포구", "2", "", "", "d", "", ""), "none"),
])
def test_duplicate_decision(spark, left, right, decision):
    p = _prints(spark, left, right)
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    assert duplicates.score_pairs(pairs, p).first()["decision"] == decision


def test_near_hashes_share_a_band(spark):
    p = _prints(spark, ("x", "", "", "", "00ff00ff00ff00ff", "", "", ""), ("y", "", "", "", "00ff00ff00ff03f0", "", "", ""), ("z", "", "", "", "", "", "", ""))
    assert [tuple(r) for r in duplicates.candidate_pairs(p, words=False).collect()] == [(0, 1)]


def test_candidates_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 5)
    r = random.Random(7)
    syllables = ["seoul", "art", "camp", "youth", "garden", "walk", "2026", "spring", "music", "of the", "청년", "예술"]
    titles = [" ".join(r.choices(syllables, k=r.randint(1, 7))) for _ in range(25)]
    titles += [t[:k] + r.choice("xyz ") + t[k + 1:] for t in titles for k in [r.randrange(len(t))]]
    hashes = [f"{r.getrandbits(64):016x}" for _ in range(6)]
    near = lambda: f"{int(r.choice(hashes), 16) ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 9, 10, 11]))):016x}"
    several = lambda *kinds: " ".join(r.choices(kinds, k=r.randint(0, 2)))
    p = _prints(spark, *[(r.choice(titles), r.choice(["src1", "src10", "src11", "mapo district office", "mapo district offices", ""]), f"u{r.randrange(150)} v{r.randrange(150)}", several(*(f"i{k}" for k in range(90))),
                          f"{near()} {near()}" if i % 3 == 0 else "", r.choice(["d", "e", ""]), several(*(f"a{k}" for k in range(60))), several("f1", "f2", "https://forms.gle/x", *(f"f{k}" for k in range(9, 40)))) for i in range(140)]).cache()
    every = p.alias("x").join(p.alias("y"), F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    kept = lambda d: sorted(tuple(x) for x in duplicates.score_pairs(d, p).where(F.col("score") >= duplicates.FLOOR).select("a", "b", "score", "decision").collect())
    want = kept(every)
    assert len(want) > 200 and {d for *_, d in want} == {"merge", "review", "none"} and kept(duplicates.candidate_pairs(p)) == want


def test_dated_pairs_are_compared_in_tiles(spark, monkeypatch):
    """Products of matrices give the similarities of single pairs, across tiles, strips and slices of entries; no join on single
    entries takes part, whose rows outgrow the pairs where titles are made of few words."""
    for name, size in (("TILE", 20), ("WIDTH", 16), ("STRIP", 7)):
        monkeypatch.setattr(duplicates, name, size)
    r = random.Random(3)
    titles = [" ".join(r.choices(["art", "arts", "camp", "a", "youth", "ou", "청년", "x" * 90], k=r.randint(1, 8))) for _ in range(60)]
    kind = "id long, title_key string, org_key string, deadline string"
    rows = [(i, r.choice(titles), r.choice(["src1", "src10", "src11", ""]), r.choice("dde")) for i in range(90)]
    d = spark.createDataFrame(rows, kind)
    got = {(x["a"], x["b"]): (x["t"], x["o"]) for x in duplicates.dated_pairs(d).collect()}
    every = d.alias("l").join(d.alias("r"), (F.col("l.id") < F.col("r.id")) & (F.col("l.deadline") == F.col("r.deadline")))
    shares = every.select("l.id", "r.id", duplicates.similarities(F.col("l.title_key"), F.col("r.title_key")), duplicates.similarities(F.col("l.org_key"), F.col("r.org_key"))).collect()
    want = {(a, b): (t, o) for a, b, t, o in shares if any(t >= least and o >= (org or 0) for dated, org, least in duplicates.WAYS if dated)}
    assert len(want) > 100 and got == want
    names = ["", "ab", *titles]
    assert np.allclose(duplicates._shares(names, names)(slice(None))[2:, 2:].diagonal(), 1) and not duplicates._shares(names, names)(slice(None))[0].any()


def test_sites_of_one_place_are_paired_in_several_tasks(spark, monkeypatch):
    from noticeloom.operators import intake

    monkeypatch.setattr(intake, "BLOCK", 8)
    urls = [f"https://a.example/{p}" for p in ("", "en", "en/x", "en/x/y", "de", "enx")]
    rows = spark.createDataFrame([(f"s{i}", None, f"n{i}", urls[i % 6], None) for i in range(60)], "slug string, sites array<string>, name string, list_url string, homepage_url string")
    sites = spark.createDataFrame([(f"t{i}", f"m{i}", urls[i % 6]) for i in range(60)], "site string, name string, url string")
    within = lambda a, b: (b.rstrip("/") + "/").startswith(a.rstrip("/") + "/")
    want = sorted((f"s{i}", f"t{j}") for i in range(60) for j in range(60) if within(urls[i % 6], urls[j % 6]) or within(urls[j % 6], urls[i % 6]))
    assert sorted(tuple(x) for x in intake.source_sites(rows, sites).collect()) == want
    pairs = intake._paired(rows.select("slug", F.lit("h").alias("h")), sites.select("site", F.lit("h").alias("h")), ["h"])
    made = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 1 and sum(x["count"] for x in made) == 3600


def test_alike_titles_alone_reach_z12(spark, tmp_path):
    from noticeloom.plans import curation

    text = "A first line that is shared by both of them, long enough to see\n"
    rows = [(1, text + "x" * 200, "src1", 1000), (2, text + "y" * 200, "src1", 1000), (3, "Something else\n" + "z" * 200, "src2", 2000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r)[:2] + (r["decision"],) for r in curation.z12_duplicate_score(spark, str(tmp_path)).collect() if r["decision"] != "none"] == [(1, 2, "merge")]
    assert [(r["b"], r["a"], r["decision"]) for r in curation.z13_best_duplicate(spark, str(tmp_path)).collect() if r["decision"] != "none"] == [(2, 1, "merge")]


def test_lookup_has_every_notice(spark, data):
    from noticeloom.plans import search

    assert search.j11_lookup_all(spark, data).count() == search._notices(spark, data).count()


def test_best_matches_of_copies(spark):
    r = random.Random(5)
    kinds = [(f"청년 예술 캠프 {i % 3}", "마포구", f"u{i}" if i % 4 else "", "img" if i % 5 == 0 else "", "", "d" if i % 2 else "", f"f{i % 2}", "") for i in range(6)]
    p = _prints(spark, *[r.choice(kinds) for _ in range(40)]).cache()
    members = duplicates.classes(p)
    got = duplicates.best_match(duplicates.scored_classes(p, members), members)
    every = duplicates.score_pairs(duplicates.candidate_pairs(p), p).where(F.col("score") >= duplicates.FLOOR).collect()
    want = {}
    for x in sorted(every, key=lambda x: (x["b"], -x["score"], x["a"])):
        want.setdefault(x["b"], (x["a"], x["score"], x["decision"]))
    assert {x["b"]: (x["a"], x["score"], x["decision"]) for x in got.collect()} == want


@pytest.mark.parametrize("text,deadline,codes,stored", [
    ("모집기간: 2026.07.01 ~ 2026.07.20", "2026-07-20", [], "2026-07-20"), ("신청기간: 2026. 8. 20. ~ 모집시까지, 행사는 추후에 진행 2026. 9. 1.", None, ["open-ended-application-period"], None),
    ("접수기간: 2026.07.20 ~ 2026.07.01", "2026-07-20", ["date-end-before-start", "deadline-mismatch"], "2026-07-01"), ("신청기간: 2026.07.01(월) ~ 2026.07.20", "2026-07-20", ["weekday-mismatch"], "2026-07-20"),
    ("접수기간: 7.1 ~ 7.20 00:00", None, ["date-without-year", "default-midnight-time"], None), ("no dates", "soon", ["invalid-extracted-deadline"], None), (None, None, [], None),
])
def test_date_quality(spark, text, deadline, codes, stored):
    q = one(spark, q=applications.date_quality(F.lit(text).cast("string"), F.lit(deadline).cast("string")))["q"]
    assert (q["issues"], q["stored"] and str(q["stored"])) == (codes, stored)


def test_second_category(spark):
    scores = spark.createDataFrame([(1, "A", 10), (1, "B", 7), (1, "C", 6), (2, "A", 2)], "id long, category string, score long")
    got = [(r["category"], r["rank"], r["ambiguous"]) for r in rules.classify(scores).orderBy("rank").collect()]
    assert got == [("A", 1, False), ("B", 2, False)]


def test_upsert_fills_gaps_only(spark):
    old = spark.createDataFrame([(1, "a", " "), (2, "b", "keep")], "id long, x string, y string")
    new = spark.createDataFrame([(1, None, "new"), (2, "c", "new"), (3, "d", "e")], "id long, x string, y string")
    assert sorted(map(tuple, changes.upsert(old, new, "id", ("y",)).collect())) == [(1, "a", "new"), (2, "c", "keep"), (3, "d", "e")]


def test_recommendation_points(spark):
    n = spark.createDataFrame([(1, [5], "2001-07-03 00:00:00"), (2, [6], None), (3, [6], "2001-06-30 00:00:00")], "id long, institutions array<long>, end_at string").withColumn("end_at", F.col("end_at").cast("timestamp_ntz")).withColumn("embedding", F.lit(None).cast("array<float>"))
    regions = spark.createDataFrame([(1, 7, False), (1, 8, True), (2, 9, True)], "id long, region int, nationwide boolean")
    cats = spark.createDataFrame([(1, "c"), (1, "d")], "id long, category string")
    aud = spark.createDataFrame([(1, 40, None, None), (1, None, 36, None), (2, 40, 50, None)], "id long, min_age int, max_age int, gender string")
    got = recommend(n, regions, cats, aud, Person(7, 35, None, ("c",), (5,)), at("2001-07-01"))
    assert {r["id"]: r["score"] for r in got.collect()} == {1: 45 + 40 + 30 + 20 + 10, 2: 10 - 15}


def test_suppression_stream_agrees_with_the_table(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").where("event_type = 'view'")
    events.where("ts < '2024-01-15'").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    events.where("ts >= '2024-01-15'").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = suppression.let_through_stream(stream, ["user_id"], 24 * 60).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    want = suppression.let_through(events, ["user_id"], 24 * 60)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", b'), (2, "two\nlines"), (3, "")], "id int, text string")
    files.write_csv(rows.coalesce(1), f"{tmp_path}/csv")
    assert sorted((r["id"], r["text"]) for r in files.read_csv(spark, f"{tmp_path}/csv").collect()) == [("1", 'a "quoted", b'), ("2", "two\nlines"), ("3", "")]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>t</title><link>l</link></item><item><title>u</title></item></channel></rss>")
    assert sorted((r["title"], r["link"]) for r in files.read_feed(spark, f"{tmp_path}/feed.xml").collect()) == [("t", "l"), ("u", None)]


def test_page_detail(spark):
    page = "<title>T</title><h1> A  B </h1><a href='/x'>go <b>on</b></a><a>no</a><img src=i.png><p>unclosed"
    d = one(spark, d=html.page_detail(F.lit(page)))["d"]
    assert (d["title"], d["heading"], [tuple(x) for x in d["links"]], d["images"]) == ("T", "A B", [("/x", "go on")], ["i.png"])


@pytest.mark.parametrize("text,start,end,kind", [
    ("접수 2026.02.10 ~ 2026.02.20", "2026-02-10", "2026-02-20", "fixed"), ("~ 3.15까지", None, "2026-03-15", "fixed"), ("12.20 ~ 1.5", "2025-12-20", "2026-01-05", "fixed"), ("상시 모집", None, None, "ongoing"),
    ("2026.3.1 ~ 예산 소진 시", "2026-03-01", None, "until_exhausted"), ("추후 공지", None, None, None), ("2026.02.30", None, None, None), (None, None, None, None),
])
def test_period(spark, text, start, end, kind):
    posted = "2025-12-10" if text and text.startswith("12.") else "2026-01-10"
    p = one(spark, p=notices.period(F.lit(text).cast("string"), F.lit(posted).cast("date")))["p"]
    got = (None, None, None) if p is None else (p["start"] and str(p["start"]), p["end"] and str(p["end"]), p["kind"])
    assert got == (start, end, kind)


def test_lines_and_bytes(spark):
    r = one(spark, a=notices.clean_lines(F.lit("목록\n Hello  there \nhello there\nRSS\nend")), b=notices.decoded(F.lit("가나".encode("euc-kr")), F.lit("text/html; charset=EUC-KR")), c=notices.decoded(F.lit(b"<meta charset='nonsense'>\xea\xb0\x80"), F.lit(None).cast("string")))
    assert (r["a"], r["b"], r["c"]) == ("Hello there\nend", "가나", "<meta charset='nonsense'>가")


@pytest.mark.parametrize("value,key,want", [
    ("5년 이상 강남구 거주 주민 ● 모집인원 : 12개 부문", "target", "5년 이상 강남구 거주 주민"), ("~2026", "period", None), ("2026. 8. 4.(", "period", None), ("온라인 신청 https://forms", "application", None),
    ("2026.7.1~2026.8.21", "period", "2026.7.1~2026.8.21"), ("마포구청 ✔️ 정원: 20명", "location", "마포구청"), ("02-1234-5678 #서울 찾아가기 서울", "contact", "02-1234-5678"),
    ("서울 청년 2) 진행일정 1회기 상담", "target", "서울 청년"), ("여성 누구나 3. 신청기간: 2026.7.1~2026.8.21", "target", "여성 누구나"), ("담당 010-1234-5678 https://www.a.kr/?idx=1", "contact", "담당 010-1234-5678"),
    ("https://pf.a.com/_b", "contact", "https://pf.a.com/_b"), ("", "target", None), (None, "target", None), ("해당 없음", "target", None), ("온라인 및", "application", None),
])
def test_usable_facts(spark, value, key, want):
    from noticeloom.functions.facts import usable_fact

    assert spark.createDataFrame([(value,)], "v string").select(usable_fact(F.col("v"), key)).first()[0] == want


def test_image_sizes_from_heads():
    from noticeloom.functions.images import image_size

    heads = {
        ("png", 640, 480): b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4) + (480).to_bytes(4), ("gif", 3, 7): b"GIF89a\x03\0\x07\0",
        ("webp", 300, 200): b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"), ("webp", 5, 9): b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + (4 | 8 << 14).to_bytes(4, "little"),
        ("jpeg", 33, 44): b"\xff\xd8\xff\xe0\0\x04ab\xff\xc4\0\x03x\xff\xc2\0\x0b\x08" + (44).to_bytes(2) + (33).to_bytes(2) + b"\1\1\x11\0",
    }
    assert {image_size(data): size for size, data in heads.items()} == {size: size for size in heads}
    for data in (None, b"", b"%PDF", b"\xff\xd8\xff", b"GIF89a", b"RIFF\0\0\0\0WEBPVP8 ", b"\xff\xd8\xff\xe0\0\1"):
        assert image_size(data) == (None, None, None)


def test_text_of_attachments():
    import io
    import zipfile

    from noticeloom.functions.attachments import read_text

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", "<w:t>모집</w:t> <w:t>공고 &amp; 안내</w:t>")
        z.writestr("docProps/app.xml", "<x>no</x>")
    assert read_text("docx", made.getvalue()) == ("extracted", "", "모집 공고 & 안내")
    assert read_text("html", b"<script>x()</script><p>a</p>b")[2] == "a b" and read_text("txt", "\ufeffab".encode())[2] == "ab"
    assert [read_text(k, d)[0] for k, d in (("pdf", b"x"), ("zip", b"x"), ("txt", b" "), ("hwp", None))] == ["unsupported", "failed", "failed", "unsupported"]


def test_list_rows_by_the_first_selector_that_yields(spark):
    from noticeloom.sources.html import list_rows

    page = '<ul class="nav x"><li><a href="/a">A <b>b</b></a></li><li><a href="/c">C</a></li></ul><table class="board"><tr><td><a href="/1">one</a></td></tr></table>'
    pages = spark.createDataFrame([(page,), ("<a href='/z'>z</a>",), (None,)], "html string")
    got = [(r["selector"], [(x["url"], x["label"]) for x in r["rows"]]) for r in pages.select(list_rows(F.col("html"), ("table.other tr", "table.board tr", "ul li", "a")).alias("r")).select("r.*").collect()]
    assert got == [("table.board tr", [("/1", "one")]), ("a", [("/z", "z")]), (None, [])]


def test_ranks_by_bins(spark):
    from noticeloom.operators.ranks import nearest_ranks, numbered

    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(100)] + [("b", 1.0), ("b", None), ("c", None)], "k string, v double")
    got = {r["k"]: (r["low"], r["mid"], r["top"]) for r in nearest_ranks(rows, ["k"], "v", {"low": 0.0, "mid": 0.5, "top": 1.0}, bins=4).collect()}
    values = sorted(float(i % 7) for i in range(100))
    assert got == {"a": (values[0], values[49], values[-1]), "b": (1.0, 1.0, 1.0)}
    assert nearest_ranks(rows.limit(0), [], "v", {"mid": 0.5}).first()["mid"] is None
    assert [r["number"] for r in numbered(spark.range(50).select((F.lit(99) - F.col("id")).alias("id")), "id", bins=5).orderBy("id").collect()] == list(range(1, 51))


def test_suppression_of_a_hot_key(spark):
    from datetime import datetime, timedelta

    times = [datetime(2024, 1, 1) + timedelta(minutes=7 * i) for i in range(3000)]
    rows = spark.createDataFrame([("x", t) for t in times] + [("y", times[0]), ("y", None)], "k string, ts timestamp")
    want, last = [], None
    for t in times:
        if last is None or t - last >= timedelta(minutes=60):
            want.append(t)
            last = t
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = suppression.let_through(rows, ["k"], 60).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["ts"] for r in got if r["key"] == "x") == want and [r["ts"] for r in got if r["key"] == "y"] == times[:1]


def test_exclusions_and_their_exceptions(spark):
    from noticeloom.operators.exclusions import exclusion

    rows = spark.createDataFrame([("휴관 안내", "", ""), ("휴관 안내 교육생 모집", "", ""), (None, None, None), ("", " ", None)], "t string, x string, s string")
    assert [r[0] for r in rows.select(exclusion(F.col("t"), F.col("x"), F.col("s"), F.lit(2026))).collect()] == ["closure-or-operation-notice", None, None, None]


def test_sections_begin_on_lines_of_their_own(spark):
    from noticeloom.functions.facts import section_breaks

    text = "2. 신청대상: 여성 3. 신청기간: 2026.7.1~2026.8.21 - 장소: 시청●문의처: x\n\n\n\n끝"
    got = spark.createDataFrame([(text,)], "v string").select(section_breaks(F.col("v"))).first()[0]
    assert got == "2. 신청대상: 여성\n3. 신청기간: 2026.7.1~2026.8.21\n- 장소: 시청\n● 문의처: x\n\n끝"


def test_anchors_are_in_every_match(spark):
    from noticeloom.functions import patterns
    from noticeloom.operators import quality_gate as Q

    assert patterns.anchors(r"(?:ab|cd)\s*e?fg") == ("fg",) and patterns.anchors("a?b*") is None and patterns.anchors("[xy]z*") == ("x", "y")
    assert patterns.anchors("(?:abc|ab)d?") == ("ab",) and patterns.anchors(r"(?<!\w)Ab(?:c|[0-9])") == ("ab",)
    texts = ["3월 볼링 시간표", "웹 접근성 WA 마크", "공공근로 참여자 모집", "APPLY now", "수영장 운영 안내", "시스템  오류", "plain text", "", "Google Forms를 통해", "ir IR", "동아일보"]
    rules = [r[4] for r in Q.TEXT_RULES] + [Q.RECRUITING, Q.NEWS, Q.JOBS, Q.COURSES, Q.FORM_NOISE, Q.CENTRAL_SIGN, Q.PUBLIC_JOB_SIGN, Q.SAFETY]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("l", F.lower("t"))
    got = rows.select(*[patterns.found(F.col("t"), F.col("l"), p).alias(f"a{k}") for k, p in enumerate(rules)], *[F.col("t").rlike("(?i)" + p).alias(f"b{k}") for k, p in enumerate(rules)]).collect()
    assert all(r[f"a{k}"] == r[f"b{k}"] for r in got for k in range(len(rules))) and sum(r[f"a{k}"] for r in got for k in range(len(rules))) > 8


def test_titles_meet_at_equal_parts(spark):
    """Titles that are made of few character pairs have most of the frequent ones in common; hardly any two of them are compared
    for it, and no pair that is alike is lost. A large group of near copies is met about once for each pair."""
    r = random.Random(11)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ly", "ing", "tion"]
    titles = [" ".join("".join(r.choices(parts, k=r.randint(1, 6))) for _ in range(r.randint(3, 60))) for _ in range(300)]
    swap = lambda t, n: "".join(r.choice("xyz ") if k in at else c for at in [set(r.sample(range(len(t)), min(n, len(t))))] for k, c in enumerate(t)).strip()
    titles += [swap(t, r.randint(1, 4)) for t in titles[:60]] + [swap(titles[0] * 2, 2) for _ in range(40)] + ["a", "ab", "ab c", "청년"]
    titles = sorted({" ".join(t.split()) for t in titles})
    keys = spark.createDataFrame([("b" if k % 5 else "c", k, t) for k, t in enumerate(titles)], "block string, name long, key string")
    shares = duplicates._shares(titles, titles)(slice(None))
    for least in (0.95, 0.9):
        want = {(i, j): shares[i, j] for i in range(len(titles)) for j in range(i + 1, len(titles)) if (i % 5 == 0) == (j % 5 == 0) and shares[i, j] >= least}
        assert {(x["x"], x["y"]): x["share"] for x in duplicates.alike(keys, least).collect()} == want and len(want) > 300
    marked = keys.select("name", duplicates._marks(F.col("key"), 0.95).alias("s")).select("name", "s.*")
    met = marked.alias("l").join(marked.alias("r"), F.col("l.name") < F.col("r.name")).where(F.arrays_overlap("l.marks", "r.marks") & duplicates._near_enough(0.95))
    assert met.count() < 2 * (np.triu(shares, 1) >= 0.95).sum()


def test_pairs_are_judged_where_they_meet(spark, monkeypatch):
    """Each pair comes once, with the score that its whole rows give it, whatever the ways that find it."""
    for name, size in (("BLOCK", 4), ("TILE", 20)):
        monkeypatch.setattr(duplicates, name, size)
    r = random.Random(9)
    titles = ["seoul art camp for youth", "seoul art camp for youths", "garden walk", "garden walks 2026", "", "청년 예술 캠프 2026"]
    hashes = [f"{0x00ff00ff00ff00ff ^ m:016x}" for m in (0, 1, 3, 0xfff, 0xffff, 1 << 63)]
    some = lambda kinds, most: " ".join(r.choices(kinds, k=r.randint(0, most)))
    p = _prints(spark, *[(r.choice(titles), r.choice(["mapo district office", "mapo district offices", "src1", ""]), some([f"u{k}" for k in range(60)], 2), some([f"i{k}" for k in range(40)], 2), some(hashes, 2),
                          r.choice(["d", "e", ""]), some([f"a{k}" for k in range(60)], 1), some(["f1", "https://forms.gle/x", "f2"], 2)) for _ in range(120)]).cache()
    every = p.alias("x").join(p.alias("y"), F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    rows = lambda d: sorted(tuple(x) for x in d.where(F.col("score") >= duplicates.FLOOR).collect())
    alone = p.select("id", F.col("id").alias("rep"))
    assert rows(duplicates.scored_classes(p, alone)) == rows(duplicates.score_pairs(every, p))


def test_pairs_of_sources_and_sites_come_once_without_a_shuffle(spark, monkeypatch):
    """Repeated slugs, sites, names and places give each pair once; what is made of pairs isn't exchanged."""
    from noticeloom.operators import intake

    monkeypatch.setattr(intake, "BLOCK", 3)
    r = random.Random(4)
    urls = [None, "", "x", "https://a.example", "https://a.example/", "https://a.example/en/x?y", "https://a.example/en", "HTTPS://A.example/en/", "https://b.example/en/x/z", "https://b.example/e"]
    sources = [(r.choice(["s1", "s2", "s3", "t1", None]), r.choice([None, ["t1"], ["t2", "t2", "s1"]]), r.choice([None, "", "n1", "n2"]), r.choice(urls), r.choice(urls)) for _ in range(30)]
    sites = [(r.choice(["s1", "s2", "t1", "t2", "t3", "t4"]), r.choice([None, "", "n1", "n2", "n3"]), r.choice(urls)) for _ in range(30)]

    def place(url):
        found = re.match(r"(?i)https?://([^/?#]+)([^?#]*)", url or "")
        return found and (found[1].lower(), found[2].rstrip("/") + "/")

    def together(source, site):
        ps, q = [place(u) for u in source[3:] if place(u)], place(site[2])
        near = q and any(p[0] == q[0] and (p[1].startswith(q[1]) or q[1].startswith(p[1])) for p in ps)
        return source[0] == site[0] or site[0] in (source[1] or []) or bool(source[2]) and source[2] == site[1] or near

    found = intake.source_sites(spark.createDataFrame(sources, "slug string, sites array<string>, name string, list_url string, homepage_url string"), spark.createDataFrame(sites, "site string, name string, url string"))
    want = {(a[0], b[0]) for a in sources for b in sites if together(a, b)}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and len(want) > 15
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith(("Aggregate", "Deduplicate"))
