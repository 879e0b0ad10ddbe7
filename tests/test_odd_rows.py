"""Rows on which a query once differed from its SQL, or which once met in one task."""

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeloom.plans import registry
from test_oracle import _plain

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def _same(spark, name, folder, **tables):
    """The query and its SQL give the same rows over these tables."""
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = c.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    found = registry.QUERIES[name](spark, str(folder)).select(*names).collect()
    assert sorted([_plain(v) for v in r] for r in found) == sorted([_plain(v) for v in r] for r in want.fetchall())
    return found


def test_text_notices_are_measured_without_the_planted_sign(spark, tmp_path):
    rows = [(4 * n, "x" * n, "en", "s", n) for n in (0, 3, 5, 73, 74, 79, 80, 81)] + [(400, None, "en", "s", 0), (404, " " * 3 + "x" * 75 + "  ", "en", "s", 80)]
    assert len(_same(spark, "f22_text_notices", tmp_path, documents=spark.createDataFrame(rows, DOCUMENTS))) == 3


def test_title_that_is_only_a_date_is_none(spark, tmp_path):
    rows = [(k, text, "en", "s", 0) for k, text in enumerate(["", "12 34", "é!", "", "", "", "Home", "a title"])]
    found = _same(spark, "x16_clean_title", tmp_path, documents=spark.createDataFrame(rows, DOCUMENTS))
    assert {r["doc_id"]: r["title"] for r in found}[1] == ""


def test_references_are_decoded_as_the_sql_says(spark, tmp_path):
    html = '<title>a &amp;&lt; b&quot;&amp</title><h1>c &l &amp</h1><a href="/x?a=1&lt=2">d</a><img src="e.png">'
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert _same(spark, "s06_page_detail", tmp_path, pages=pages)[0]["title"] == "a &< b&quot;&amp"


def test_nearest_with_ties_copies_gaps_and_nulls(spark, tmp_path):
    money = [-999.99, 0.0, 0.01, 0.02, 5.5, 5.5, 100.25, 9999.99, None]
    customers = [(k + 10 * n, f"c{k}", n, "x", v) for n in (1, 2) for k, v in enumerate(money)] + [(91, "c", 3, "x", None), (90, "c", 3, "x", None), (95, "c", 4, "x", 7.0)]
    suppliers = [(100 * n + k, f"s{k}", n, v) for n in (1, 2, 3, 4, 5) for k, v in enumerate([-5000.0, 0.015, 0.01, 2.76, 52.875, 7e5, None, 5.5])]
    found = _same(spark, "j12_best_match", tmp_path, customer=spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"),
                  supplier=spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"))
    assert len(found) == 32


def _largest(frame, kind):
    """The most rows that a plan's operators of a kind gave, with adaptive plans run to their end."""
    frame.collect()
    plan, out = frame._jdf.queryExecution().executedPlan(), [0]
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if kind in name:
            rows = node.metrics().get("numOutputRows")
            out.append(rows.get().value() if rows.isDefined() else 0)
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
    return max(out)


def test_sources_of_one_place_are_not_joined_with_all_its_posts(spark):
    from noticeloom.operators.institutions import best_source, resolve

    posts = spark.range(400).select("id", F.lit("None").alias("site"), F.lit("same").alias("site_name"), F.lit("same").alias("org"), F.lit("https://a.example/b/c/view").alias("url"))
    sources = spark.range(300).select(F.col("id").cast("int").alias("institution"), F.concat(F.lit("s"), "id").alias("slug"), F.lit("same").alias("name"), F.lit("https://a.example/b/c/list").alias("list_url"), F.lit("https://a.example/").alias("homepage_url"), F.lit("active").alias("status"))
    for found in (best_source(posts, sources), resolve(posts, sources)):
        assert _largest(found, "Join") <= 4 * 400
        assert {r[1] for r in found.collect()} == {"s0"} or {r[1] for r in found.collect()} == {0}


def _nodes(frame):
    """The operators of a frame's plan before it runs."""
    todo = [frame._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        yield node
        todo += [node.children().apply(i) for i in range(node.children().size())]


def test_the_gate_joins_no_texts(spark, data):
    from noticeloom.plans import gate

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = [n for n in _nodes(gate.a21_issue_counts(spark, data)) if "SortMergeJoin" in n.nodeName()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins
    for node in joins:
        assert not {"summary", "title", "_x", "_bl"} & {node.output().apply(i).name() for i in range(node.output().size())}


def test_rules_are_worked_out_once_and_behind_words(spark, data):
    from noticeloom.plans import exclude, gate

    assert "문화원장" not in gate.z19_upload(spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert exclude.f16_exclusion(spark, data)._jdf.queryExecution().optimizedPlan().toString().count("Contains(") > 30


def test_dice_of_long_texts_is_linear(spark):
    import time

    from noticeloom.functions import text as X

    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(60_000)), lambda k: (k % 9000).cast("string")).alias("a"), F.transform(F.sequence(F.lit(0), F.lit(50_000)), lambda k: (k % 8000).cast("string")).alias("b"))
    began = time.time()
    found = rows.select(X.dice(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert time.time() - began < 12
    count = lambda n, m, k: n // m + (k <= n % m)
    assert found == 2 * sum(min(count(60_000, 9000, k), count(50_000, 8000, k)) for k in range(8000)) / 110_002


def test_a_facts_first_line_is_that_of_its_first_section(spark):
    import random
    import time

    from noticeloom.functions import facts as N

    r = random.Random(5)
    bits = ["신청기간", "대상", ":", "：", "1.", " 2) ", " ", "\n", "\t", "\r\n", "●", "✅️", "📌", " - ", "abc", "Official Application", "첨부파일", " #x", "2026.3.1", "~", "상시 모집", "02-123-4567", " https://a.example/x", "미정", ","]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for i in range(4000)] + [(-1, None), (-2, "\n"), (-3, " \n●대상: x")]
    d = spark.createDataFrame(rows, "i long, t string")
    whole = F.split(F.coalesce(F.get(N.sections(F.col("t")), 0), F.lit("")), "\n")[0]
    fact = N.usable_fact(F.col("t"), "content")
    assert d.select(fact.alias("a"), N.usable_fact(whole, "content").alias("b")).where("NOT (a <=> b)").isEmpty()
    assert d.where(fact.isNotNull()).count() > 1000
    long = spark.range(2000).select(F.concat(F.lit("내용 word"), F.repeat(F.lit("\nsome words of a text"), 2000)).alias("t"))
    began = time.time()
    assert long.where(N.usable_fact(F.col("t"), "content") == "내용 word").count() == 2000
    assert time.time() - began < 15  # the lines after the first are not looked at


def test_link_repairs_join_once_and_work_addresses_out_once(spark, data):
    from noticeloom.operators.repairs import APPLY, NOTICE, link_repairs
    from noticeloom.plans import boards

    plan = boards.repair_links(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("regexp_extract(") < 60
    page = "https://youth.seoul.go.kr/infoData/sprtInfo/view.do?sprtInfoId="
    notices = spark.createDataFrame([(1, "https://forms.gle/a?b=1", page + "1"), (2, "https://forms.gle/c", page + "2"), (3, None, None)], "id long, source string, notice string")
    links = spark.createDataFrame([
        (1, 1, "HTTPS://forms.gle/a?page=2&b=1#x", "other", "t", False), (1, 2, page + "1", "official_notice", NOTICE, False), (1, 3, page + "9", "other", "t", False), (1, None, "https://a.example/x", None, None, True),
        (2, 4, None, "other", "t", False), (2, 5, "https://a.example/apply/", "other", None, False), (9, 6, "https://a.example/", "other", "t", True)], "id long, link long, url string, type string, title string, first boolean")
    found = sorted((tuple(r) for r in link_repairs(notices, links).collect()), key=str)
    form = lambda u: (u, "official_apply", APPLY, True)
    assert found == sorted([
        (1, 1, "update", *form("https://forms.gle/a")), (1, 3, "delete", page + "9", "other", "t", False), (1, None, "delete", "https://a.example/x", None, None, True), (1, None, "insert", "https://a.example/x", None, None, False),
        (2, None, "insert", *form("https://forms.gle/c")), (2, None, "insert", page + "2", "official_notice", NOTICE, False), (2, 4, "delete", None, "other", "t", False), (2, 5, "update", "https://a.example/apply/", "official_apply", None, False),
        (3, None, "insert", None, "official_apply", APPLY, True), (3, None, "insert", None, "official_notice", NOTICE, False)], key=str)


def test_blanks_of_a_heading_are_as_the_sql_has_them(spark, tmp_path):
    pages = spark.createDataFrame([(4 * k, "u", f"<title>{t}</title>") for k, t in enumerate(["- a  b", "1 x! y", " ", "x -", "\t q", ""])] + [(9, "u", "<title>- a  b</title>"), (2, "u", "<title>9 z</title>")], "page_id long, url string, html string")
    assert any("Notice  a b" in r["content"] for r in _same(spark, "s06_notice_detail", tmp_path, pages=pages))


def test_composition_of_many_slices_keeps_rows_and_nulls(spark):
    import unicodedata

    from noticeloom.functions import text as X

    rows = [(k, None if k % 7 == 0 else "" if k % 7 == 1 else "ﬁｘ㈜" * 900 * (k % 7)) for k in range(700)]
    d = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    assert {r["k"]: r["c"] for r in d.select("k", X.nfkc(F.col("t")).alias("c")).collect()} == {k: t and unicodedata.normalize("NFKC", t) for k, t in rows}
    assert d.where("k < 0").select(X.nfkc(F.col("t"))).collect() == []


def test_mean_vector_keeps_a_row_of_sums_for_a_block_of_dimensions(spark):
    from noticeloom.functions import vectors as V

    rows = [(1, 2.0, [1.0] * 70), (1, 1.0, [4.0] * 33), (1, 5.0, None), (1, 1.0, [None, 7.0]), (2, 1.0, []), (3, 1.0, [2.0]), (3, 3.0, [6.0])]
    d = spark.createDataFrame(rows, "k int, w double, v array<double>")
    mean = V.mean_vector(d, ["k"], "v", "w")
    got = {r["k"]: r["mean"] for r in mean.collect()}
    assert got.keys() == {1, 3} and got[3] == [5.0] and len(got[1]) == 70
    assert got[1][:2] == pytest.approx([6 / 4, 13 / 4]) and got[1][2:33] == [2.0] * 31 and got[1][33:] == [1.0] * 37  # a null entry weighs, a missing one doesn't
    assert V.mean_vector(d.where("k = 3"), [], "v").first()["mean"] == [4.0]
    assert "posexplode" not in mean._jdf.queryExecution().optimizedPlan().toString()  # no row for each dimension


def _long_documents(spark, folder):
    """Documents of 9,000 characters with a broken one at their end, written as a table."""
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("plain words "), 750), F.lit("�")).alias("text"))
    rows.write.parquet(f"{folder}/documents.parquet")
    return rows.withColumnRenamed("doc_id", "id")


def test_issues_at_the_end_of_long_texts_are_counted(spark, tmp_path):
    import duckdb

    from noticeloom.plans import gate

    _long_documents(spark, tmp_path)
    found = {r["code"]: r["n"] for r in gate.a21_issue_counts(spark, str(tmp_path)).collect()}
    assert found["mojibake"] == 52  # of two documents for each of 30 samples, but four samples without the text
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == dict(c.execute(gate.SQL["a21_issue_counts"]).fetchall())


def test_uploads_are_judged_by_whole_texts(spark, tmp_path):
    import duckdb

    from noticeloom.plans import gate

    _long_documents(spark, tmp_path)
    found = {r["id"]: (r["route"], r["reason"]) for r in gate.z19_upload(spark, str(tmp_path)).collect()}
    assert found[30] == found[60 - 6] == ("rejected", "mojibake")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == {i: (route, reason) for i, route, reason in c.execute(gate.SQL["z19_upload"]).fetchall()}


def test_best_matches_shuffle_no_pairs(spark, monkeypatch):
    """Pairs aren't shuffled to join copies: with few of them, nothing but the reduced rows is exchanged."""
    import random

    from noticeloom.operators import duplicates

    r = random.Random(2)
    rep = {i: i if i < 20 or r.random() < 0.5 else r.randrange(20) for i in range(60)}
    reps = [i for i in rep if rep[i] == i]
    scored = {tuple(sorted(r.sample(reps, 2))): r.choice([65, 70, 95]) for _ in range(150)} | {(rep[i], i): 100 for i in rep if rep[i] != i}
    pairs = spark.createDataFrame([(a, b, n, "merge") for (a, b), n in scored.items()], "a long, b long, score int, decision string")
    members = spark.createDataFrame(list(rep.items()), "id long, rep long")
    want = {}
    for (x, y), n in scored.items():
        for a, y in ((x, y), (y, x)):
            for b in {y, *(i for i in rep if rep[i] == y)}:
                if a < b:
                    want[b] = max(want.get(b, (0, 0)), (n, -a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = duplicates.best_match(pairs, members)
        assert not [n for n in _nodes(found) if "SortMergeJoin" in n.nodeName()]
        assert {x["b"]: (x["score"], -x["a"]) for x in found.collect()} == want
        monkeypatch.setattr(duplicates, "FEW", 0)
        many = duplicates.best_match(pairs, members)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, found.collect()))
