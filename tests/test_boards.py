"""Trees, selectors, rules of boards and detail pages on small pages."""

import pytest
from pyspark.sql import functions as F

from noticeloom.sources import boards, dom

PAGE = """<body><ul id=top><li class="a b">one<li>two <b>bold</b></ul><table><tr><td>1<td>2<tr><td>3</table>
<div class=x><p>p1<p>p2<div class=y><a href="/d?x=1" title=t>L</a></div></div></p></section><br>end"""


def test_trees_of_broken_markup():
    tree = dom.parse(PAGE)
    tags = lambda s: [dom.text(e).strip() for e in dom.select(tree, s)]
    assert tags("li") == ["one", "two bold"] and tags("#top > li.b") == ["one"] and tags("tr td:nth-child(2)") == ["2"] and tags("td:last-child") == ["2", "3"]
    assert tags("div.x a[href*='x=']") == ["L"] and tags("div > a[href^='/e'], b") == ["bold"] and tags("tr") == ["12", "3"] and tags("ul li b, [title=t]") == ["bold", "L"]
    assert tags(".x > a") == [] and tags("p") == ["p1", "p2L"]
    assert dom.select(dom.parse(None), "p") == [] and dom.text(dom.parse("<a><b></i>x")) == "x"
    with pytest.raises(ValueError):
        dom.select(tree, "a:hover")


def test_readable_text():
    tree = dom.parse("<div>a  b<br>c<p>d</p><nav>menu</nav><p>e&nbsp;f</p>\n\n\n\n<ul><li>g<li>h</ul></div>")
    assert dom.readable(tree, "nav") == "a b\ncd\ne f\n\ng\nh"
    assert dom.readable(dom.parse("<p>" * 2000 + "deep")) == "deep" and dom.readable(dom.parse("<div>" * 5000 + "deep")) == "deep"


def test_posts_keep_the_first_or_last_of_an_address(spark):
    row = lambda i, t: f"<tr><td>1<td>2<td><a href='selectSIIA200Detail.do?id={i}'>{t}</a><td>2026.1.2 ~ 2026.2.3<td>4<td>5<td>2026-01-01</tr>"
    plain = lambda i, t: f"<li><a href='/v/{i}'>{t}</a><span class=date>2026.03.0{i}</span></li>"
    rows = [("bizinfo", 1, f"<table><tbody>{row(1, 'old')}{row(2, 'b')}</tbody></table>"), ("bizinfo", 2, f"<table><tbody>{row(1, 'new')}<tr><td>no link</table>"), ("bizinfo", 3, None),
            ("unknown", 1, f"<ul class=board-list>{plain(1, 'first')}<li><a href='javascript:x'>js</a></ul>"), ("unknown", 2, f"<ul class=board-list>{plain(1, 'second')}</ul>")]
    pages = spark.createDataFrame(rows, "adapter string, page long, html string").withColumn("url", F.lit("https://h.example/l/list.do"))
    got = sorted(tuple(r) for r in boards.board_posts(pages).collect())
    assert got == [("bizinfo", "https://h.example/l/selectSIIA200Detail.do?id=1", "new", "2026-01-01", "2026-02-03"), ("bizinfo", "https://h.example/l/selectSIIA200Detail.do?id=2", "b", "2026-01-01", "2026-02-03"),
                   ("unknown", "https://h.example/v/1", "first", "2026-03-01", "")]
    assert boards.board_posts(pages.limit(0)).count() == 0


def test_detail_without_text(spark):
    rows = spark.createDataFrame([(None,), ("",), ("<div class=content><img src=x.jpg></div><p>around</p>",), ("<div class=content> </div><p>around</p>",)], "html string")
    got = [r[0] for r in rows.select(boards.detail(F.col("html"), F.lit("https://h.example/"), F.lit("h"))).collect()]
    assert [(d["title"], d["content"], d["date"], d["images"]) for d in got] == [("", "", "", []), ("", "", "", []), ("", "", "", ["https://h.example/x.jpg"]), ("", "around", "", [])]


def test_rule_classifier(spark):
    from noticeloom.operators import classifier

    kind = "id long, title string, category string, summary string, content string, site string, board string, url string"
    rows = [
        (1, "교육 강좌", "", "", "", "", "", ""), (2, "문화 교육", "", "", "", "", "", ""), (3, "문화 교육", "문화", "", "", "", "", ""), (4, None, None, None, None, None, None, None),
        (5, "청년몽땅정보통", "", "", "종로구 중구 용산구", "", "", ""), (6, "IR day", "", "", "x" * 100_000 + " 복지 전국", "", "", ""),
    ]
    got = {r["id"]: r for r in classifier.classify_notices(spark.createDataFrame(rows, kind)).collect()}
    codes = lambda i, what="categories": [(c["code"], c["confidence"]) for c in got[i][what]]
    assert codes(1) == [("CAT_EDUCATION", 0.95)] and got[1]["issues"] == ["missing-region"] and got[1]["confidence"] == 0.0
    assert codes(2) == [("CAT_EDUCATION", 0.58), ("CAT_CULTURE", 0.59)] and got[2]["issues"] == ["ambiguous-category", "missing-region"]  # a tie goes to the earlier
    assert [c["score"] for c in got[3]["categories"]] == [20] and codes(3) == [("CAT_CULTURE", 0.95)]  # 5 + 6 + 9
    assert codes(4) == [("CAT_OTHER", 0.35)] and got[4]["regions"] == [] and got[4]["audiences"] == []
    assert codes(5, "regions") == [("REG_SEOUL_JONGNO", 0.72), ("REG_SEOUL_JUNG", 0.72)] and "ambiguous-region" in got[5]["issues"] and got[5]["audiences"] == []
    assert codes(6) == [("CAT_BUSINESS", 0.77)] and codes(6, "regions") == [("REG_NATION", 0.72)]
    assert classifier.counts_of_words((("ab", "b", "bc"), ("abc",), ()), "xabcab") == [3, 1, 0]


def test_pages_are_read_in_slices_and_their_trees_freed(spark):
    import gc

    import pyarrow as pa

    from noticeloom.sources import work

    sizes, values = [], [None if k % 5 == 0 else "x" * (k % 300) for k in range(30_000)]
    out = work.sliced(lambda a, b: sizes.append(sum(len(v or "") for v in a)) or [[v or "", w] for v, w in zip(a, b)], pa.list_(pa.string()), pa.array(values), pa.array(["y"] * len(values)))
    assert out.to_pylist() == [[v or "", "y"] for v in values] and len(sizes) > 3 and max(sizes) < 2 * work.SLICE_BYTES
    assert work.sliced(lambda a: a, pa.string(), pa.array([], pa.string())).to_pylist() == []
    gc.collect()
    gc.disable()
    alive = lambda: sum(isinstance(x, dom.Element) for x in gc.get_objects())
    try:
        before = alive()
        dom.forget(dom.parse(PAGE))
        assert alive() == before
    finally:
        gc.enable()
    pages = spark.createDataFrame([(k, "other", f"<table><tbody><tr><td><a href='/v/{k}'>{'t' * 900}{k}</a></table>" if k % 3 else None) for k in range(3000)], "page long, adapter string, html string").coalesce(1).withColumn("url", F.lit("https://h.example/l"))
    got = {r["url"]: r["title"] for r in boards.board_posts(pages).collect()}
    assert got == {f"https://h.example/v/{k}": "t" * 900 + str(k) for k in range(3000) if k % 3}
