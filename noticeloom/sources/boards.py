"""Boards: list pages by declared rules, one for each kind of site, and detail pages in full.

A rule says where a row is, which link it has, how its address is made, and where title and dates stand. The rules are data;
one interpreter reads them over the pages' trees, where the pages lie. What a row's address is kept for is decided in
Spark, over all pages of a board.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from noticeloom.functions import structured as S

from . import dom
from .work import ship, sliced


@dataclass(frozen=True)
class Rule:
    """rows: selectors, of which the first with any rows counts. link: the row's link, or '' for the row itself. address: '' for
    the link's own, or a form with {id}, which the pattern `id` finds in the attribute `id_in`. title: selectors within the
    row, or none for the link's text; without: what titles leave out. date, deadline: ('cell', n) for the n-th cell, ('select', selector),
    ('label', word) for what begins with a word, ('row', '') for the row's text; a deadline is the last date there. keep: which
    row of an address stays."""

    rows: tuple[str, ...]
    link: str = "a[href]"
    id_in: str = "href"
    id: str = ""
    address: str = ""
    title: tuple[str, ...] = ()
    without: str = ""
    date: tuple = ()
    deadline: tuple = ()
    keep: str = "last"
    exclude: tuple[str, ...] = field(default=())


# The boards' markup and addresses.
RULES = {
    "bizinfo": Rule(("table tbody tr",), link="a[href*='selectSIIA200Detail.do']", date=("cell", 6), deadline=("cell", 3)),
    "job-alio": Rule(("tr",), link="a[href*='recruitview.do?idx=']", date=("cell", 6), deadline=("cell", 7)),
    "k-startup": Rule(("#bizPbancList li",), link="a[href*='go_view']", id=r"(?i)go_view\s*\(\s*['\"]?(\d+)", address="https://www.k-startup.go.kr/web/contents/bizpbanc-ongoing.do?schM=view&pbancSn={id}",
                      title=(".middle .tit",), without=".new", date=("label", "등록일자"), deadline=("label", "마감일자")),
    "kesco": Rule(("table.board_list tbody tr, .board_list tbody tr",), link="a[onclick*='fnDetail']", id_in="onclick", id=r"fnDetail\(\s*['\"]?(\d+)", address="?mode=view&bbsSeq={id}", date=("cell", 3)),
    "youth-seoul": Rule((".item",), link="[onclick*='goView']", id_in="onclick", id=r"goView\('([^']+)'\)", address="https://youth.seoul.go.kr/infoData/sprtInfo/view.do?key=2309130006&sprtInfoId={id}", title=(".tit",)),
    "generic-board": Rule(("table tbody tr", ".board-list li", ".bbs-list li", ".notice-list li", ".list_item", ".list-item", "article"), date=("select", ".td_date, .date, .bo_date, .write-date, .reg-date, .created-at, td:last-child"), keep="first",
                          exclude=(r"(?i)^#|^javascript:|^mailto:|^tel:|/login|/member",)),
}
OTHERWISE = "generic-board"
# Where detail pages have their parts, what isn't text, and words of addresses that are no content images.
TITLES = "#bo_v_title, .bo_v_tit, .view_title, .board_view_title, .subject, .view-subject, .detail-title, .board-detail-tbl thead th, h1, h2, h3.title"
CONTENTS = "#bo_v_con, .bo_v_con, .view_content, .board_view_content, .detail-content, .view-cont, .view-contents, .view_area, .viewArea, .board-view, .boardView, .bbs-view, .bbs_view, #contents, .contents, .sub_content, .board-view, .content, article"
DATES = "#bo_v_info .date, .bo_v_info, .view_info, .board_view_info, .board-detail-tbl thead th, .date, .reg-date"
IMAGES = "#bo_v_con img, .bo_v_con img, .view_content img, .board_view_content img, .detail-content img, .view-cont img, article img"
ATTACHMENTS = ".bo_v_file a, .view_file a, .file_list a, .board_view_file a, a[href*='download'], a[href*='file']"
REMOVED = "script, style, noscript, iframe, nav, header, footer, aside, .sns, .share, .btn, .buttons, .pagination, .gnb, .lnb, .snb, .menu, .nav, .header, .footer, .breadcrumb, .location, .search"
SHARED_IMAGES = "meta[property='og:image'], meta[name='twitter:image'], link[rel='image_src']"
NO_IMAGES = ("icon", "logo", "btn", "banner", "bul_", "bg_", "addfile", "attach", "attached", "file.gif", "file_icon", "icon_file", "ico_file", "clip", "skin001", "anyboard/skin", "sns", "facebook", "twitter", "accessibility",
             "web_access", "webaccess", "wa_mark", "wamark", "wa-logo", "cert")
DAY = r"(20[0-9]{2})[-./년\s]+([0-9]{1,2})[-./월\s]+([0-9]{1,2})"

_ROWS = "array<struct<title:string,url:string,date:string,deadline:string>>"
_DETAIL = "struct<titles:array<string>,content:string,dated:string,images:array<string>,attachments:array<struct<name:string,url:string>>>"


def _squeezed(value: str) -> str:
    return " ".join(value.split())


def _days(value: str) -> list[str]:
    return [f"{y}-{int(m):02d}-{int(d):02d}" for y, m, d in re.findall(DAY, value)]


def _resolved(base: str, value: str) -> str:
    try:
        return urljoin(base, value)
    except ValueError:
        return value


def _place(row: dom.Element, where: tuple) -> str:
    """The text that a rule's date or deadline is in."""
    if not where:
        return ""
    how, what = where
    if how == "cell":
        cells = dom.select(row, "td")
        return dom.text(cells[what]) if what < len(cells) else ""
    if how == "select":
        return next((t for e in dom.select(row, what) if (t := _squeezed(dom.text(e)))), "")
    texts = [_squeezed(dom.text(e)) for e in row.walk()]
    return next((t for t in texts if t.startswith(what)), "") if how == "label" else _squeezed(dom.text(row))


def _row(row: dom.Element, rule: Rule, page: str) -> dict | None:
    link = next(iter(dom.select(row, rule.link)), None) if rule.link else row
    if link is None:
        return None
    value = link.attrs.get(rule.id_in) or (row.attrs.get(rule.id_in) if rule.id else "") or ""
    if rule.id:
        found = re.search(rule.id, value)
        value = rule.address.replace("{id}", found[1]) if found else ""
    title = next((t for s in rule.title for e in dom.select(row, s)[:1] if (t := _squeezed(dom.text(e, rule.without)))), "") or _squeezed(dom.text(link))
    if not value or not title or any(re.search(p, value) for p in rule.exclude):
        return None
    day = _days(_place(row, rule.date)) or (_days(dom.text(row)) if rule.date and rule.date[0] == "select" else [])
    return {"title": title, "url": _resolved(page, value), "date": (day or [""])[0], "deadline": (_days(_place(row, rule.deadline)) or [""])[-1]}


def list_rows(html: Column, url: Column, adapter: Column, rules: dict[str, Rule] = RULES) -> Column:
    """array<struct<title, url, date, deadline>>: the rows of a list page, by its adapter's rule; unknown adapters are read
    as OTHERWISE. Days are yyyy-mm-dd, '' where there is none; no rows for null and broken pages."""
    ship()
    kind = to_arrow_type(T._parse_datatype_string(_ROWS))

    @F.arrow_udf(_ROWS)
    def read(pages: pa.Array, urls: pa.Array, names: pa.Array) -> pa.Array:
        def one(page, url, name):
            rule, tree = rules.get(name) or rules[OTHERWISE], dom.parse(page)
            rows = next((found for s in rule.rows if (found := [r for e in dom.select(tree, s) if (r := _row(e, rule, url or ""))])), [])
            dom.forget(tree)
            return rows

        return sliced(lambda *lists: [one(*x) for x in zip(*lists)], kind, pages, urls, names)

    return read(html, url, adapter)


def board_posts(pages: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """(adapter, url, title, date, deadline): one row for each address that the pages (adapter, page, url, html) of an adapter list;
    of several the first or the last by page and place, as its rule says."""
    rows = pages.select("adapter", "page", F.posexplode(list_rows(F.col("html"), F.col("url"), F.col("adapter"), rules)).alias("place", "r"))
    first = F.col("adapter").isin(*[n for n, r in rules.items() if r.keep == "first"]) | ~F.col("adapter").isin(*rules)
    sign = F.when(first, -1).otherwise(1)
    order = F.struct(sign * F.col("page"), sign * F.col("place"))
    kept = rows.groupBy("adapter", F.col("r.url").alias("url")).agg(F.max_by("r", order).alias("r"))
    return kept.select("adapter", "url", "r.title", "r.date", "r.deadline")


def detail(html: Column, url: Column, site: Column, kept: str = "") -> Column:
    """struct(title, content, date, deadline, images, attachments) of a notice's page.

    Content is the first of CONTENTS with text, without REMOVED; if none of them has text, nor pictures or links, it is the
    page's. The title is the first of TITLES that can be one, else the page's; the date that of DATES, else the content's.
    Images are those that the page names for sharing, then those of the first of IMAGES that has any, else of the page; in
    order, each once, without NO_IMAGES. Attachments are the links of the first of ATTACHMENTS that has any. Strings are ''
    where there is nothing; a null page has empty parts. In the content, blanks are squeezed, but for those of elements that match `kept`."""
    def each(selectors):
        return [s.strip() for s in selectors.split(",")]

    ship()
    kind = to_arrow_type(T._parse_datatype_string(_DETAIL))

    @F.arrow_udf(_DETAIL)
    def read(pages: pa.Array, urls: pa.Array) -> pa.Array:
        def one(page, url):
            tree = dom.parse(page)
            base = next(iter(dom.select(tree, "body")), tree)
            first = lambda s: next(iter(dom.select(tree, s)), None)
            said = lambda e: _squeezed(dom.readable(e, REMOVED)) if e is not None else ""
            content, scoped = "", False
            for element in filter(None, map(first, each(CONTENTS))):
                scoped = scoped or bool(dom.select(element, "img, picture, video, iframe, a[href]"))
                content = dom.readable(element, REMOVED, kept)
                if content:
                    break
            if not content and not scoped:
                content = dom.readable(base, REMOVED, kept)
            images: list[str] = []

            def add(elements, *names):
                for e in elements:
                    value = next((e.attrs[n] for n in names if e.attrs.get(n)), "")
                    if value and not any(w in value.lower() for w in NO_IMAGES) and (value := _resolved(url or "", value)) not in images:
                        images.append(value)

            add(dom.select(tree, SHARED_IMAGES), "content", "href")
            for s in each(IMAGES):
                add(dom.select(tree, s), "src", "data-src", "data-original")
                if images:
                    break
            if not images:
                add(dom.select(tree, "img"), "src", "data-src", "data-original")
            links = next((found for s in each(ATTACHMENTS) if (found := [
                {"name": dom.text(e).strip() or e.attrs.get("title") or e.attrs["href"], "url": _resolved(url or "", e.attrs["href"])} for e in dom.select(tree, s) if e.attrs.get("href")])), [])
            titles = [next((t for s in each(TITLES) if (t := said(first(s)))), ""), _squeezed(dom.text(e)) if (e := first("title")) is not None else ""]
            dated = next((t for s in each(DATES) if (t := said(first(s)))), "")
            dom.forget(tree)
            return {"titles": titles, "content": content, "dated": dated, "images": images, "attachments": links}

        return sliced(lambda *lists: [one(*x) for x in zip(*lists)], kind, pages, urls)

    d = read(html, url)
    clean = lambda i: S.clean_title(d["titles"][i], site)
    found = F.when(d["dated"] != "", d["dated"]).otherwise(d["content"])
    part = lambda i: F.lpad(F.regexp_extract(found, DAY, i), 2, "0")
    day = F.when(found.rlike(DAY), F.concat_ws("-", F.regexp_extract(found, DAY, 1), part(2), part(3))).otherwise("")
    return F.struct(
        F.when(clean(0) != "", clean(0)).otherwise(clean(1)).alias("title"), d["content"].alias("content"), day.alias("date"),
        F.coalesce(S.deadline(d["content"]).cast("string"), F.lit("")).alias("deadline"), d["images"].alias("images"), d["attachments"].alias("attachments"),
    )
