"""Pages to rows: links, images and metadata, parsed where the pages lie."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())])
DETAIL = T.StructType([T.StructField("title", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("links", T.ArrayType(_LINK)), T.StructField("images", T.ArrayType(T.StringType()))])


def page_detail(html: Column, references: tuple[str, ...] = ()) -> Column:
    """struct(title, heading, links, images) of a page; null for null, empty parts for broken markup. references: the names of
    those character references that are decoded, with their semicolon only; without any, all are, as browsers do."""
    bare = rf"&(?!(?:{'|'.join(references)});)" if references else None

    @F.pandas_udf(DETAIL)
    def parsed(pages: pd.Series) -> pd.DataFrame:
        import re
        from html.parser import HTMLParser

        class Page(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.text = {"title": [], "h1": []}
                self.links, self.images, self.open = [], [], []

            def handle_starttag(self, tag, attrs):
                found = dict(attrs)
                if tag == "a":
                    self.links.append([found.get("href") or "", ""])
                elif tag == "img" and found.get("src"):
                    self.images.append(found["src"])
                if tag in ("a", "title", "h1"):
                    self.open.append(tag)

            def handle_endtag(self, tag):
                if tag in self.open:
                    self.open.remove(tag)

            def handle_data(self, data):
                for tag in self.open:
                    if tag == "a":
                        self.links[-1][1] += data
                    else:
                        self.text[tag].append(data)

        rows = []
        for source in pages:
            page = Page()
            page.feed(re.sub(bare, "&amp;", source or "") if bare else source or "")
            squeeze = lambda parts: " ".join(" ".join(parts).split()) or None
            rows.append((squeeze(page.text["title"]), squeeze(page.text["h1"]), [{"url": u, "label": " ".join(x.split())} for u, x in page.links if u], page.images))
        return pd.DataFrame(rows, columns=["title", "heading", "links", "images"])

    return parsed(html)


ROW = T.StructType([T.StructField("selector", T.StringType()), T.StructField("rows", T.ArrayType(_LINK))])


def list_rows(html: Column, selectors: tuple[str, ...]) -> Column:
    """struct(selector, rows): the links of a list page by the first selector that yields any. A selector is a chain of
    tags, each with a class or none ('table.board tr'), of which the last holds one row's link."""
    @F.pandas_udf(ROW)
    def parsed(pages: pd.Series) -> pd.DataFrame:
        from html.parser import HTMLParser

        chains = [[tuple(step.split(".", 1)) + ((),) * (1 - step.count(".")) for step in s.split()] for s in selectors]
        single = frozenset("area base br col embed hr img input link meta source track wbr".split())

        def fits(open_tags: list, chain: list) -> bool:
            """Whether the innermost tags end a path that has the chain's steps in order."""
            place = len(chain) - 1
            for tag, classes in reversed(open_tags):
                name, wanted = chain[place]
                if tag == name and (not wanted or wanted in classes):
                    place -= 1
                    if place < 0:
                        return True
                elif place == len(chain) - 1:
                    continue
            return False

        class Page(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.open, self.found, self.into = [], [[] for _ in chains], []

            def handle_starttag(self, tag, attrs):
                known = dict(attrs)
                if tag not in single:
                    self.open.append((tag, (known.get("class") or "").split()))
                if tag == "a" and known.get("href"):
                    self.into = [rows for rows, chain in zip(self.found, chains) if fits(self.open, chain)]
                    for rows in self.into:
                        rows.append([known["href"], ""])

            def handle_endtag(self, tag):
                places = [i for i, (name, _) in enumerate(self.open) if name == tag]
                if places:
                    del self.open[places[-1]:]
                if tag == "a":
                    self.into = []

            def handle_data(self, data):
                for rows in self.into:
                    rows[-1][1] += data

        out = []
        for source in pages:
            page = Page()
            page.feed(source or "")
            first = next((i for i, rows in enumerate(page.found) if rows), None)
            rows = [] if first is None else [{"url": u, "label": " ".join(label.split())} for u, label in page.found[first]]
            out.append((None if first is None else selectors[first], rows))
        return pd.DataFrame(out, columns=["selector", "rows"])

    return parsed(html)
