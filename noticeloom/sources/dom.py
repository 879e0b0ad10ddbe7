"""A page's elements as a tree, the few selectors that boards need, and the text that a reader sees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

_SINGLE = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that end an open tag of their group, and where the search for it stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"td", "li", "div", "article", "section", "body"}),
           "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_BLOCKS = frozenset("p div li tr section".split())
_STEP = re.compile(r"""([a-zA-Z][\w-]*|\*)?((?:\#[\w-]+|\.[\w-]+|\[[^\]]+\]|:first-child|:last-child|:nth-child\(\d+\))*)$""")
_PART = re.compile(r"""\#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:([*^$]?=)["']?([^"'\]]*)["']?)?\]|:(first-child|last-child|nth-child\((\d+)\))""")


class Element:
    """A tag with its attributes, its children (elements and strings, in order) and its parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """The elements below this one, in the order of the page."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            one = todo.pop()
            yield one
            todo += [c for c in reversed(one.children) if isinstance(c, Element)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends, stop = _CLOSES.get(tag, ((), ()))
        one, last = self.at, None
        while ends and one.parent is not None and one.tag not in stop:
            last = one if one.tag in ends else last
            one = one.parent
        if last is not None:
            self.at = last.parent
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        if tag not in _SINGLE:
            self.at = made

    def handle_endtag(self, tag):
        one = self.at
        while one.parent is not None and one.tag != tag:
            one = one.parent
        if one.parent is not None:  # an end without a start is passed over
            self.at = one.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str | None) -> Element:
    """The tree of a page; broken markup gives the tree that can be made of it."""
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def forget(top: Element) -> None:
    """Takes a tree apart, so that it is freed at once: its elements refer to each other."""
    for e in [top, *top.walk()]:
        e.parent, e.children = None, []


@lru_cache(maxsize=4096)
def _steps(selector: str) -> tuple:
    """A selector without commas as steps (direct child, tag, tests), the last one first."""
    steps, direct = [], False
    for word in re.sub(r"\s*>\s*", " > ", selector).split():
        if word == ">":
            direct = True
            continue
        m = _STEP.match(word)
        if not m:
            raise ValueError(f"selector {selector!r}")
        steps.append((direct, None if m[1] in (None, "*") else m[1].lower(), tuple(p.groups() for p in _PART.finditer(m[2]))))
        direct = False
    return tuple(reversed(steps))


def _test(one: Element, part: tuple) -> bool:
    name, css, key, how, value, place, nth = part
    if name or css:
        return one.attrs.get("id") == name if name else css in one.attrs.get("class", "").split()
    if key:
        own = one.attrs.get(key)
        return own is not None and (not how or {"=": own == value, "*=": value in own, "^=": own.startswith(value), "$=": own.endswith(value)}[how])
    kin = [c for c in one.parent.children if isinstance(c, Element)]
    return kin[-1 if place == "last-child" else int(nth or 1) - 1:][:1] == [one]


def _fits(one: Element, steps: tuple, top: Element) -> bool:
    direct, tag, parts = steps[0]
    if tag and one.tag != tag or not all(_test(one, p) for p in parts):
        return False
    if len(steps) == 1:
        return True
    above = one.parent
    while above is not None and above.parent is not None:
        if _fits(above, steps[1:], top):
            return True
        if direct:
            return False
        above = above.parent
    return False


def select(top: Element, selector: str) -> list[Element]:
    """The elements below top that match one of a selector's alternatives, in the order of the page: tags, #id, .class,
    [attribute], with =, *=, ^= and $=, :nth-child and its kin, descendants and > children."""
    ways = [_steps(s) for s in selector.split(",") if s.strip()]
    return [e for e in top.walk() if any(_fits(e, w, top) for w in ways)]


def text(top: Element, without: str = "") -> str:
    """All text below an element, but for what matches `without`."""
    gone = {id(e) for e in select(top, without)} if without else set()
    out, todo = [], [top]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            out.append(one)
        elif id(one) not in gone:
            todo += reversed(one.children)
    return "".join(out)


def readable(top: Element, without: str = "", kept: str = "") -> str:
    """The text as lines: breaks and the ends of blocks are line ends, blanks are squeezed, no more than one line is empty. Blanks
    within what matches `kept` stay as they are written."""
    gone = {id(e) for e in select(top, without)} if without else set()
    written = {id(c) for e in select(top, kept) for c in [e, *e.walk()]} if kept else set()
    out, todo = [], [(top, False)]
    while todo:
        one, as_is = todo.pop()
        if isinstance(one, str):
            out.append(one.replace(" ", "\0") if as_is else one)
        elif one.tag == "br":
            out.append("\n")
        elif id(one) not in gone:
            if one.tag in _BLOCKS and one is not top:
                todo.append(("\n", False))
            todo += [(c, id(one) in written) for c in reversed(one.children)]
    lines = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+", " ", "".join(out).replace("\xa0", " ")))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", lines)).replace("\0", " ").strip()
