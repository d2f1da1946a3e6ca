"""Pages as documents: a tree of elements, what is not content cut out, and the first holder of content that is there."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Selectors of what is no content, and of what holds it, the first that a page has being taken.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", ".sidebar", ".advertisement")
HOLDERS = ("article", "main", ".content", ".post", ".article", "#content")
#: Fixed values of HTML: elements without an end, elements before which a paragraph ends, and those of a head.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that end an open one of the second kind, as long as none of the third lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "tr", "td", "th"), ("table",)),
}
_SPACES = re.compile(r"[\s﻿]+")


class Element:
    __slots__ = ("classes", "children", "name", "own")

    def __init__(self, name: str, attributes: dict[str, str | None]):
        self.name, self.own, self.children = name, attributes.get("id") or "", []
        self.classes = (attributes.get("class") or "").split()

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in self.classes
        return self.own == selector[1:] if selector[0] == "#" else self.name == selector


class Tree(HTMLParser):
    """Elements of a page in a stack. An end tag without its element is nothing; an element without its end ends with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root, self.head, self.body = Element("html", {}), Element("head", {}), Element("body", {})
        self.root.children = [self.head, self.body]
        self.stack, self.open, self.in_head = [self.head], Counter(), True

    def start_body(self) -> None:
        if self.in_head:
            self.in_head, self.stack = False, [self.body]

    def handle_starttag(self, tag, attrs):
        attributes = dict(reversed(attrs))  # of an attribute given twice the first counts
        if tag in ("html", "head"):
            return
        if tag == "body":
            self.start_body()
            self.body.classes, self.body.own = self.body.classes or (attributes.get("class") or "").split(), self.body.own or attributes.get("id") or ""
            return
        if self.in_head and len(self.stack) == 1 and tag not in HEAD:
            self.start_body()
        if tag in BLOCKS:
            self.end_open(("p",), ("button", "td", "th", "table"))
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        e = Element(tag, attributes)
        self.stack[-1].children.append(e)
        if tag not in VOID:
            self.stack.append(e)
            self.open[tag] += 1

    handle_startendtag = handle_starttag

    def end_open(self, names: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Ends the outermost open element of these names above the last one of ``within``."""
        found = None
        if not any(self.open[n] for n in names):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name in within:
                break
            if self.stack[at].name in names:
                found = at
        if found is not None:
            self.shut(found)

    def shut(self, at: int) -> None:
        self.open.subtract(e.name for e in self.stack[at:])
        del self.stack[at:]

    def handle_endtag(self, tag):
        if tag == "head":
            self.start_body()
        if not self.open[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name == tag:
                self.shut(at)
                return

    def handle_data(self, data):
        if self.in_head and len(self.stack) == 1:
            if not data.strip():
                return
            self.start_body()
        self.stack[-1].children.append(data)


def elements(root: Element):
    """All elements below one, in the order of the page."""
    stack = [root]
    while stack:
        e = stack.pop()
        if e is not root:
            yield e
        stack += [c for c in reversed(e.children) if not isinstance(c, str)]


def text_of(e: Element) -> str:
    out, stack = [], [e]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.name != "template":
            stack += reversed(x.children)
    return "".join(out)


def cut_out(root: Element, selectors: tuple[str, ...]) -> None:
    for e in (root, *elements(root)):
        e.children = [c for c in e.children if isinstance(c, str) or not any(c.matches(s) for s in selectors)]


def squeezed(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def read_page(html: str, url: str | None, dropped: tuple[str, ...] = DROPPED, holders: tuple[str, ...] = HOLDERS) -> tuple[str, str, str]:
    """(title, content, holder) of a page; holder is the selector whose elements the content is of, or body."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    cut_out(tree.root, dropped)
    found = {s: [] for s in ("title", "h1", *holders)}
    for e in elements(tree.root):
        for s, own in found.items():
            if e.matches(s):
                own.append(e)
    title = "".join(map(text_of, found["title"])) or "".join(map(text_of, found["h1"][:1])) or (urlsplit(url or "").hostname or "")
    holder = next((s for s in holders if found[s]), "body")
    content = "".join(map(text_of, found.get(holder, ())))
    if not content:
        holder, content = "body", text_of(tree.body)
    return squeezed(title), squeezed(content), holder


def page_documents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", dropped: tuple[str, ...] = DROPPED, holders: tuple[str, ...] = HOLDERS) -> DataFrame:
    """The id, title, content, holder of each page.

    Elements of ``dropped`` go with all they hold. The content is the text of all elements of the first of ``holders`` that the page
    has (an element within another one of them counts again), else or if that is empty of the body; entities are decoded and white space is one space. The title
    is that of the head, else the first heading, else the host of the address. Selectors are a name, .class or #id. Null pages are
    empty; a page is parsed whole by one task. Broken markup: see Tree.
    """
    name = {"id": id_col, "html": html_col, "url": url_col}
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            read = [read_page(h or "", u, dropped, holders) for h, u in zip(batch["html"], batch["url"])]
            yield pd.DataFrame({id_col: batch["id"], **{c: [r[k] for r in read] for k, c in enumerate(("title", "content", "holder"))}})

    thin = pages.select(*(F.col(c).alias(k) for k, c in name.items()))
    return thin.mapInPandas(run, f"`{id_col}` {kind}, title string, content string, holder string")
