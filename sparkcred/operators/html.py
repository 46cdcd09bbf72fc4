"""Listing rows, article bodies and links from landed HTML, with the parser of the standard library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.functions import lexicons as L

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self, drop: Callable[[Node], bool] = lambda n: False, sep: str = "") -> str:
        parts: list[str] = []

        def collect(n: Node) -> None:
            for c in n.children:
                if isinstance(c, Node):
                    if not drop(c):
                        collect(c)
                elif c.strip():
                    parts.append(c.strip())

        collect(self)
        return sep.join(parts)

    def matches(self, selector: str) -> bool:
        """A tag, #id, or .class.class selector of one element."""
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        if selector[0] == ".":
            return set(selector[1:].split(".")) <= self.classes
        return self.tag == selector


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "dt", "dd", "p"):
            up = self.at
            while up.parent and up.tag not in ("ul", "ol", "dl", "div", "body"):
                if up.tag == tag or tag in ("dt", "dd") and up.tag in ("dt", "dd"):
                    self.at = up.parent
                    break
                up = up.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up.parent and up.tag != tag:
            up = up.parent
        if up.parent:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def body_text(html: str | None) -> str:
    """Text of the first body container without scripts and side matter; '' where there is none."""
    root = parse(html)
    for sel in L.BODY_SELECTORS:
        for n in root.walk():
            if n.matches(sel):
                return n.text(lambda x: any(x.matches(d) for d in L.BODY_DROPS), " ")
    return ""


def listing_rows(html: str | None) -> list[tuple]:
    """(title, url, image_url, summary, press, time) of the items of a listing page, list kinds in order."""
    root = parse(html)
    lists = [u for box in root.walk() if "list_body" in box.classes for u in box.walk() if u.tag == "ul"]
    out = []
    for kind in L.LIST_CLASSES:
        for ul in lists:
            if kind not in ul.classes:
                continue
            for li in (n for n in ul.walk() if n.tag == "li"):
                inside = list(li.walk())
                dts = [n for n in inside if n.tag == "dt"]
                links = [n for n in (dts[-1].walk() if dts else inside) if n.tag == "a"]
                if not links:
                    continue
                span = lambda c: next((n.text() for n in inside if n.tag == "span" and c in n.classes), None)  # noqa: B023, E731
                img = next((n.attrs.get("src") for d in dts if "photo" in d.classes for n in d.walk() if n.tag == "img"), None)
                title, url = links[0].text(), links[0].attrs.get("href", "")
                if title and url:
                    press = span("writing")
                    out.append((title, url, img, span("lede") or "", L.UNKNOWN_PRESS if press is None else press, span("date")))
    return out


def listings(pages: DataFrame, page: str = "page", html: str = "html") -> DataFrame:
    """(page, pos, title, url, image_url, summary, press, time); null pages give no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(p, i, *row) for p, h in zip(pdf["page"], pdf["html"]) for i, row in enumerate(listing_rows(h), 1)]
            yield pd.DataFrame(out, columns=["page", "pos", "title", "url", "image_url", "summary", "press", "time"])

    schema = "page long, pos int, title string, url string, image_url string, summary string, press string, time string"
    return pages.select(F.col(page).cast("long").alias("page"), F.col(html).alias("html")).filter("html is not null").mapInPandas(run, schema)


def bodies(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, body) of article pages; null pages give ''."""

    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        return s.map(body_text)

    return pages.select(key, extract(html).alias("body"))


def links(pages: DataFrame, key: str = "url", html: str = "html", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, links, more...): distinct absolute links of a page in their order."""

    def found(base: str | None, h: str | None) -> list[str]:
        hrefs = (n.attrs.get("href", "").strip() for n in parse(h).walk() if n.tag == "a")
        return list(dict.fromkeys(urljoin(base or "", x) for x in hrefs if x and not x.startswith(("#", "javascript:"))))

    @F.pandas_udf("array<string>")
    def extract(u: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([found(a, b) for a, b in zip(u, s)])

    return pages.select(key, extract(key, html).alias("links"), *more)


def absolute_links(html, base: str) -> F.Column:
    """HTML without scripts, with protocol-relative and root-relative addresses made absolute."""
    x = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, r"""(?i)(href|src)=(["'])//""", "$1=$2https://")
    return F.regexp_replace(x, r"""(?i)(href|src)=(["'])/(?!/)""", "$1=$2" + base.rstrip("/") + "/")
