"""Text, title, speaker and date candidates of HTML pages.

The one place where Python runs: pages are parsed in Arrow batches with a small
element tree (standard library parser, lenient: unclosed elements stay open,
stray end tags are ignored) and a selector subset: tags, classes, descendants
and next siblings. Everything after it is JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.text import clean_text
from chronolex.sources import sites

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
REMOVED = ("script", "style", "nav", "footer", "header", "aside")
PARTS = ("p", "li", "h1", "h2", "h3", "blockquote")
PLAIN_PARTS = ("p", "li", "h1", "h2", "h3")
META_DATES = ("article:published_time", "pubdate", "date", "dc.date")


class Element:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        self.classes = set((attributes.get("class") or "").split())

    def walk(self) -> Iterator[Element]:
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def strings(self) -> list[str]:
        out: list[str] = []
        stack: list[Element | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return out

    def text(self) -> str:
        return " ".join(s for s in map(str.strip, self.strings()) if s)

    def sibling_before(self) -> Element | None:
        before = None
        for c in self.parent.children if self.parent else ():
            if c is self:
                return before
            if isinstance(c, Element):
                before = c
        return None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("[root]", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _fits(e: Element, simple: str) -> bool:
    tag, *classes = simple.split(".")
    return (not tag or e.tag == tag) and all(c in e.classes for c in classes)


def select(root: Element, selector: str) -> list[Element]:
    """All elements a selector means, in document order."""
    steps = selector.split()
    if "+" in steps:
        first, _, second = steps
        return [e for e in root.walk() if _fits(e, second) and (b := e.sibling_before()) is not None and _fits(b, first)]

    def inside(e: Element, outer: list[str]) -> bool:
        if not outer:
            return True
        up = e.parent
        while up is not None:
            if _fits(up, outer[-1]) and inside(up, outer[:-1]):
                return True
            up = up.parent
        return False

    return [e for e in root.walk() if _fits(e, steps[-1]) and inside(e, steps[:-1])]


def _drop(root: Element, tags: tuple[str, ...]) -> None:
    for e in [root, *root.walk()]:
        e.children = [c for c in e.children if isinstance(c, str) or c.tag not in tags]


def _gather(root: Element, selectors: list[str], enough: int) -> list[str]:
    """The parts of the first selector with enough text, else of the last that has any."""
    parts: list[str] = []
    for s in selectors:
        found = [e.text() for box in select(root, s) for e in box.walk() if e.tag in PARTS]
        if found:
            parts = found
            if sum(map(len, parts)) >= enough:
                break
    return parts


def body_text(root: Element, selectors: list[str] | None) -> str:
    parts = _gather(root, selectors or sites.CONTENT, 300)
    if parts:
        return "\n\n".join(p for p in parts if p)
    parts = _gather(root, sites.CONTENT, 500) or [e.text() for e in root.walk() if e.tag in PLAIN_PARTS]
    text = "\n\n".join(p for p in parts if p)
    return text if len(text) >= 500 else "\n".join(root.strings())


def _first(root: Element, selectors: list[str]) -> str | None:
    for s in selectors:
        found = select(root, s)
        if found and found[0].text():
            return found[0].text()
    return None


def _meta(root: Element, name: str, keys: tuple[str, ...] = ("property", "name")) -> str | None:
    metas = [e for e in root.walk() if e.tag == "meta"]
    for key in keys:
        for e in metas:
            if e.attributes.get(key) == name:
                if e.attributes.get("content"):
                    return e.attributes["content"]
                break
    return None


def read(html: str, url: str | None) -> dict[str, object]:
    """``text, title, speaker, dates`` of a page."""
    site = sites.site_of(urlparse(url).hostname if url else None)
    root = parse(html)
    _drop(root, REMOVED)
    text = body_text(root, site.content if site else None)
    title = _first(root, site.title) if site else None
    title = title or _first(root, sites.TITLE)
    if not title:
        for e in root.walk():
            if e.tag == "title":
                title = " ".join("".join(e.strings()).split())
                break
    title = title or (_meta(root, "og:title", ("property",)) or "").strip() or next((e.text() for e in root.walk() if e.tag in ("h1", "h2") and e.text()), None)
    speaker = (_meta(root, "author", ("name",)) or _meta(root, "article:author", ("property",)) or "").strip() or _first(root, site.speaker if site else sites.SPEAKER)
    dates = [d for d in (_meta(root, n) for n in META_DATES) if d]
    for s in site.date if site else sites.DATE:
        found = select(root, s)
        if found and found[0].text():
            dates.append(found[0].text())
    return {"text": text, "title": " ".join(title.split()) if title else None, "speaker": speaker, "dates": dates}


def parse_pages(pages: DataFrame, html_col: str = "raw_content", url_col: str = "source_url", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep, text, title, speaker, dates`` of HTML pages; the text cleaned, null pages left out."""
    kept = pages.filter(F.col(html_col).isNotNull()).select(*keep, F.col(html_col).alias("_html"), F.col(url_col).alias("_url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [read(h, u) for h, u in zip(b["_html"], b["_url"])]
            out = b[list(keep)].reset_index(drop=True)
            yield out.assign(**{c: [f[c] for f in found] for c in ("text", "title", "speaker", "dates")})

    fields = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    parsed = kept.mapInPandas(run, f"{fields}, text string, title string, speaker string, dates array<string>")
    return parsed.withColumn("text", clean_text(F.col("text")))


def url_title(url: Column) -> Column:
    """The last part of a URL, for pages without any title."""
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
