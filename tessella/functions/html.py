"""Pages: decoding, visible text and links. The standard parser is used; no third-party one is needed."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = frozenset(("script", "style", "noscript", "form", "button", "input"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: The labels of a listing's link to its next page.
NEXT = ("seguinte", "próximo", "proximo")


def decode(content: bytes) -> str:
    """Windows-1252; where that has no such byte, UTF-8, and else whatever UTF-8 can read."""
    for encoding in ("cp1252", "utf-8"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", errors="replace")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.inside, self.any_body = False, False
        self.body: list[str] = []
        self.all: list[str] = []
        self.links: list[list[str]] = []
        self.open_link = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.inside = self.any_body = True
        if tag in HIDDEN and tag not in VOID:
            self.hidden.append(tag)
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.links.append([href, ""])
            self.open_link = True

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag == "body":
            self.inside = False
        if tag == "a":
            self.open_link = False

    def handle_data(self, data: str) -> None:
        if self.open_link:
            self.links[-1][1] += data
        if not self.hidden:
            self.all.append(data)
            if self.inside:
                self.body.append(data)


def _read(page: str) -> _Reader:
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader


def visible_text(page: str) -> str:
    """The text nodes of the body, a line each, blanks collapsed, empty lines dropped."""
    reader = _read(page)
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "\n".join(reader.body if reader.any_body else reader.all).split("\n"))
    return "\n".join(line for line in lines if line)


def listing_links(page: str, base: str) -> list[tuple[str, str]]:
    """("doc", url) of every document link and ("next", url) of the last link to a next page."""
    docs, following = [], []
    for href, label in _read(page).links:
        if "OpenDocument" in href:
            docs.append(("doc", urljoin(base + "/", href)))
        elif "Start=" in href and label.strip().lower() in NEXT:
            following = [("next", urljoin(base + "/", href))]
    return docs + following


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda x: decode(bytes(x)), na_action="ignore")


@F.pandas_udf(T.StringType())
def page_text(page: pd.Series) -> pd.Series:
    return page.map(visible_text, na_action="ignore")


def page_links(base: str):  # noqa: ANN201
    """A function of a page column: array of (kind, url)."""

    @F.pandas_udf("array<struct<kind:string,url:string>>")
    def links(page: pd.Series) -> pd.Series:
        return page.map(lambda p: [{"kind": k, "url": u} for k, u in listing_links(p, base)] if p is not None else [])

    return links
