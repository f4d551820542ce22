"""Operator 8, main text of HTML pages by text-to-tag ratios.

The page is streamed through the parser of the standard library; no tree is built. Every block (the text
between two block-level tags) is a line with a text-to-tag ratio: its characters over its tags. What the elements say is evidence that
weighs the ratio: characters of links count an eighth, text that stands in no paragraph, heading, item or the like a quarter, text in
article or main elements four times; text in navigation, headers, footers, asides and forms, or in elements whose class, id or role names
them as menus, notices, adverts, comments and so on has the ratio 0. The ratios are smoothed with a Gaussian along the page, in which the border of
a container parts two lines as a line between them does, and lines from a share of the standard deviation of the smoothed ratios on form the
content cluster. Lines outside the cluster come in only as neighbours of its lines: selected is the smallest container (article,
main, section, div, cell, body, or the page) around all lines of the cluster. Where that is the body or the page, only those
containers in it are selected that hold lines of the cluster, and lines in none. If lines of the cluster lie in articles or main elements,
only the lines in such elements count, and only they are selected, the whole article with them. All selected lines are kept, short
ones too, except those with the ratio 0.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by a line feed.

Defined cases: a null or empty page, or one without text, has an empty text. Broken markup is read as the parser reads
it: an element that is never closed ends with the element around it. Repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexfreq.llm.scratch import arrow_map

# Elements by role.
ARTICLES = {"article", "main"}
CONTAINERS = ARTICLES | {"section", "div", "td", "body"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
# What is never shown as text, and what is shown but is not main text.
SILENT = {
    "applet", "audio", "button", "canvas", "datalist", "embed", "frameset", "head", "iframe", "input", "map", "noembed", "noframes",
    "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "video",
}
ASIDE = {"aside", "dialog", "footer", "form", "header", "menu", "nav"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in a class, id or role that say an element is not main text.
NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments",
    "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "disqus", "footer",
    "gdpr", "header", "hidden", "legal", "login", "masthead", "menu", "menubar", "meta", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notification", "pager", "pagination", "paywall", "popup", "promo", "promotion", "recommended", "related", "replies", "reply",
    "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags",
    "teaser", "toolbar", "topbar", "widget", "widgets",
}
# With one of these the name speaks of what an element goes with, such as content-with-sidebar.
ABOUT = {"with", "without", "has", "no", "layout"}
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
# Elements that hold their place on the stack; others may go unclosed.
_TRACKED = CONTAINERS | SILENT | ASIDE | {"a", "figure", "table", "ul", "ol", "dl", "blockquote", "section", "span", "details", "tr", "li", "p"}
WIDTH = 1.0
# Evidence: what characters of links, of text in no paragraph and of text in articles count for. Lines are content from this share of the deviation on.
LINK, BARE, ARTICLE = 1 / 8, 1 / 4, 4.0
SHARE = 0.3


def _says_so(name: str) -> bool:
    words = _WORD.findall(name)
    return not NAMES.isdisjoint(words) and ABOUT.isdisjoint(words)


class _Line(NamedTuple):
    text: str
    ratio: float    # text-to-tag ratio with the evidence; 0 for what is not main text
    container: int
    article: bool
    place: int      # lines and borders of containers before this one


class _Lines(HTMLParser):
    """Collects the blocks of a page as lines.

    Containers are numbered as they open; those inside container c have the numbers from c to last[c].
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[tuple[str, bool, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.tags = 0
        self.block = ""
        self.silent = 0
        self.aside = 0
        self.links = 0
        self.articles = 0
        self.borders = 0
        self.open = [0]
        self.around = [0]
        self.last = [0]
        self.whole = {0}
        self.in_article = [False]    # by container: whether it stands inside an article

    def _flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        linked = min(self.linked, len(text))
        self.parts, self.linked = [], 0
        if not text:
            return
        ratio = 0.0
        if not self.aside:
            ratio = (len(text) - linked + LINK * linked) / max(1, self.tags)
            ratio *= (BARE if not self.block or self.block in CONTAINERS else 1) * (ARTICLE if self.articles else 1)
        self.lines.append(_Line("" if self.aside else text, ratio, self.open[-1], self.articles > 0, len(self.lines) + self.borders))
        self.tags = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            self.block = "" if tag == "html" else tag
            if tag in ("p", "li") or tag in HEADINGS:
                self._close_open(tag)
        if tag in VOID or tag not in _TRACKED:
            return
        link = tag == "a" and any(name == "href" for name, _ in attrs)
        if tag == "a" and (not link or self.links):
            return
        named = bool(attrs) and not link and self._named(tag, attrs)
        silent = tag in SILENT or named and tag not in BLOCKS
        aside = not silent and (named or tag in ASIDE)
        if tag in CONTAINERS:
            self.around.append(self.open[-1])
            self.open.append(len(self.last))
            self.last.append(len(self.last))
            self.in_article.append(self.articles > 0 and tag not in ARTICLES)
            if tag == "body":
                self.whole.add(self.open[-1])
        self.borders += aside or tag in CONTAINERS
        self.articles += tag in ARTICLES
        self.links += link
        self.silent += silent
        self.aside += aside
        self.stack.append((tag, silent, aside))

    def _named(self, tag: str, attrs: list) -> bool:
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if not value or tag in ("article", "main", "body"):
                continue
            if name in ("class", "id", "role") and any(map(_says_so, value.lower().split())):
                return True
            if name == "style" and _HIDDEN.search(value.lower()):
                return True
        return False

    def _close_open(self, tag: str) -> None:
        """A paragraph or item ends where the next block begins, unless a container stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "p" or tag == "li" and self.stack[i][0] == "li":
                self._pop(i)
                return
            if self.stack[i][0] not in ("span", "a"):
                return

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, silent, aside = self.stack.pop()
            if aside:
                self._flush()
            self.silent -= silent
            self.aside -= aside
            self.articles -= tag in ARTICLES
            self.links -= tag == "a"
            self.borders += aside or tag in CONTAINERS
            if tag in CONTAINERS:
                self.last[self.open.pop()] = len(self.last) - 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
            self.block = ""
        if tag in _TRACKED:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._pop(i)
                    return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()
        self._pop(0)
        self.last[0] = len(self.last) - 1


def smoothed(ratios: np.ndarray, places: np.ndarray, width: float = WIDTH) -> np.ndarray:
    """A Gaussian over the neighbouring lines by the distance of their places; at the ends over those there are."""
    total, weight = ratios.copy(), np.ones(len(ratios))
    for step in range(1, min(int(np.ceil(width)) + 2, len(ratios))):
        near = np.exp(-(places[step:] - places[:-step])**2 / (2 * width**2))
        total[step:] += near * ratios[:-step]
        total[:-step] += near * ratios[step:]
        weight[step:] += near
        weight[:-step] += near
    return total / weight


def in_cluster(lines: list[_Line]) -> np.ndarray:
    """Whether each line belongs to the content cluster."""
    ratios = np.array([line.ratio for line in lines])
    smooth = smoothed(ratios, np.array([line.place for line in lines], float))
    return (ratios > 0) & (smooth >= min(SHARE * float(smooth.std()), float(smooth.max(where=ratios > 0, initial=0))))


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    dense = [line for line, inside in zip(lines, in_cluster(lines)) if inside] if lines else []
    if not dense:
        return ""
    articles = any(line.article for line in dense)
    found = {line.container for line in dense if line.article or not articles}
    around, most = min(found), max(found)
    while parser.last[around] < most:
        around = parser.around[around]
    while parser.in_article[around]:
        around = parser.around[around]
    chosen = [(around, parser.last[around])]
    if around in parser.whole and not articles:
        # Of the body only its parts with lines of the cluster; numbers of a part follow one another.
        parts = set()
        for container in found:
            while container not in parser.whole and parser.around[container] not in parser.whole:
                container = parser.around[container]
            parts.add(container)
        chosen = [(whole, whole) for whole in parser.whole]
        chosen += [(part, parser.last[part]) for part in parts if part not in parser.whole]
    inside = np.zeros(len(parser.last), bool)
    for first, last in chosen:
        inside[first:last + 1] = True
    return "\n".join(line.text for line in lines if line.ratio > 0 and inside[line.container] and (line.article or not articles))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(html.as_py()) for html in part["html"]]
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    wanted = pages.select("page_id", pages["url"].cast("string").alias("url"), "html")
    return arrow_map(wanted, run, f"page_id {kind}, url string, text string, n_chars bigint")


