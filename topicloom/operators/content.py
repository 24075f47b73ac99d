"""Readable text of a page: selector chain, then paragraphs, then the whole page.

Which elements enclose a text needs the page's nesting, which no Spark expression follows, so a small
parser runs in an Arrow UDF over the page column.  Nothing shuffles.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import once

# Tags without content, tags that end an open paragraph, tags whose text never shows.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style template rp rt".split())


@dataclass(frozen=True)
class Selector:
    """A ``div`` that has all the classes, or whose class value contains a substring."""

    classes: tuple[str, ...] = ()
    contains: str = ""

    def matches(self, tag: str, value: str | None) -> bool:
        if tag != "div" or value is None:
            return False
        return self.contains in value and set(self.classes) <= set(value.split())


# The selector chain, most specific first.
SELECTORS = (
    Selector(classes=("caselawcontent", "searchable-content")),
    Selector(classes=("caselawcontent",)),
    Selector(classes=("searchable-content",)),
    Selector(contains="content"),
    Selector(contains="case"),
    Selector(contains="opinion"),
    Selector(contains="text"),
)
EXACT_CLASS = "caselawcontent searchable-content"


class _Outline(HTMLParser):
    """Text nodes of a page and, per element, the range of text nodes it encloses."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.elements: list[list] = []  # [tag, class value, first text, end of texts]
        self.open: list[int] = []
        self.new_text = True

    def handle_starttag(self, tag, attrs):
        self.new_text = True
        if tag in ENDS_PARAGRAPH:
            self._close("p")
        value = next((v or "" for k, v in attrs if k == "class"), None)
        self.elements.append([tag, value, len(self.texts), len(self.texts)])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.new_text = True
        self._close(tag)

    def handle_comment(self, data):
        self.new_text = True

    def handle_data(self, data):
        if self.open and self.elements[self.open[-1]][0] in SILENT:
            return
        if self.new_text:
            self.texts.append(data)
        else:
            self.texts[-1] += data
        self.new_text = False

    def _close(self, tag):
        if any(self.elements[i][0] == tag for i in self.open):
            while True:
                element = self.elements[self.open.pop()]
                element[3] = len(self.texts)
                if element[0] == tag:
                    break

    def finish(self):
        self.close()
        while self.open:
            self.elements[self.open.pop()][3] = len(self.texts)
        return self


def _stripped(texts, separator):
    return separator.join(t for t in (x.strip() for x in texts) if t)


def _page_text(html: str | None, selectors) -> tuple[str, str]:
    page = _parse(html)
    for selector in selectors:
        hits = [e for e in page.elements if selector.matches(e[0], e[1])]
        if hits:
            kept = [t for t in (_stripped(page.texts[e[2]:e[3]], " ") for e in hits) if len(t) > 100]
            if kept:
                return " ".join(kept), "selector"
            break
    paragraphs = (_stripped(page.texts[e[2]:e[3]], "") for e in page.elements if e[0] == "p")
    kept = [t for t in paragraphs if len(t) > 50]
    if kept:
        return " ".join(kept), "paragraph"
    whole = _stripped(page.texts, " ")
    return (whole, "page") if len(whole) > 200 else ("", "none")


def _exact_text(html: str | None, class_value: str) -> tuple[str, str]:
    page = _parse(html)
    hits = [e for e in page.elements if e[1] is not None and (e[1] == class_value or class_value in e[1].split())]
    return " ".join("".join(page.texts[e[2]:e[3]]) for e in hits), "exact" if hits else "none"


def _parse(html: str | None) -> _Outline:
    outline = _Outline()
    outline.feed(html or "")
    return outline.finish()


def _extract(pages: DataFrame, key: str, html: str, one_page) -> DataFrame:
    @F.arrow_udf("struct<case_text:string,rule:string>")
    def extract(batch: pa.Array) -> pa.Array:
        found = [one_page(page.as_py()) for page in batch]
        columns = [pa.array([text for text, _ in found], pa.string()), pa.array([rule for _, rule in found], pa.string())]
        return pa.StructArray.from_arrays(columns, ["case_text", "rule"])

    return once(pages.select(key, html), "_t", extract(html)).select(key, "_t.*")


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html", selectors=SELECTORS) -> DataFrame:
    """``(key, case_text, rule)``: text by the first rule that yields any, ``""`` when none does."""
    return _extract(pages, key, html, lambda page: _page_text(page, selectors))


def page_text_exact(pages: DataFrame, key: str = "page_id", html: str = "html", class_value: str = EXACT_CLASS) -> DataFrame:
    """The study's variant: raw text of the elements with exactly this class value, no minimum length."""
    return _extract(pages, key, html, lambda page: _exact_text(page, class_value))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
