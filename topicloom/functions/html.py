"""Anchors, titles and containers of raw pages as Spark expressions (no Python per row)."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
ANCHOR = r"(?is)<a(?=[\s>]).*?(?:</a>|(?=<a[\s>])|$)"  # a new anchor ends an open one
OPEN_TAG = r"(?is)^<[^>]*>"
HREF = r"""(?is)^<a\s(?:[^>]*\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
ANY_TAG = r"(?s)<[^>]*>"

# A reference without its semicolon still counts, but in an address not before "=", a letter or a digit.
NUMERIC = r"#[0-9]+;?|#[xX][0-9a-fA-F]+;?"
IN_TEXT = rf"&(?:{NUMERIC}|[A-Za-z][A-Za-z0-9]{{0,31}};?)"
IN_ADDRESS = rf"&(?:{NUMERIC}|[A-Za-z][A-Za-z0-9]{{0,31}}(?:;|(?![=A-Za-z0-9])))"
EDGES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
NUL = "\x00"

# Numbers that stand for another character than their own: those of an old code page, null and return.
OTHER_CHARACTER = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN, "")


def _lookup(table: dict[str, str]) -> Column:
    """A small fixed table as a map; two strings, so that a plan stays short until they are folded."""
    keys, values = (F.split(F.lit(NUL.join(side)), NUL) for side in (table.keys(), table.values()))
    return F.map_from_arrays(keys, values)


def _character(code: Column) -> Column:
    """The character of a number, as HTML reads it."""
    own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    other = F.element_at(_lookup({str(n): c for n, c in OTHER_CHARACTER.items()}), code.cast("string"))
    outside = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    silent = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
    return F.when(outside, "\ufffd").when(other.isNotNull(), other).when(silent, "").otherwise(own)


def _referred(reference: Column, partly: bool) -> Column:
    """What one reference stands for; an unknown one stays.  ``partly``: the longest known start counts."""
    body = F.substring(reference, 2, 40)
    digits = F.regexp_replace(body, r"^#[xX]?0*|;$", "")
    number = F.when(digits == "", "0").when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    names = _lookup(html5)
    starts = F.transform(F.sequence(F.greatest(F.length(body) - 1, F.lit(2)), F.lit(2), F.lit(-1)), lambda n: F.substring(body, 1, n))
    known = F.get(F.filter(starts, lambda start: F.map_contains_key(names, start)), 0) if partly else F.lit(None).cast("string")
    rest = F.concat(F.element_at(names, known), F.substr(body, F.length(known) + 1))
    named = F.coalesce(F.element_at(names, body), F.when(F.length(body) > 2, rest), reference)
    return F.when(~body.startswith("#"), named).when(F.length(digits) > 7, "\ufffd").otherwise(_character(number))


def unescape(text: Column, address: bool = False) -> Column:
    """The text with all named and numeric character references replaced, each once and the longest name first.

    Only texts with ``&`` pay for it.
    """
    pattern = IN_ADDRESS if address else IN_TEXT
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: _referred(r, not address))
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda part, char: F.concat(part, F.coalesce(char, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def anchor_tags(html: Column) -> Column:
    """Whole ``<a>`` elements in page order."""
    return F.regexp_extract_all(visible(html), F.lit(ANCHOR), F.lit(0))


def anchor_href(tag: Column) -> Column:
    """The address, in any quoting; ``""`` when there is none."""
    parts = [F.regexp_extract(tag, HREF, group) for group in (1, 2, 3)]
    return unescape(F.concat(*parts), address=True)


def anchor_text(tag: Column) -> Column:
    """Text nodes of the element, each stripped of blanks of any kind, joined without a separator."""
    nodes = F.split(tag, r"(?s)<[^>]*>")
    return F.array_join(F.transform(nodes, lambda node: F.regexp_replace(unescape(node), EDGES, "")), "")


def anchors(html: Column) -> Column:
    """Array of ``(tag, href, text)`` in page order."""
    return F.transform(
        anchor_tags(html),
        lambda tag: F.struct(tag.alias("tag"), anchor_href(tag).alias("href"), anchor_text(tag).alias("text")),
    )


def page_title(html: Column) -> Column:
    title = F.regexp_extract(visible(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return unescape(F.coalesce(F.nullif(title, F.lit("")), F.lit("No title")))


def container_count(html: Column, words: str = "case|decision|result") -> Column:
    """Number of ``div`` and ``section`` elements whose class matches ``words``."""
    opened = F.regexp_extract_all(visible(html), F.lit(r"(?is)<(?:div|section)\s[^>]*>"), F.lit(0))
    classes = F.transform(opened, lambda t: F.regexp_extract(t, r"""(?is)\sclass\s*=\s*["']?([^"'>]*)""", 1))
    return F.size(F.filter(classes, lambda c: c.rlike(words)))
