"""Links out of index pages.

A page is one row, so everything per page (matches, previews, profiles) is computed inside the row
from its array of anchors; only the distinct list of links shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.html import anchors, container_count, page_title
from topicloom.functions.urls import docket, docket_digits
from topicloom.runtime import once


def explode_anchors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per anchor: ``(key, position, tag, href, text)``."""
    return pages.select(key, F.posexplode(anchors(F.col(html))).alias("position", "_a")).select(
        key, "position", "_a.tag", "_a.href", "_a.text"
    )


def is_case_link(href: Column, marker: str, exclude: str) -> Column:
    return (href != "") & href.contains(marker) & ~href.contains(exclude)


def is_case_link_tag(tag: Column, needed: str, *excluded: str) -> Column:
    """The study's filter: patterns tried on the whole tag."""
    kept = tag.rlike(needed)
    for pattern in excluded:
        kept = kept & ~tag.rlike(pattern)
    return kept


def case_links(links: DataFrame, marker: str, exclude: str, href: str = "href") -> DataFrame:
    """Links to cases with their docket; a link without docket characters is dropped."""
    kept = links.where(is_case_link(F.col(href), marker, exclude))
    return once(kept, "docket", docket(F.col(href))).where(F.col("docket") != "")


def case_links_study(links: DataFrame, needed: str, *excluded: str) -> DataFrame:
    """The study's links: whole-tag filter, digits-only docket, empty dockets kept."""
    kept = links.where(is_case_link_tag(F.col("tag"), needed, *excluded))
    return kept.withColumn("docket", docket_digits(F.col("href")))


def distinct_links(links: DataFrame, href: str = "href") -> DataFrame:
    """One row per address.  The docket follows from the address, so distinct pairs are distinct addresses;
    copies are dropped per task before the shuffle."""
    return links.select(F.col(href).alias("case_url"), "docket").distinct()


def _matched(html: Column, marker: str, exclude: str) -> Column:
    return F.filter(
        anchors(html), lambda a: is_case_link(a["href"], marker, exclude) & (docket(a["href"]) != "")
    )


def links_per_page(pages: DataFrame, marker: str, exclude: str, key: str = "page_id") -> DataFrame:
    """Matches of every page before duplicates are dropped; no shuffle."""
    return pages.select(key, F.size(_matched(F.col("html"), marker, exclude)).cast("bigint").alias("n_links"))


def link_total(links: DataFrame, href: str = "href") -> DataFrame:
    """Distinct links over all pages."""
    return links.select(href).distinct().agg(F.count(F.lit(1)).alias("n_links"))


def link_preview(pages: DataFrame, marker: str, exclude: str, n: int = 3, width: int = 50, key: str = "page_id") -> DataFrame:
    """The first ``n`` matches of every page."""
    first = F.slice(_matched(F.col("html"), marker, exclude), 1, n)
    return pages.select(key, F.posexplode(first).alias("_pos", "_a")).select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_a.href").alias("href"),
        docket(F.col("_a.href")).alias("docket"),
        F.substring(F.col("_a.text"), 1, width).alias("title"),
    )


def link_patterns(pages: DataFrame, word: str, phrase: str, n: int = 5, width: int = 80, key: str = "page_id") -> DataFrame:
    """Per page and pattern (word in the address, number-number in the address, phrase in the text):
    how many anchors match, and the first ``n`` of them."""
    tests = {
        "word": lambda a: a["href"].contains(word),
        "number": lambda a: a["href"].rlike(r"\d+-\d+"),
        "phrase": lambda a: a["text"].contains(phrase),
    }

    def sample(a: Column) -> Column:
        return F.concat(a["href"], F.lit(" | "), F.substring(a["text"], 1, width))

    found = pages.select(key, anchors(F.col("html")).alias("_a"))
    profiles = F.array(*[
        F.struct(
            F.lit(name).alias("pattern"),
            F.size(F.filter("_a", test)).cast("bigint").alias("matches"),
            F.transform(F.slice(F.filter("_a", test), 1, n), sample).alias("samples"),
        )
        for name, test in tests.items()
    ])
    return found.select(key, F.explode(profiles).alias("_p")).select(key, "_p.*")


def page_profile(pages: DataFrame, words: str = "case|decision|result", key: str = "page_id") -> DataFrame:
    """Title and number of likely containers of every page."""
    html = F.col("html")
    return pages.select(
        key, page_title(html).alias("title"), container_count(html, words).cast("bigint").alias("containers")
    )
