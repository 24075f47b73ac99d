"""Pages to case links, and case pages to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.content import page_text
from topicloom.operators.links import case_links, distinct_links, explode_anchors
from topicloom.sources.stages import write_in_batches


def collect_links(pages: DataFrame, marker: str, exclude: str) -> DataFrame:
    """Index pages to distinct ``(case_url, docket)``."""
    return distinct_links(case_links(explode_anchors(pages), marker, exclude))


def extract_text(case_urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``case_text`` to every case; a page that was not fetched or holds no text gives ``""``.

    Of several copies of a page the first by ``page_id`` counts.  It is chosen from addresses and ids
    alone, combined per task, so a page crawled millions of times costs one row per task, and only the
    chosen pages are parsed.  Addresses and ids are unique from there on: no join key is hot.
    """
    wanted = case_urls.select(F.col("case_url").alias("url"))
    chosen = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).join(wanted, "url", "left_semi")
    texts = page_text(pages.join(chosen, ["url", "page_id"], "left_semi").select("url", "html"), key="url")
    # rows that repeat both address and id are one page
    found = texts.groupBy(F.col("url").alias("case_url")).agg(F.min("case_text").alias("case_text"))
    return case_urls.join(found, "case_url", "left").na.fill("", ["case_text"])


def extract_text_in_batches(case_urls: DataFrame, pages: DataFrame, path: str, size: int = 5000, max_jobs: int = 16) -> DataFrame:
    """The same, written batch by batch so that a failed run continues.  Every job reads the pages once,
    so ``max_jobs`` bounds how often they are read."""
    return write_in_batches(case_urls, path, "case_url", size, max_jobs, lambda batch: extract_text(batch, pages)).drop("batch")
