"""Index addresses and crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id bigint, url string, html string"


def year_index_urls(spark: SparkSession, root: str, start: int = 1760, end: int = 2018) -> DataFrame:
    """One index address per year, both ends included."""
    return index_urls_between(spark.range(1).select(F.lit(start).alias("first"), F.lit(end).alias("last")), root)


def index_urls_between(bounds: DataFrame, root: str) -> DataFrame:
    """The same for ``(first, last)`` bounds held in a table."""
    years = bounds.select(F.explode(F.sequence(F.col("first"), F.col("last"))).alias("year"))
    return years.select("year", F.concat(F.lit(root), F.col("year").cast("string")).alias("index_url"))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawl results as ``(page_id, url, html)``."""
    return spark.read.schema(PAGES).parquet(path)
