"""Topic counts over time: groups, complete grids, totals and the viewer's layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import ellipsis
from topicloom.functions.topics import condense, topic_name
from topicloom.functions.urls import year_from_url
from topicloom.runtime import once, sized


def with_year(df: DataFrame, url: str = "case_url", first: int | None = None, last: int | None = None) -> DataFrame:
    """Add ``year`` and drop the rows whose address names none."""
    return once(df, "year", year_from_url(F.col(url), first, last)).na.drop(subset=["year"])


def count_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Observed groups and their sizes: counted per task first, so a hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def year_topic_counts(df: DataFrame) -> DataFrame:
    """Observed pairs; a null year or topic forms no group."""
    return count_by(df.where("year IS NOT NULL AND topic_number IS NOT NULL"), "year", "topic_number")


def yearly_totals(df: DataFrame) -> DataFrame:
    return count_by(df.where("year IS NOT NULL"), "year", name="total_cases")


def value_counts(df: DataFrame, key: str, by_index: bool = False) -> DataFrame:
    counts = count_by(df, key)
    return counts.orderBy(key) if by_index else counts.orderBy(F.desc("count"), key)


def count_every_column(df: DataFrame, key: str = "year") -> DataFrame:
    """Non-null values of every other column per key."""
    return df.groupBy(key).agg(*[F.count(c).alias(c) for c in df.columns if c != key])


def year_topic_grid(counts: DataFrame) -> DataFrame:
    """Every year from first to last, by every topic from 0 to the highest seen.

    Two ``explode`` calls over one row of bounds; the bounds come from the counts, not the cases.  They
    read the count column too, so that the plan below is the same as in a join of these counts and its
    exchange is used twice.
    """
    bounds = counts.agg(
        F.min("year").alias("first"), F.max("year").alias("last"), F.max("topic_number").alias("top"), F.sum("count").alias("n")
    ).where("n > 0")
    years = bounds.select(F.explode(F.sequence("first", "last")).alias("year"), "top")
    return years.select("year", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("topic_number"))


def observed_grid(counts: DataFrame, year: str = "year", topic: str = "topic_number") -> DataFrame:
    """Observed years by observed topics (the counts hold one row per pair, so both sets are small)."""
    seen = counts.agg(F.collect_set(year).alias("_years"), F.collect_set(topic).alias("_topics"), F.sum("count").alias("_n"))
    return seen.where("_n > 0").select(F.explode("_years").alias(year), "_topics").select(year, F.explode("_topics").alias(topic))


def fill_grid(grid: DataFrame, counts: DataFrame, keys: list[str], value: str = "count", kind: str = "int") -> DataFrame:
    """Left join the counts to a complete grid; a missing cell is 0."""
    return grid.join(counts, keys, "left").select(*keys, F.coalesce(F.col(value), F.lit(0)).cast(kind).alias(value))


def trend_table(cases: DataFrame) -> DataFrame:
    """``(year, topic_number, count, topic_name)`` over the complete grid.

    The cases are read and shuffled once: the grid's bounds and the joined counts share one exchange.
    """
    counts = year_topic_counts(cases)
    filled = fill_grid(year_topic_grid(counts), counts, ["year", "topic_number"])
    return filled.withColumn("topic_name", topic_name(F.col("topic_number")))


def pivot_fill(counts: DataFrame, topics: list[int], year: str = "year", topic: str = "topic_number", value: str = "count") -> DataFrame:
    """Year by topic matrix, one column per topic, empty cells 0."""
    return counts.groupBy(year).pivot(topic, topics).agg(F.sum(value).cast("double")).na.fill(0.0)


def melt(matrix: DataFrame, year: str = "year", topic: str = "topic_number", value: str = "count") -> DataFrame:
    """Back from the matrix to one row per year and topic."""
    cells = [c for c in matrix.columns if c != year]
    return matrix.unpivot([year], [F.col(f"`{c}`") for c in cells], topic, value).withColumn(
        topic, F.col(topic).cast("int")
    )


def observed_topics(counts: DataFrame, topic: str = "topic_number") -> list[int]:
    """The distinct topics of a counts table, for naming a pivot's columns (one per model topic)."""
    return sorted(r[0] for r in counts.select(topic).distinct().collect())


def with_condensed(df: DataFrame, topic: str = "topic_number") -> DataFrame:
    return df.withColumn("condensedtopics", condense(F.col(topic)))


def exclude_topic(df: DataFrame, topic: int, column: str = "topic_number") -> DataFrame:
    return df.where(F.col(column) != topic)


def condensed_counts(df: DataFrame) -> DataFrame:
    """A literal 1 per case, counted by year and condensed topic."""
    known = df.where("year IS NOT NULL AND condensedtopics IS NOT NULL")
    return known.withColumn("count", F.lit(1)).groupBy("year", "condensedtopics").agg(F.count("count").alias("count"))


def join_details(df: DataFrame, details: DataFrame, on: str = "condensedtopics") -> DataFrame:
    """Inner join with the topic details; topics without details drop out."""
    return df.join(sized(details), on, "inner")


def condensed_trend(cases: DataFrame, details: DataFrame, excluded: int = 2) -> DataFrame:
    """The study's chart table: condense, exclude, count, fill over observed pairs, add details, sort by year."""
    kept = exclude_topic(with_condensed(cases), excluded)
    described = join_details(kept, details.select("condensedtopics"))
    counts = condensed_counts(described)
    keys = ["year", "condensedtopics"]
    filled = fill_grid(observed_grid(counts, *keys), counts, keys, kind="double")
    return join_details(filled, details).orderBy("year", "condensedtopics")


def year_sums(trend: DataFrame) -> DataFrame:
    return trend.groupBy("year").agg(F.sum("count").alias("count"))


def sorted_series(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def viewer_layout(trend: DataFrame) -> DataFrame:
    """Rename the chart table to the fields the viewer reads."""
    return trend.select(
        F.col("year").cast("string").alias("date"),
        F.col("count").alias("value"),
        F.col("topicname").alias("key"),
        "title",
        "leadpp",
        "topicwords",
        "exampleURL",
    )


def top_topics(cases: DataFrame, words: DataFrame, n: int = 5, width: int = 80) -> DataFrame:
    """The ``n`` largest topics and the start of their words."""
    return top_of_counts(count_by(cases, "topic_number"), words, n, width)


def top_of_counts(counts: DataFrame, words: DataFrame, n: int = 5, width: int = 80) -> DataFrame:
    """The same from ``(topic_number, count)``."""
    largest = counts.orderBy(F.desc("count"), "topic_number").limit(n)
    return largest.join(words, "topic_number", "left").select(
        "topic_number", "count", ellipsis(F.col("topic_words"), width, always=True).alias("keywords")
    )


def topic_summary(cases: DataFrame, words: DataFrame, n_topics: int, width: int = 100) -> DataFrame:
    """Every topic from 0 with its number of cases, also zero, and the start of its words."""
    return summary_of_counts(count_by(cases, "topic_number"), words, n_topics, width)


def summary_of_counts(counts: DataFrame, words: DataFrame, n_topics: int, width: int = 100) -> DataFrame:
    """The same from ``(topic_number, count)``."""
    every = counts.sparkSession.range(n_topics).select(F.col("id").cast("int").alias("topic_number"))
    joined = every.join(counts, "topic_number", "left").join(words, "topic_number", "left")
    return joined.select(
        "topic_number",
        F.coalesce("count", F.lit(0)).alias("count"),
        ellipsis(F.col("topic_words"), width).alias("keywords"),
    ).orderBy("topic_number")


def lookup_words(cases: DataFrame, words: DataFrame) -> DataFrame:
    """Add each case's topic words; an unknown topic gets null."""
    return cases.join(sized(words), "topic_number", "left")


def between_years(df: DataFrame, extent: tuple[int, int] | None, year: Column | str = "year") -> DataFrame:
    """The rows inside the chosen extent; no extent keeps all."""
    if extent is None:
        return df
    return df.where((F.col(year) if isinstance(year, str) else year).between(*extent))


def select_layer(df: DataFrame, key: object | None, column: str = "key") -> DataFrame:
    """One layer, or all when none is chosen."""
    return df if key is None else df.where(F.col(column) == key)
