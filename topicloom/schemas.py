"""The fixed schema of every stage table, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


CASE_URLS = "case_url string, docket string"
FULL_CASES = "case_url string, docket string, case_text string"
PROCESSED = (
    "case_url string, docket string, case_text string, text_length bigint, "
    "processed_text array<string>, token_count bigint, processed_text_str string"
)
TOPIC_MODELED = (
    "case_url string, docket string, case_text string, text_length bigint, "
    "processed_text array<string>, token_count bigint, processed_text_str string, "
    "topic_number int, topic_strength double, topic_words string"
)
TOPIC_WORDS = "topic_number int, topic_words string"
VISUALIZATION_DATA = "year int, topic_number int, count int, topic_name string"
YEARLY_TOTALS = "year int, total_cases bigint"
TOPIC_DETAILS = (
    "condensedtopics int, topicname string, title string, exampleURL string, leadpp string, topicwords string"
)
YEAR_DATA = "date string, value int"
YEAR_TOPIC_DATA = (
    "date string, value int, key string, title string, leadpp string, topicwords string, exampleURL string"
)

STAGES: dict[str, tuple[str, str]] = {
    "case_urls": (CASE_URLS, "collect_links"),
    "full_cases": (FULL_CASES, "extract_text"),
    "processed": (PROCESSED, "preprocess"),
    "topic_modeled": (TOPIC_MODELED, "model_topics"),
    "topic_words": (TOPIC_WORDS, "model_topics"),
    "visualization_data": (VISUALIZATION_DATA, "trend_table"),
    "yearly_totals": (YEARLY_TOTALS, "trend_table"),
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Select and cast to ``schema``; a missing column fails at analysis."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields])
