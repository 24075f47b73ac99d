"""CSV, JSON and word-list files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATIN1 = "ISO-8859-1"


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Header line, no index column, quotes doubled inside quoted fields."""
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8") -> DataFrame:
    """Read with a declared schema (no inference pass); fields may hold line breaks."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def topic_words_object(words: DataFrame) -> DataFrame:
    """One JSON object, topic number to words, in topic order (one entry per topic of the model)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("topic_number"), F.col("topic_words"))))
    named = F.transform(entries, lambda e: F.struct(e["topic_number"].cast("string"), e["topic_words"]))
    return words.agg(F.to_json(F.map_from_entries(named)).alias("json"))


def write_topic_words(words: DataFrame, path: str) -> None:
    topic_words_object(words).write.mode("overwrite").text(path)


def read_word_list(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One word per line, lower-cased and trimmed, blanks dropped: ``(word)``."""
    lines = spark.read.option("encoding", encoding).schema("value string").csv(path)
    return lines.select(F.lower(F.trim("value")).alias("word")).where(F.col("word") != "")


def word_table(spark: SparkSession, words) -> DataFrame:
    """A word list held in memory as a table."""
    return spark.createDataFrame([(w,) for w in words], "word string")
