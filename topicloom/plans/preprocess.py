"""Case text to tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import clean_tokens, join_tokens
from topicloom.operators.corpus import require_rows
from topicloom.runtime import once


@dataclass(frozen=True)
class CleanParams:
    min_length: int = 200
    min_tokens: int = 10
    stop_words: tuple[str, ...] = ()


def clean_documents(docs: DataFrame, params: CleanParams = CleanParams(), text: str = "case_text", watch: Callable | None = None) -> DataFrame:
    """Length filter, tokens, token filter: row-local, so it takes a stream as well as a table.

    ``watch(df, column, minimum)`` sees the rows before each filter and returns them (see ``report``).
    """
    watch = watch or (lambda df, column, minimum: df)
    measured = watch(docs.withColumn("text_length", F.length(text).cast("bigint")), "text_length", params.min_length)
    long_enough = measured.where(F.col("text_length") >= params.min_length)
    tokens = once(long_enough, "processed_text", clean_tokens(F.col(text), params.stop_words))
    counted = watch(tokens.withColumn("token_count", F.size("processed_text").cast("bigint")), "token_count", params.min_tokens)
    kept = counted.where(F.col("token_count") >= params.min_tokens)
    return kept.withColumn("processed_text_str", join_tokens("processed_text"))


def check_cleaned(docs: DataFrame, cleaned: DataFrame, params: CleanParams = CleanParams(), text: str = "case_text") -> DataFrame:
    """Fail with the reason when nothing is left of the documents."""
    if cleaned.isEmpty():
        require_rows(docs.where(F.length(text) >= params.min_length), "no documents remain after dropping short texts; check the text extraction")
        raise ValueError("no documents remain after tokenising; check the stop words")
    return cleaned
