"""What a run tells about itself, measured while its stages are written: no table is read again for it.

Measures ride along as observed metrics of the pass that writes a stage.  Each is a small aggregate of fixed size
per task, so that the driver gets a bounded amount from every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.text import ellipsis
from topicloom.operators.trend import summary_of_counts, top_of_counts
from topicloom.plans.preprocess import CleanParams, clean_documents

MEDIAN_ACCURACY = 10_000  # the median's rank is off by one in so many rows at most
STATS = "measure string, n bigint, kept bigint, removed bigint, mean double, median bigint, min bigint, max bigint"


def watched(df: DataFrame, column: str, minimum: int) -> tuple[DataFrame, Observation]:
    """The table with its measures of a whole number: rows, rows of at least ``minimum``, mean, median, extremes."""
    seen, value = Observation(column), F.col(column)
    measures = [
        F.count(F.lit(1)).alias("n"), F.count_if(value >= minimum).alias("kept"), F.avg(value).alias("mean"),
        F.percentile_approx(value, 0.5, MEDIAN_ACCURACY).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
    ]
    return df.observe(seen, *measures), seen


def watched_cleaning(docs: DataFrame, params: CleanParams = CleanParams(), text: str = "case_text") -> tuple[DataFrame, list[Observation]]:
    """``clean_documents`` with the measures of texts and tokens before each filter."""
    seen: list[Observation] = []

    def watch(df: DataFrame, column: str, minimum: int) -> DataFrame:
        df, one = watched(df, column, minimum)
        seen.append(one)
        return df

    return clean_documents(docs, params, text, watch), seen


def stats_table(docs: DataFrame, seen: list[Observation]) -> DataFrame:
    """``(measure, n, kept, removed, mean, median, min, max)``, a row for each watched value."""
    rows = []
    for one in seen:
        m = one.get
        rows.append((one._name, m["n"], m["kept"], m["n"] - m["kept"], m["mean"], m["median"], m["min"], m["max"]))
    return docs.sparkSession.createDataFrame(rows, STATS)


def first_texts(docs: DataFrame, key: str = "case_url", n: int = 3, text: str = "case_text", width: int = 200, tokens: str = "processed_text", n_tokens: int = 20) -> DataFrame:
    """The first rows of a written table: the start of their text and their first tokens."""
    return docs.limit(n).select(key, ellipsis(F.col(text), width, always=True).alias("text"), F.slice(tokens, 1, n_tokens).alias("tokens"))


def watched_topics(cases: DataFrame, n_topics: int, topic: str = "topic_number") -> tuple[DataFrame, Observation]:
    """The cases with a count for each of the model's topics."""
    seen = Observation("topics")
    return cases.observe(seen, *[F.count_if(F.col(topic) == t).alias(f"t{t}") for t in range(n_topics)]), seen


def topic_tables(words: DataFrame, seen: Observation, n_topics: int, n_largest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every topic's cases and words, and the largest topics."""
    kind = T.StructType([T.StructField("topic_number", T.IntegerType()), T.StructField("count", T.LongType())])
    counts = words.sparkSession.createDataFrame([(t, seen.get[f"t{t}"]) for t in range(n_topics)], kind)
    return summary_of_counts(counts, words, n_topics), top_of_counts(counts.where(F.col("count") > 0), words, n_largest)
