"""Token operators that need a second table: stop lists, dictionaries, vocabularies."""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import drop_stop_words
from topicloom.runtime import materialise

LITERAL_WORDS = 20_000
PART_WORDS = 500_000  # words that are sent to a task at once


def stop_list_union(*lists: DataFrame) -> DataFrame:
    """Distinct words of all lists."""
    first, *rest = [table.select(F.col(table.columns[0]).alias("word")) for table in lists]
    for table in rest:
        first = first.union(table)
    return first.distinct()


def name_plurals(names: DataFrame, column: str) -> DataFrame:
    """Every name in lower case, and with an ``s``."""
    low = F.lower(F.col(column))
    return names.select(F.explode(F.array(low, F.concat(low, F.lit("s")))).alias("word"))


def vocabulary_size(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct words of the corpus: repeats go inside each document, then inside each task."""
    terms = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).distinct()
    return terms.agg(F.count(F.lit(1)).alias("vocab_size"))


def filter_by_stop_table(docs: DataFrame, stop_table: DataFrame, tokens: str = "tokens", literal_words: int = LITERAL_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """Drop listed and one-letter tokens where the list is a table.

    Up to ``literal_words`` words become a hash set inside the expression; a longer list is looked up.
    """
    words = stop_table.select(F.col(stop_table.columns[0]).alias("form")).where("form IS NOT NULL").distinct()
    head = words.limit(literal_words + 1).collect()
    if len(head) <= literal_words:
        return docs.withColumn(tokens, drop_stop_words(tokens, [r[0] for r in head]))
    marked = replace_tokens(docs, words.withColumn("value", F.lit("")), tokens, part_words)
    return _kept(marked, tokens, lambda t: F.length(t) > 1)


def lemmatise(docs: DataFrame, dictionary: DataFrame, tokens: str = "tokens", part_words: int = PART_WORDS) -> DataFrame:
    """Replace every token by its base form from ``(form, lemma)``; unknown tokens stay, blanks go.

    Of several base forms of a token the first in the alphabet counts.
    """
    one_each = dictionary.where("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("value"))
    replaced = replace_tokens(docs, one_each, tokens, part_words)
    return _kept(replaced.withColumn(tokens, F.transform(tokens, lambda t: F.trim(t))), tokens, lambda t: t != "")


def _kept(docs: DataFrame, tokens: str, test) -> DataFrame:
    kept = F.filter(tokens, lambda t: t.isNotNull() & test(t))
    return docs.withColumn(tokens, F.coalesce(kept, F.array().cast("array<string>")))


def replace_tokens(docs: DataFrame, table: DataFrame, tokens: str, part_words: int = PART_WORDS) -> DataFrame:
    """Put the ``value`` of ``(form, value)``, one row per form, in the place of every token that is listed.

    Inside the row: the words go to the tasks, and no token moves.  A table of more than ``part_words`` words is
    first cut down to the words of the corpus; what is left goes in parts of about that size, and the documents
    are written after each part, so that a task never holds more than one.  Every part looks at the
    tokens as they were, so no value is replaced again.
    """
    table = materialise(table.select("form", "value"), "words")
    if table.count() > part_words:
        used = docs.select(F.explode(F.array_distinct(tokens)).alias("form")).distinct()
        table = materialise(table.join(used, "form", "left_semi"), "words")
    parts = max(1, -(-table.count() // part_words))
    names = [c for c in docs.columns if c != tokens]
    now = docs.withColumn("_now", F.col(tokens))
    for part in range(parts):
        words = table.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == part).select("form", "value").toArrow()
        now = now.select(*names, tokens, _looked_up(docs, words)(F.col(tokens), F.col("_now")).alias("_now"))
        if part < parts - 1:
            now = materialise(now, "tokens")
    return now.select(*[F.col("_now").alias(c) if c == tokens else F.col(c) for c in docs.columns])


def _looked_up(docs: DataFrame, words: pa.Table):
    sent = docs.sparkSession.sparkContext.broadcast(words.combine_chunks())

    @F.arrow_udf("array<string>")
    def replace(tokens: pa.Array, now: pa.Array) -> pa.Array:
        forms, values = (sent.value.column(c).combine_chunks() for c in ("form", "value"))
        found = values.take(pc.index_in(tokens.flatten(), value_set=forms))
        ends = pc.cumulative_sum(tokens.value_lengths().fill_null(0).cast(pa.int32()))
        starts = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(starts, pc.coalesce(found, now.flatten()), mask=tokens.is_null())

    return replace


cloudpickle.register_pickle_by_value(sys.modules[__name__])
