"""Topic columns: strongest topic, names, condensing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similar topics of the 30-topic model and the topic each is merged into.
CONDENSED = ((20, 24), (25, 1), (2, 12), (27, 26), (18, 29), (5, 29), (8, 7), (22, 7), (15, 16), (9, 14), (19, 3))


def strongest_topic(strengths: Column) -> Column:
    """0-based index of the largest strength; the lowest index wins a tie."""
    return (F.array_position(strengths, F.array_max(strengths)) - 1).cast("int")


def topic_strength(strengths: Column) -> Column:
    return F.array_max(strengths)


def topic_name(topic: Column) -> Column:
    return F.concat(F.lit("Topic "), topic.cast("string"))


def condense(topic: Column, mapping: tuple[tuple[int, int], ...] = CONDENSED) -> Column:
    """Merge similar topics; a topic without an entry keeps its number."""
    if not mapping:
        return topic.cast("int")
    merged = F
    for old, new in mapping:
        merged = merged.when(topic == old, F.lit(new))
    return merged.otherwise(topic).cast("int")
