"""Words and lines of a text as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def words_of(text: Column | str) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(as_column(text), F.lit("")), BLANKS), lambda w: w != "")


def lines_of(text: Column | str) -> Column:
    """The lines of a text in order; none for null."""
    return F.split(F.coalesce(as_column(text), F.lit("")), "\n")


def has_word(line: Column) -> Column:
    return line.rlike(WORD)
