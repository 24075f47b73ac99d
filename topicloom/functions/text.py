"""Text cleaning and token expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that become one blank, in this order, before every other character outside a-z does.
PHRASES = ("\u00a0" * 4, "n't", "'m", "'ll")


def _without_phrases(text: Column | str) -> Column:
    cleaned = F.lower(F.coalesce(_col(text), F.lit("")))
    for phrase in PHRASES:
        cleaned = F.replace(cleaned, F.lit(phrase), F.lit(" "))
    return cleaned


def normalize(text: Column | str) -> Column:
    """Lower-case; phrases, then all characters but a-z and blanks, become one blank; null gives ``""``."""
    return F.regexp_replace(_without_phrases(text), "[^a-z ]", " ")


def pieces(text: Column | str) -> Column:
    """Words of the normalised text, with empty strings at the ends: split at what would become blanks,
    which saves writing the normalised text."""
    return F.split(_without_phrases(text), "[^a-z]+")


def words(text: Column | str) -> Column:
    """Blank-separated words of the normalised text; null and empty give an empty array."""
    return F.filter(pieces(text), lambda w: w != "")


def drop_stop_words(tokens: Column | str, stop_words: Iterable[str], min_length: int = 2) -> Column:
    """Tokens of at least ``min_length`` characters that are not stop words (a hash set in the plan)."""
    return _keep(tokens, stop_words, lambda w: F.length(w) >= min_length)


def drop_stop_words_study(tokens: Column | str, stop_words: Iterable[str]) -> Column:
    """The study's variant: only one-character tokens go, so empty tokens stay."""
    return _keep(tokens, stop_words, lambda w: F.length(w) != 1)


def _keep(tokens, stop_words, long_enough) -> Column:
    listed = sorted(set(stop_words))
    if not listed:
        return F.filter(_col(tokens), long_enough)
    return F.filter(_col(tokens), lambda w: long_enough(w) & ~w.isin(listed))


def clean_tokens(text: Column | str, stop_words: Iterable[str], min_length: int = 2) -> Column:
    """Normalise, split and filter in one expression: one filter drops blanks, short and stop words."""
    return drop_stop_words(pieces(text), stop_words, min_length)


def join_tokens(tokens: Column | str) -> Column:
    return F.array_join(_col(tokens), " ")


def vectoriser_tokens(text: Column | str) -> Column:
    """Runs of two or more word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def ellipsis(text: Column | str, width: int, always: bool = False) -> Column:
    """The first ``width`` characters and ``...``; a text that fits is left alone unless ``always``."""
    text = _col(text)
    cut = F.concat(F.substring(text, 1, width), F.lit("..."))
    return cut if always else F.when(F.length(text) > width, cut).otherwise(text)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
