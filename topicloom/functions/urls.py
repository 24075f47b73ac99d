"""Docket numbers and years out of addresses and case ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A path part of four digits, else a whole word from 1700 to 2029.
YEAR_PATH = r"/(\d{4})/"
YEAR_WORD = r"\b(1[7-9]\d{2}|20[0-2]\d)\b"


def docket(url: Column) -> Column:
    """Digits and hyphens of the last path part, without trailing slashes and ``.html``."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.regexp_replace(F.replace(last, F.lit(".html"), F.lit("")), "[^0-9-]", "")


def docket_digits(url: Column) -> Column:
    """The study's variant: digits of whatever follows the last slash, possibly none."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), "[^0-9]", "")


def year_from_url(url: Column, first: int | None = None, last: int | None = None) -> Column:
    """The year an address names, or null; years outside optional bounds become null too."""

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))

    year = F.coalesce(found(YEAR_PATH), found(YEAR_WORD)).cast("int")
    if first is not None:
        year = F.when(year >= first, year)
    if last is not None:
        year = F.when(year <= last, year)
    return year


def year_from_case_id(case_id: Column) -> Column:
    """The number before the first hyphen; anything else there is an error (ANSI cast)."""
    return F.split(case_id, "-")[0].cast("int")


def year_date(year: Column) -> Column:
    """A ``yyyy`` string as the first day of that year."""
    return F.to_date(year, "yyyy")
