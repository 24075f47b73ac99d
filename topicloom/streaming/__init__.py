"""Row-local steps on a stream.

Cleaning and the year of an address need no state, so new documents can be cleaned as they arrive.
Everything that counts or fits works on finished tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from topicloom.operators.trend import with_year
from topicloom.plans.preprocess import CleanParams, clean_documents


def clean_stream(arriving: DataFrame, params: CleanParams = CleanParams(), url: str = "case_url", text: str = "case_text") -> DataFrame:
    """Cleaned documents with their year, from a ``readStream`` of cases."""
    return with_year(clean_documents(arriving, params, text), url)
