"""The whole run: links, text, tokens, topics, trend."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.wordlists import default_stop_words
from topicloom.operators.nmf import NmfParams
from topicloom.operators.trend import trend_table, with_year, yearly_totals
from topicloom.operators.weights import WeightParams
from topicloom.plans.collect import collect_links, extract_text, extract_text_in_batches
from topicloom.plans.model import model_topics
from topicloom.plans.preprocess import CleanParams, check_cleaned
from topicloom.plans.report import first_texts, stats_table, topic_tables, watched_cleaning, watched_topics
from topicloom.runtime import spread_small
from topicloom.sources.files import write_csv, write_topic_words
from topicloom.sources.stages import StageStore


@dataclass(frozen=True)
class RunParams:
    marker: str = ""
    exclude: str = "/years/"
    clean: CleanParams | None = None
    weighting: WeightParams | None = None
    nmf: NmfParams = field(default_factory=NmfParams)
    n_words: int = 40
    exports: bool = True
    batch_size: int | None = None


def run_all(store: StageStore, pages: DataFrame | None, params: RunParams) -> dict[str, DataFrame]:
    """Collect and extract where those tables are missing, always clean, model and count; every stage is
    written and read back.  ``pages`` is needed only while the first two tables are missing; with a
    ``batch_size`` their text is extracted in batches that survive a failed run.

    Beside the stages it returns what the run tells about itself: ``text_stats``, ``first_texts``,
    ``topic_summary``, ``top_topics`` and ``summary``, measured while the stages were written."""
    results = {
        "case_urls": store.get_or_build("case_urls", lambda: collect_links(_needed(pages), params.marker, params.exclude)),
        "full_cases": store.get_or_build("full_cases", lambda: _texts(store, _needed(pages), params.batch_size)),
    }
    clean = params.clean or CleanParams(stop_words=default_stop_words())
    cases = spread_small(results["full_cases"])
    cleaned, seen = watched_cleaning(cases, clean)
    processed = store.write("processed", cleaned)
    results["processed_cases"] = check_cleaned(results["full_cases"], processed, clean)
    results["text_stats"], results["first_texts"] = stats_table(processed, seen), first_texts(processed)
    run = model_topics(processed, params.nmf, params.weighting, params.n_words)
    results["topic_words"] = store.write("topic_words", run.topic_words)
    labelled, topics = watched_topics(run.topic_modeled, params.nmf.n_topics)
    results["topic_modeled"] = store.write("topic_modeled", labelled)
    results["topic_summary"], results["top_topics"] = topic_tables(results["topic_words"], topics, params.nmf.n_topics)
    dated = with_year(results["topic_modeled"].select("case_url", "topic_number"))
    results["visualization_data"] = store.write("visualization_data", trend_table(dated))
    results["yearly_totals"] = store.write("yearly_totals", yearly_totals(dated))
    results["summary"] = results["topic_modeled"].agg(F.count(F.lit(1)).alias("total_cases")).withColumn("n_topics", F.lit(params.nmf.n_topics))
    if params.exports:
        write_csv(results["case_urls"], f"{store.root}/case_urls_csv")
        write_csv(results["visualization_data"].orderBy("year", "topic_number"), f"{store.root}/visualization_data_csv")
        write_csv(results["yearly_totals"].orderBy("year"), f"{store.root}/yearly_totals_csv")
        write_topic_words(results["topic_words"], f"{store.root}/topic_words_json")
    return results


def _texts(store: StageStore, pages: DataFrame, batch_size: int | None) -> DataFrame:
    cases = store.read("case_urls")
    if batch_size is None:
        return extract_text(cases, pages)
    return extract_text_in_batches(cases, pages, f"{store.root}/full_cases_batches", batch_size)


def _needed(pages: DataFrame | None) -> DataFrame:
    if pages is None:
        raise ValueError("the first two stages are missing: pages are needed to build them")
    return pages
