"""Tokens to topics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from topicloom.operators.nmf import NmfModel, NmfParams, fit_nmf
from topicloom.operators.topics import assign_topics, top_words
from topicloom.operators.trend import lookup_words
from topicloom.operators.weights import STANDARD, TermWeights, WeightParams, fit_weights, sparse_parts, with_english
from topicloom.runtime import materialise


@dataclass
class TopicRun:
    """The labelled documents, the topic words, and the fitted weights and model behind them."""

    topic_modeled: DataFrame
    topic_words: DataFrame
    weights: TermWeights
    model: NmfModel


def model_topics(docs: DataFrame, params: NmfParams, weighting: WeightParams | None = None, n_words: int = 40, key: str = "case_url", tokens: str = "processed_text") -> TopicRun:
    """Weigh the terms (by default with the standard settings and the English list), fit the topics once, label
    every document and add its topic's words.

    The words (one row per topic) are written first: with their size known, Catalyst broadcasts them
    instead of shuffling the documents by topic, where one large topic would fill a task.
    """
    weights = fit_weights(docs, weighting or with_english(STANDARD), key, tokens)
    matrix = weights.matrix(docs, key, tokens)
    model = fit_nmf(matrix, weights.vocabulary, weights.n_terms, params, key)
    words = materialise(top_words(model.topic_terms(weights.vocabulary), n_words), "topic-words")
    labelled = label_documents(docs, matrix, weights, model, key, tokens)
    return TopicRun(lookup_words(labelled, words).select(*docs.columns, "topic_number", "topic_strength", "topic_words"), words, weights, model)


def label_documents(docs: DataFrame, matrix: DataFrame, weights: TermWeights, model: NmfModel, key: str, tokens: str) -> DataFrame:
    """The documents with their topic: weighed and solved inside the row where vocabulary and factors are
    small enough to send, so that the texts do not shuffle; else joined by key."""
    if not (weights.local and model.local):
        return docs.join(assign_topics(model.transform(matrix, key)), key)
    parts = weights.with_vectors(docs, tokens).withColumn("_v", sparse_parts("features"))
    solved = parts.withColumn("topics", model.strengths(parts["_v.term_ids"], parts["_v.weights"]))
    return assign_topics(solved.select(*docs.columns, "topics"))
