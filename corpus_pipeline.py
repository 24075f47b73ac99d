"""The corpus pipeline: documents in, token ids out, one operator after the other.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import language, line_dedup, mixing, near_dup, pieces
from topicloom.llm.registry import PIECE_MODEL
from topicloom.llm.words import WORD
from topicloom.runtime import scratch_root

MIN_SCORE = 0.35  # of the language, a mean chance; four languages guessed blindly have 0.25


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or with a score below the limit go."""
    net = language.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    found = language.predict(docs, net)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def by_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; documents of which nothing with a word is left go."""
    done = line_dedup.dedup_lines(docs, line_dedup.EVERY_LINE)
    left = done.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def by_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    gone = near_dup.near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the expected tokens of the domains of ``labels`` reach the target weights."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    return pieces.encode(docs.select("doc_id", "text", "lang", "source"), pieces.load(PIECE_MODEL))


STAGES = [
    ("language", by_language),
    ("lines", by_line),
    ("near_duplicates", by_near_duplicate),
    ("mixing", by_weight),
    ("sentencepiece", to_ids),
]
ORACLE_SQL = None  # trained and iterative stages; tests compare each with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
