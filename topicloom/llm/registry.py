"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import divergence, language, licences, line_dedup, mixing, near_dup, neighbours, packing, passages, pieces, quality, rules, vector_codes

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MODEL = "/opt/tokenizers/word_bpe_49k.json"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op4_near_duplicates")
def _(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query("op5_nearest_vectors")
def _(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


@query("op1_quality")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model, scorer, _ = quality.fit(docs)
    return quality.classify(docs, model, scorer).select("doc_id", "votes", "label", "score", "kept")


def held_out():
    """Two thirds of the documents may teach, the rest is held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


@query("op2_language_id")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    net = language.fit(docs.where("NOT held_out").select(F.col("doc_id").alias("id"), "text", "lang"))
    found = language.predict(docs.select("doc_id", "held_out", "text"), net)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op3_adaptive_rules", rules.rules_sql())
def _(spark, folder):
    return rules.apply_rules(table(spark, folder, "documents"))


@query("op8_line_dedup")
def _(spark, folder):
    done = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), line_dedup.EVERY_LINE)
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.xxhash64("text").alias("text_hash"))


@query("op7_sentencepiece")
def _(spark, folder):
    model = pieces.load(PIECE_MODEL)
    done = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), model)
    return done.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "decodes")


@query("op9_mixing")
def _(spark, folder):
    rates = mixing.mixing_rates(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rates.select("doc_id", "domain", "n_tokens", "rate", "copies")


@query("op10_licences")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.fit(docs)).drop("text")
    families = F.array_sort(F.array_distinct(F.transform(F.filter("licences", lambda x: x["confirmed"]), lambda x: x["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(families, ",").alias("confirmed_families"),
        F.array_max(F.transform("licences", lambda x: x["chance"])).alias("max_chance"),
    )


@query("op6_passages")
def _(spark, folder):
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op12_source_divergence", divergence.audit_sql())
def _(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


@query("op13_packing")
def _(spark, folder):
    placed = packing.pack(table(spark, folder, "documents").select("doc_id", "text"), WORD_MODEL)
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op11_vector_codes", vector_codes.codes_sql())
def _(spark, folder):
    codes, books = vector_codes.compress(table(spark, folder, "embeddings"))
    done = vector_codes.with_label_errors(codes)
    return done.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
