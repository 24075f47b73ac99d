"""Term weights: counts, document frequencies, vocabulary, smoothed IDF, L2-normalised TF-IDF.

Weights exist in two forms.  *Vectors* (one sparse vector per document) never shuffle: the vocabulary
goes to the executors and Spark ML counts, scales and normalises inside the row.  That holds while the
vocabulary has at most ``local_terms`` terms; a larger one is joined to the counted terms instead.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import cached_property

import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import drop_stop_words
from topicloom.functions.wordlists import english_words
from topicloom.runtime import materialise, number_rows, sized

VECTOR_STRUCT = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


@dataclass(frozen=True)
class WeightParams:
    """``max_df`` is a share of all documents, ``min_df`` a number of them (None: by vocabulary size)."""

    max_df: float = 0.95
    min_df: int | None = None
    max_features: int | None = 5000
    stop_words: tuple[str, ...] = ()
    local_terms: int = 1_000_000


# The settings used for each model.
STANDARD = WeightParams(0.95, None, 5000)
FALLBACK = WeightParams(0.99, 1, 1000)
STUDY_FINAL = WeightParams(0.80, 5, None)
STUDY_LSA = WeightParams(0.80, 2, None)
STUDY_LDA = WeightParams(0.80, 2, None)
SMALL_VOCABULARY = 100

SORTABLE_TERMS = 100_000  # as many as one task may number
RANGES = 256  # of counts, told apart in one pass
PART_ROWS = 1_000_000  # about as many rows of a term are joined in one place


def with_english(params: WeightParams) -> WeightParams:
    """The settings with the English list as the weights' own stop words (needs a running session)."""
    return replace(params, stop_words=tuple(sorted({*params.stop_words, *english_words()})))


def countable(tokens: Column | str, stop_words=()) -> Column:
    """The tokens a vectoriser counts: two characters or more, not in its own stop list."""
    return drop_stop_words(tokens, stop_words, 2)


def term_counts(docs: DataFrame, key: str = "doc_id", tokens: str = "tokens", stop_words=()) -> DataFrame:
    """``(key, term, tf)``.

    A document is one row, so its terms are counted there: sort the tokens, keep where a run starts,
    subtract neighbouring starts.  Nothing shuffles.
    """
    words = docs.select(key, F.sort_array(countable(tokens, stop_words)).alias("_w"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1))
    )
    runs = words.select(key, "_w", F.when(F.size("_w") > 0, starts).alias("_s"))
    entries = F.transform(
        "_s",
        lambda i, j: F.struct(
            F.get("_w", i).alias("term"),
            (F.coalesce(F.get("_s", j + 1), F.size("_w")) - i).cast("bigint").alias("tf"),
        ),
    )
    return runs.select(key, F.explode(entries).alias("_e")).select(key, "_e.term", "_e.tf")


def term_stats(docs: DataFrame, tokens: str = "tokens", stop_words=()) -> DataFrame:
    """``(term, df, total)`` in one pass: in the sorted tokens of a document, a term counts as new where
    it differs from its left neighbour.  Counted per task before the one shuffle by term."""
    words = docs.select(F.sort_array(countable(tokens, stop_words)).alias("_w"))
    left = F.concat(F.array(F.lit(None).cast("string")), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))))
    zipped = F.when(F.size("_w") > 0, F.arrays_zip(F.col("_w").alias("term"), left.alias("left")))
    pairs = words.select(F.explode(zipped).alias("_p"))
    return pairs.groupBy("_p.term").agg(
        F.count_if(~F.col("_p.term").eqNullSafe(F.col("_p.left"))).alias("df"), F.count(F.lit(1)).alias("total")
    )


def adaptive_min_df(vocab_size: Column) -> Column:
    """1 for a very small vocabulary, else 2."""
    return F.when(vocab_size < SMALL_VOCABULARY, F.lit(1)).otherwise(F.lit(2))


def prune_by_df(stats: DataFrame, n_docs: int, min_df: int, max_df: float) -> DataFrame:
    """Terms in at least ``min_df`` documents and at most ``max_df`` of all; both bounds are kept."""
    return stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))


def cap_features(stats: DataFrame, max_features: int | None) -> DataFrame:
    """The terms of largest total count; ties go to the earlier term.

    A cap that one task may sort is a top-n.  A larger one is found by counting: terms above the count where the
    cap falls are in, and of those that have just this count the first in the alphabet fill it up.
    """
    if max_features is None:
        return stats
    if max_features <= SORTABLE_TERMS:
        return stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    limit, above, ties = _count_at(stats, max_features)
    if above + ties <= max_features:
        return stats.where(F.col("total") >= limit)
    level = stats.where(F.col("total") == limit)
    first = number_rows(level, "term").where(F.col("row_index") < max_features - above).select("term")
    return stats.where(F.col("total") > limit).unionByName(level.join(first, "term", "left_semi"))


def _count_at(stats: DataFrame, place: int) -> tuple[int, int, int]:
    """The total count of the term at ``place`` from the top, how many terms are above it and how many have it;
    the smallest count when there are fewer terms.

    Counts are narrowed down by a histogram of ``RANGES`` equal ranges per pass, so only that many rows
    reach the driver each time.
    """
    low, high = stats.agg(F.min("total"), F.max("total")).first()
    if low is None:
        return 0, 0, 0
    above = 0
    while True:
        width = -(-(high - low + 1) // RANGES)
        place_of = F.floor((F.col("total") - low) / width)
        found = stats.where(F.col("total").between(low, high)).groupBy(place_of.alias("range")).count().orderBy(F.desc("range")).collect()
        for row in found:
            if above + row["count"] >= place or row is found[-1]:
                low, high = low + row["range"] * width, low + (row["range"] + 1) * width - 1
                if width == 1:
                    return low, above, row["count"]
                break
            above += row["count"]


def index_terms(stats: DataFrame, bounded: bool) -> DataFrame:
    """0-based index in alphabetical order; a single-task window only over a bounded vocabulary."""
    if bounded:
        position = F.row_number().over(Window.orderBy("term")) - 1
        return stats.withColumn("term_id", position.cast("int"))
    numbered = number_rows(stats, "term", "term_id").withColumn("term_id", F.col("term_id").cast("int"))
    return stats.join(numbered, "term")


def idf(df: Column, n_docs: int) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + df)) + 1


class TermWeights:
    """A fitted vocabulary ``(term, df, total, term_id, idf)`` and what it does to documents."""

    def __init__(self, vocabulary: DataFrame, n_docs: int, params: WeightParams):
        self.vocabulary, self.n_docs, self.params = vocabulary, n_docs, params

    @cached_property
    def n_terms(self) -> int:
        return self.vocabulary.count()

    @property
    def local(self) -> bool:
        """Whether the vocabulary is small enough to send to the executors."""
        return self.n_terms <= self.params.local_terms

    @cached_property
    def _ordered(self):
        if not self.local:
            raise ValueError(f"vocabulary of {self.n_terms} terms exceeds local_terms={self.params.local_terms}; use the joined form")
        return self.vocabulary.orderBy("term_id").select("term", "idf").toPandas()

    @cached_property
    def _vocabulary_array(self):
        """The terms as a JVM array, handed over in one string: word by word takes long for many terms."""
        newline = self.vocabulary.sparkSession._jvm.java.util.regex.Pattern.compile("\n")
        return newline.split("\n".join(self._ordered["term"]))

    def count_vectors(self, docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
        """``(key, features)``: raw counts per document; unseen terms are ignored."""
        return self._counter(tokens, "features").transform(docs.select(key, tokens)).select(key, "features")

    def vectors(self, docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
        """``(key, features)``: normalised TF-IDF per document, also for documents without known terms."""
        return self.with_vectors(docs.select(key, tokens), tokens).select(key, "features")

    def with_vectors(self, docs: DataFrame, tokens: str = "tokens") -> DataFrame:
        """The documents with all their columns and ``features``."""
        scale = ElementwiseProduct(scalingVec=Vectors.dense(self._ordered["idf"].to_numpy()), inputCol="_counts", outputCol="_scaled")
        norm = Normalizer(p=2.0, inputCol="_scaled", outputCol="features")
        return norm.transform(scale.transform(self._counter(tokens, "_counts").transform(docs))).drop("_counts", "_scaled")

    def _counter(self, tokens: str, output: str) -> CountVectorizerModel:
        counter = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", self._vocabulary_array)
        return counter.setInputCol(tokens).setOutputCol(output)

    def weighted(self, docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
        """``(key, term_id, weight)``, one row per document and known term."""
        if self.local:
            parts = self.vectors(docs, key, tokens).select(key, sparse_parts("features").alias("_v"))
            entries = parts.select(key, F.explode(F.arrays_zip("_v.term_ids", "_v.weights")).alias("_e"))
            return entries.select(key, F.col("_e.term_ids").alias("term_id"), F.col("_e.weights").alias("weight"))
        return self.weighted_by_join(docs, key, tokens)

    def weighted_by_join(self, docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
        """The same by a join on the term; the norm is a window over one document's own terms.

        A term's document frequency tells how many rows it brings.  Terms with more than ``PART_ROWS`` are cut
        into parts by their documents, so that no join key has more rows than about that; the list of such
        terms is short and written, so that Catalyst knows its size.
        """
        norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))
        return self._scaled(docs, key, tokens).select(key, "term_id", (F.col("_x") / norm).alias("weight"))

    def _scaled(self, docs: DataFrame, key: str, tokens: str) -> DataFrame:
        """``(key, term_id, _x)``: the weights before they are normalised."""
        cut = F.explode(F.sequence(F.lit(0), parts_of(F.col("df")) - 1)).alias("_part")
        repeated = self.vocabulary.select("term", "term_id", "idf", cut)
        counted = hot_parts(term_counts(docs, key, tokens), self.vocabulary, key)
        return counted.join(repeated, ["term", "_part"]).select(key, "term_id", (F.col("tf") * F.col("idf")).alias("_x"))

    def matrix(self, docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
        """``(key, term_ids, weights)``: the sparse rows as a written table, for repeated passes."""
        if self.local:
            written = materialise(self.vectors(docs, key, tokens), "matrix", f"`{key}` {docs.schema[key].dataType.simpleString()}, features {VECTOR_STRUCT}")
            return written.select(key, F.col("features.indices").alias("term_ids"), F.col("features.values").alias("weights"))
        # a row is normalised when its terms are together, so that its entries are sorted by document once
        entries = F.sort_array(F.collect_list(F.struct("term_id", "_x"))).alias("_e")
        rows = self._scaled(docs, key, tokens).groupBy(key).agg(entries)
        norm = F.sqrt(F.aggregate("_e._x", F.lit(0.0), lambda a, x: a + x * x))
        rows = rows.select(key, "_e", F.explode(F.array(norm)).alias("_n"))
        full = docs.select(key).join(rows, key, "left")
        return materialise(
            full.select(
                key,
                F.coalesce("_e.term_id", F.array().cast("array<int>")).alias("term_ids"),
                F.coalesce(F.transform("_e._x", lambda x: x / F.col("_n")), F.array().cast("array<double>")).alias("weights"),
            ),
            "matrix",
        )

    def count_matrix(self, docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
        """``(key, term_ids, weights)`` with the raw counts as weights; terms are counted inside the row."""
        if self.local:
            vectors = self.count_vectors(docs, key, tokens)
            written = materialise(vectors, "counts", f"`{key}` {docs.schema[key].dataType.simpleString()}, features {VECTOR_STRUCT}")
            return written.select(key, F.col("features.indices").alias("term_ids"), F.col("features.values").alias("weights"))
        known = term_counts(docs, key, tokens).join(self.vocabulary.select("term", "term_id"), "term")
        rows = known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term_id", F.col("tf").cast("double").alias("tf")))).alias("_e"))
        full = docs.select(key).join(rows, key, "left")
        cells = [F.coalesce(f"_e.{name}", F.array().cast(kind)).alias(out) for name, kind, out in (("term_id", "array<int>", "term_ids"), ("tf", "array<double>", "weights"))]
        return materialise(full.select(key, *cells), "counts")

    def save(self, path: str) -> None:
        """The vocabulary with the number of documents and the parameters beside every term."""
        notes = {"n_docs": F.lit(self.n_docs), "params": F.lit(json.dumps(asdict(self.params)))}
        self.vocabulary.withColumns(notes).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> TermWeights:
        table = spark.read.parquet(path)
        first = table.select("n_docs", "params").first()
        saved = json.loads(first["params"])
        return cls(table.drop("n_docs", "params"), first["n_docs"], WeightParams(**saved | {"stop_words": tuple(saved["stop_words"])}))


def parts_of(df: Column) -> Column:
    """Into how many parts a term of this document frequency is cut."""
    return F.greatest(F.ceil(df / PART_ROWS), F.lit(1)).cast("int")


def hot_parts(counted: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """The counted terms with their ``_part``, by a hash of the document."""
    hot = sized(vocabulary.where(F.col("df") > PART_ROWS).select("term", parts_of(F.col("df")).alias("_parts")), "hot-terms")
    part = F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part")
    return counted.join(hot, "term", "left").select(key, "term", "tf", part)


def sparse_parts(features: str) -> Column:
    """``struct(term_ids, weights)`` of a sparse vector column; the Arrow buffers are passed on unread."""

    @F.arrow_udf("struct<term_ids:array<int>,weights:array<double>>")
    def parts(vectors: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([vectors.field("indices"), vectors.field("values")], ["term_ids", "weights"])

    return parts(features)


def fit_weights(docs: DataFrame, params: WeightParams = STANDARD, key: str = "doc_id", tokens: str = "tokens") -> TermWeights:
    """Fit vocabulary and IDF; when nothing survives pruning, fit again with the lenient settings.

    ``docs`` is passed over twice, to count it and for its term statistics, which are written once.
    """
    n_docs = docs.count()
    stats = materialise(term_stats(docs, tokens), "term-stats")
    min_df = params.min_df
    if min_df is None:
        min_df = 1 if stats.limit(SMALL_VOCABULARY).count() < SMALL_VOCABULARY else 2
    fitted = _select_terms(stats, n_docs, replace(params, min_df=min_df))
    if fitted.n_terms == 0:
        lenient = replace(FALLBACK, local_terms=params.local_terms)
        fitted = _select_terms(stats, n_docs, lenient)
        if fitted.n_terms == 0:
            raise ValueError("no terms remain after pruning; the documents may be empty or all stop words")
    return fitted


def _select_terms(stats: DataFrame, n_docs: int, params: WeightParams) -> TermWeights:
    listed = sorted(set(params.stop_words))
    allowed = stats.where(~F.col("term").isin(listed)) if listed else stats
    kept = cap_features(prune_by_df(allowed, n_docs, params.min_df, params.max_df), params.max_features)
    indexed = index_terms(kept, bounded=params.max_features is not None and params.max_features <= SORTABLE_TERMS)
    vocabulary = materialise(indexed.withColumn("idf", idf(F.col("df"), n_docs)), "vocabulary")
    return TermWeights(vocabulary, n_docs, params)

