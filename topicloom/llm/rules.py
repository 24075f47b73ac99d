"""Quality rules whose limits follow the data.

Every document gets counts of words, symbols, repeated lines and repeated five-word windows.  The limits
on the measures made of them come from quantile sketches, one for each language and source: logarithmic
buckets with counts, so that sketches of parts merge by adding.  A group with few documents uses the
merged sketch of its language, a small language the one of all.  The limits are then joined to the
documents.  Everything is a DataFrame expression; the texts are read once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.words import has_word, lines_of, words_of
from topicloom.runtime import materialise

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# measure -> (numerator, denominator, scale, slack): whole numbers, numerator * scale div denominator
MEASURES = {
    "word_length": ("word_chars", "n_words", 100, 300),
    "symbols": ("n_symbols", "word_chars", 1000, 200),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 200),
    "repeats": ("n_repeat_words", "n_words", 1000, 100),
}


@dataclass(frozen=True)
class RuleParams:
    """A measure fails above ``q75 + spread * (q75 - q25) + slack``; the word length also below the mirrored limit.

    ``gamma`` is the ratio of neighbouring bucket limits: quantiles are right within 1 %.
    """

    spread: float = 6.0
    gamma: float = 1.02
    min_rows: int = 100
    min_words: int = 10
    max_repeat_percent: int = 20


def repeat_positions(hashes: str) -> Column:
    """Windows that occur twice or more as sorted ``(hash, position)``; empty when all differ."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.expr("CAST(array() AS array<struct<h:bigint,i:int>>)")).otherwise(pairs)


def with_counts(docs: DataFrame) -> DataFrame:
    """The counts of every whole text; the text itself is dropped."""
    df = docs.select(
        "doc_id",
        "lang",
        "source",
        words_of("text").alias("words"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.filter(lines_of("text"), has_word).alias("lines"),
    )
    positions = F.when(F.size("words") < WINDOW, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("words") - WINDOW))
    df = df.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(positions, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)])).alias("hashes"),
    )
    counts = [c for c in df.columns if c != "hashes"]
    df = df.select(*counts, repeat_positions("hashes").alias("pairs"))
    same = lambda i, j: F.get("pairs", i)["h"] == F.get("pairs", j)["h"]
    found = F.filter("pairs", lambda e, i: F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce(same(i, i - 1), F.lit(False)))
    df = df.select(*counts, F.sort_array(F.transform(found, lambda e: e["i"])).alias("at"))
    # each repeated window adds its words up to the next one's start
    covered = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    return df.select(*counts, F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"))


def base_failed(p: RuleParams) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))


def measure(name: str) -> Column:
    top, bottom, scale, _ = MEASURES[name]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {scale} * {top} DIV {bottom} END")


def sketches(counts: DataFrame, p: RuleParams) -> DataFrame:
    """``(lang, source, measure, bucket, n)``: bucket ``b`` holds values in ``(gamma^(b-1), gamma^b]``, -1 holds 0."""
    named = F.array(*[F.struct(F.lit(m).alias("measure"), measure(m).alias("v")) for m in MEASURES])
    rows = counts.select("lang", "source", F.inline(named)).where(F.col("v").isNotNull())
    bucket = F.when(F.col("v") <= 0, -1).otherwise(F.ceil(F.log(F.col("v").cast("double")) / F.lit(math.log(p.gamma)))).cast("int")
    return rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str], p: RuleParams) -> DataFrame:
    """``q25``, ``q75`` and the number of documents for each key and measure of a merged sketch."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = merged.select(
        "*",
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    value = lambda b: F.when(b < 0, 0.0).otherwise(2 * F.pow(F.lit(p.gamma), b) / (1 + p.gamma))
    at = lambda q: value(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket"))))
    return upto.groupBy(*keys, "measure").agg(F.max("total").alias("rows"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def limits(sketch: DataFrame, p: RuleParams) -> DataFrame:
    """One row for each language and source with the limits ``lo_*`` and ``hi_*`` of every measure."""
    own = quartiles(sketch, ["lang", "source"], p).alias("own")
    lang = quartiles(sketch, ["lang"], p).where(F.col("rows") >= p.min_rows).alias("of_lang")
    every = quartiles(sketch, [], p).alias("of_all")
    same_lang = F.col("own.lang").eqNullSafe(F.col("of_lang.lang")) & (F.col("own.measure") == F.col("of_lang.measure"))
    rows = own.join(lang, same_lang, "left").join(every, F.col("own.measure") == F.col("of_all.measure"))
    enough = F.col("own.rows") >= p.min_rows
    pick = lambda q: F.coalesce(F.when(enough, F.col(f"own.{q}")), F.col(f"of_lang.{q}"), F.col(f"of_all.{q}"))
    rows = rows.select(F.col("own.lang").alias("lang"), F.col("own.source").alias("source"), F.col("own.measure").alias("measure"), pick("q25").alias("q25"), pick("q75").alias("q75"))
    reach = p.spread * (F.col("q75") - F.col("q25"))
    of = lambda m, x: F.max(F.when(F.col("measure") == m, x))
    return rows.groupBy("lang", "source").agg(
        *[of(m, F.col("q75") + reach + slack).alias(f"hi_{m}") for m, (_, _, _, slack) in MEASURES.items()],
        of("word_length", F.col("q25") - reach - MEASURES["word_length"][3]).alias("lo_word_length"),
    )


def apply_rules(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """One row for each row of ``docs`` with its counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words: all counts 0, ``base_failed`` true.  Null languages and sources form
    groups of their own.  Repeated rows are counted and returned as often as they occur; further
    columns of ``docs`` are ignored.  A measure whose denominator is 0 cannot fail.
    """
    counts = materialise(with_counts(docs), "rule-counts")
    fences = limits(sketches(counts, p), p).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = counts.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    outside = F.lit(False)
    for m in MEASURES:
        outside = outside | F.coalesce(measure(m) > F.col(f"hi_{m}"), F.lit(False))
    outside = outside | F.coalesce(measure("word_length") < F.col("lo_word_length"), F.lit(False))
    failed = base_failed(p)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~outside).alias("kept")
    )


def rules_sql(p: RuleParams = RuleParams()) -> str:
    """The same in DuckDB's SQL over ``documents``."""
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {s} * {a} // {b} AS v FROM counts WHERE {b} > 0" for m, (a, b, s, _) in MEASURES.items())
    slack = " ".join(f"WHEN '{m}' THEN {x[3]}" for m, x in MEASURES.items())
    values = " UNION ALL ".join(f"SELECT row_id, lang, source, '{m}' AS measure, {s} * {a} // {b} AS v FROM counts WHERE {b} > 0" for m, (a, b, s, _) in MEASURES.items())

    def quart(keys: str) -> str:
        own = keys + ", " if keys else ""
        of = lambda q: f"min(CASE WHEN upto >= {q} * total THEN bucket END)"
        value = lambda b: f"CASE WHEN {b} < 0 THEN 0.0 ELSE 2 * pow(CAST({p.gamma} AS DOUBLE), {b}) / CAST({1 + p.gamma} AS DOUBLE) END"
        return f"""SELECT {own}measure, max(total) AS n_rows, {value(of("CAST(0.25 AS DOUBLE)"))} AS q25, {value(of("CAST(0.75 AS DOUBLE)"))} AS q75 FROM (
          SELECT *, sum(n) OVER (PARTITION BY {own}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {own}measure) AS total
          FROM (SELECT {own}measure, bucket, sum(n) AS n FROM sketch GROUP BY {own}measure, bucket)) GROUP BY {own}measure"""

    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS row_id, * FROM documents),
    parts AS (SELECT row_id, doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        [l for l in string_split(coalesce(text, ''), chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM docs),
    windows AS (SELECT row_id, i, words[i:i + {WINDOW - 1}] AS w FROM (SELECT row_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM parts)),
    repeated AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w) AS c FROM windows) WHERE c > 1),
    covered AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest(range(i, i + {WINDOW})) AS p FROM repeated) GROUP BY row_id),
    counts AS (SELECT row_id, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
        CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(covered.n, 0) AS n_repeat_words FROM parts LEFT JOIN covered USING (row_id)),
    sketch AS (SELECT lang, source, measure, CASE WHEN v <= 0 THEN -1 ELSE CAST(ceil(ln(CAST(v AS DOUBLE)) / CAST({math.log(p.gamma)!r} AS DOUBLE)) AS INTEGER) END AS bucket, count(*) AS n
        FROM ({union}) GROUP BY ALL),
    own AS ({quart("lang, source")}),
    of_lang AS (SELECT * FROM ({quart("lang")}) WHERE n_rows >= {p.min_rows}),
    of_all AS ({quart("")}),
    picked AS (SELECT own.lang, own.source, own.measure,
        coalesce(CASE WHEN own.n_rows >= {p.min_rows} THEN own.q25 END, of_lang.q25, of_all.q25) AS q25,
        coalesce(CASE WHEN own.n_rows >= {p.min_rows} THEN own.q75 END, of_lang.q75, of_all.q75) AS q75
        FROM own LEFT JOIN of_lang ON own.lang IS NOT DISTINCT FROM of_lang.lang AND own.measure = of_lang.measure JOIN of_all ON own.measure = of_all.measure),
    fences AS (SELECT lang, source, measure, q75 + {p.spread} * (q75 - q25) + CASE measure {slack} END AS hi, q25 - {p.spread} * (q75 - q25) - CASE measure {slack} END AS lo FROM picked),
    outside AS (SELECT DISTINCT row_id FROM ({values}) AS x JOIN fences AS f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source AND x.measure = f.measure
        WHERE x.v > f.hi OR (x.measure = 'word_length' AND x.v < f.lo))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT row_id IN (SELECT row_id FROM outside) AS kept
    FROM (SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed FROM counts)"""
