"""Divergence of sources: how far the term shares of the sources of a language lie apart.

For two sources the divergence is a sum over all kept terms of a price that depends only on the two counts of
a term.  So it is enough to know, for every pair of counts, how many terms have them: the joint table of the
two sources.  A block of terms is written as a one-hot matrix with a column for every (source, count) that
occurs, the count 0 included; this matrix transposed times itself holds the block's share of the joint
tables of all its pairs of sources at once.  Entries are 0 or 1 and a block has fewer than 2^24 terms, so the
products are exact in single precision.  The shares are added up by Spark, and each cell is priced once, in
whole numbers.

A block holds a bounded number of terms and of sources: terms are dealt by their hash, sources by their
number, and a product of two different blocks of sources gives the pairs across them.  Inside a block the
terms go a few hundred at a time and the columns tile by tile.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.runtime import discard, materialise

LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


@dataclass(frozen=True)
class DivergenceParams:
    """``block_terms`` and ``block_sources`` bound a block; ``tile_columns`` bounds a product held at once.
    ``held_terms`` bounds the counts that a task gathers before it hands them on."""

    min_docs: int = 10
    top_terms: int = 10
    smoothing: int = 2
    scale: int = 1_000_000_000
    block_terms: int = 4096
    block_sources: int = 32
    step_terms: int = 512
    tile_columns: int = 1024
    held_terms: int = 500_000


def count_terms(held_terms: int):
    """The task that counts terms: ``(lang, source, text)`` batches in, partial counts out.

    ``n`` are a term's occurrences, ``docs`` the texts that have it.  A group shows up with the empty
    term at least, which no text has, so that groups without terms are kept.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns)):
                n, docs = counts.setdefault((lang, source), (Counter({b"": 0}), Counter({b"": 0})))
                words = text.translate(LETTERS).split()
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > held_terms:
                yield from term_batches(counts)
                counts = {}
        yield from term_batches(counts)

    return job


def term_batches(counts: dict) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for (lang, source), (n, docs) in counts.items():
        fixed = [pa.array([v] * len(n), pa.binary()).cast(pa.string()) for v in (lang, source)]
        numbers = [pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
        yield pa.RecordBatch.from_arrays([*fixed, pa.array(n, pa.binary()).cast(pa.string()), *numbers], names)


def level_products(p: DivergenceParams):
    """The function of one block: the counts ``(lang, sources, left, right, term, source_no, n)`` of its terms to
    cells ``(lang, a, a_count, b, b_count, terms)`` of the joint tables of its pairs of sources, a < b.

    Sources without a row have the count 0.  The cell of two zeros is left out: it is what the kept
    terms have beyond the other cells.
    """

    def job(rows: pa.Table) -> pa.Table:
        lang, sources, left, right = (rows.column(c)[0].as_py() for c in ("lang", "sources", "left", "right"))
        numbers = [np.arange(b * p.block_sources, min((b + 1) * p.block_sources, sources)) for b in sorted({left, right})]
        numbers = np.concatenate(numbers)
        term = rows.column("term").combine_chunks().dictionary_encode()
        grid = np.zeros((len(term.dictionary), len(numbers)), np.int64)
        grid[term.indices.to_numpy(), np.searchsorted(numbers, rows.column("source_no").to_numpy())] = rows.column("n").to_numpy()
        levels = [np.unique(grid[:, j], return_inverse=True) for j in range(len(numbers))]
        starts = np.cumsum([0, *(len(values) for values, _ in levels)])
        column = np.stack([start + level for start, (_, level) in zip(starts, levels)], axis=1)
        source, count = np.repeat(numbers, np.diff(starts)), np.concatenate([values for values, _ in levels])
        cells, terms = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start in range(0, len(grid), p.step_terms):
            for x, y, n in one_hot_product(column[start : start + p.step_terms], source, count, left, right, p):
                cells.append(x * len(source) + y)
                terms.append(n)
        cell, of = np.unique(np.concatenate(cells), return_inverse=True)
        x, y = np.divmod(cell, max(len(source), 1))
        total = np.zeros(len(cell), np.int64)
        np.add.at(total, of, np.concatenate(terms))
        lang = pa.array([lang] * len(cell), pa.string())
        return pa.table({"lang": lang, "a": source[x], "a_count": count[x], "b": source[y], "b_count": count[y], "terms": total})

    return job


def one_hot_product(column: np.ndarray, source: np.ndarray, count: np.ndarray, left: int, right: int, p: DivergenceParams) -> Iterator[tuple]:
    """Non-zero cells ``(column, column, terms)`` of the one-hot matrix of a few terms transposed times itself.

    ``column`` holds a term's column for each source; only columns that occur are multiplied.
    """
    used, place = np.unique(column, return_inverse=True)
    hot = np.zeros((len(column), len(used)), np.float32)
    np.put_along_axis(hot, place.reshape(column.shape), 1, axis=1)
    block = source[used] // p.block_sources
    rows, cols = np.flatnonzero(block == left), np.flatnonzero(block == right)
    for i in range(0, len(rows), p.tile_columns):
        for j in range(0, len(cols), p.tile_columns):
            r, c = rows[i : i + p.tile_columns], cols[j : j + p.tile_columns]
            x, y = used[r][:, None], used[c][None, :]
            product = hot[:, r].T @ hot[:, c]
            product[(source[x] >= source[y]) | (count[x] == 0) & (count[y] == 0)] = 0
            at = np.nonzero(product)
            yield used[r][at[0]], used[c][at[1]], product[at].astype(np.int64)


def share(count: str, total: str, terms: str, p: DivergenceParams) -> Column:
    """``1 + floor(scale * (count + smoothing) / (total + smoothing * terms))`` in whole numbers, exact at any size;
    null without terms."""
    above = f"cast({p.scale} as decimal(18,0)) * cast({count} + {p.smoothing} as decimal(20,0))"
    return F.expr(f"1 + cast({above} div cast(nullif({total} + {p.smoothing} * {terms}, 0) as decimal(20,0)) as bigint)")


def price(a: str, b: str) -> Column:
    """The price of two shares; squares stay below 2^62 for shares up to 2^31."""
    return F.expr(f"(({a} - {b}) * ({a} - {b})) div ({a} + {b})")


def audit(docs: DataFrame, p: DivergenceParams = DivergenceParams(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every source against the others of its language.

    Null text, language and source are the empty string, and an empty string is a group like others.  Terms
    are runs of ASCII letters and characters beyond ASCII, A-Z in lower case; a language keeps the terms in
    ``min_docs`` or more of its rows (repeated rows count each).  Part ``pair``: each other source with its
    divergence.  Part ``term``: the kept terms that the source has more of than its language, the
    ``top_terms`` of largest price.  Ranks by value falling, then item rising in UTF-8; values are whole
    numbers.  Groups without terms take part; a language without kept terms has divergences 0.  An empty
    table gives no rows; other columns are ignored.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    partial = read.mapInArrow(count_terms(p.held_terms), "lang string, source string, term string, n bigint, docs bigint")
    counts = materialise(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= p.min_docs)
    kept = materialise(kept.select("lang", "term", "lang_n"), "kept-terms")
    cells = materialise(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")

    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term = ''").select("lang", "source", number.cast("long").alias("source_no"))
    counted = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(of_lang, "lang", "left")
    groups = groups.join(of_group, ["lang", "source"], "left").join(counted, "lang").na.fill(0, ["total", "terms", "lang_total"])
    groups = materialise(groups, "groups")
    discard(counts)
    discard(kept)

    counted = cells.join(groups, ["lang", "source"])
    result = materialise(pair_rows(joint_tables(counted, p), groups, p).union(term_rows(counted, p)), "divergences")
    discard(cells)
    discard(groups)
    return result


def joint_tables(counted: DataFrame, p: DivergenceParams) -> DataFrame:
    """``(lang, a, a_count, b, b_count, terms)``: for two sources a < b of a language, how many kept terms have
    each pair of counts; without the pair of zeros."""
    deal = F.pmod(F.xxhash64("term"), F.greatest(F.lit(1), F.ceil(F.col("terms") / p.block_terms)))
    own, last = F.col("source_no").cast("long") / p.block_sources, (F.col("sources") - 1) / p.block_sources
    other = F.sequence(F.lit(0).cast("long"), F.floor(last))
    dealt = counted.select("lang", "sources", "term", "source_no", "n", deal.alias("block"), F.floor(own).alias("own"), F.explode(other).alias("other"))
    dealt = dealt.select("lang", "sources", "term", "source_no", "n", "block", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
    products = dealt.groupBy("lang", "block", "left", "right").applyInArrow(level_products(p), "lang string, a bigint, a_count bigint, b bigint, b_count bigint, terms bigint")
    return products.groupBy("lang", "a", "a_count", "b", "b_count").agg(F.sum("terms").alias("terms"))


def pair_rows(joint: DataFrame, groups: DataFrame, p: DivergenceParams) -> DataFrame:
    """Part ``pair``: the cells of each joint table priced and added up, in both directions."""

    def side(s: str) -> DataFrame:
        names = {"source": f"{s}_source", "source_no": s, "total": f"{s}_total"}
        return groups.select("lang", *[F.col(c).alias(n) for c, n in names.items()], *(["terms"] if s == "a" else []))

    # the result has a row for every two sources of a language, so this join is no larger than the result
    pairs = side("a").join(side("b"), "lang").where("a < b").withColumnRenamed("terms", "kept")
    priced = pairs.join(joint, ["lang", "a", "b"], "left").select(
        "lang", "a_source", "b_source", "a_total", "b_total", "kept", "terms",
        share("a_count", "a_total", "kept", p).alias("x"), share("b_count", "b_total", "kept", p).alias("y"),
    )
    sums = priced.groupBy("lang", "a_source", "b_source", "a_total", "b_total", "kept").agg(
        F.coalesce(F.sum(F.col("terms") * price("x", "y")), F.lit(0)).alias("value"), F.coalesce(F.sum("terms"), F.lit(0)).alias("seen")
    )
    zero = sums.withColumns({"x": share("0L", "a_total", "kept", p), "y": share("0L", "b_total", "kept", p)})
    value = F.when(F.col("kept") > 0, F.col("value") + (F.col("kept") - F.col("seen")) * price("x", "y")).otherwise(F.lit(0).cast("long"))
    ways = [F.struct(F.col(f"{s}_source").alias("source"), F.col(f"{o}_source").alias("item")) for s, o in ("ab", "ba")]
    both = zero.select("lang", F.explode(F.array(*ways)).alias("way"), value.alias("value"))
    return ranked(both.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value"))


def term_rows(counted: DataFrame, p: DivergenceParams) -> DataFrame:
    """Part ``term``: the terms that a source has more of than its language."""
    shares = counted.where("n > 0").select("lang", "source", "term", share("n", "total", "terms", p).alias("x"), share("lang_n", "lang_total", "terms", p).alias("y"))
    more = shares.where("x > y").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price("x", "y").alias("value"))
    return ranked(more).where(F.col("rank") <= p.top_terms)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit_sql(p: DivergenceParams = DivergenceParams()) -> str:
    """The same rows by the definition, term by term, for DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = f"1 + ({p.scale}::HUGEINT * ({{}} + {p.smoothing})) // ({{}} + {p.smoothing} * {{}})"
    price = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
    k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {p.min_docs}),
    l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    full_grid AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    totals AS (SELECT lang, source, sum(n) AS total FROM full_grid GROUP BY ALL),
    s AS (SELECT f.*, {share.format("f.n", "totals.total", "l.v")} AS p, {share.format("f.lang_n", "l.lang_total", "l.v")} AS q
        FROM full_grid f JOIN totals USING (lang, source) JOIN l USING (lang)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum({price.format("a.p", "b.p")}) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, {price.format("p", "q")} AS value FROM s WHERE n > 0 AND p > q),
    every AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM every WHERE part = 'pair' OR rank <= {p.top_terms}"""


cloudpickle.register_pickle_by_value(sys.modules[__name__])
