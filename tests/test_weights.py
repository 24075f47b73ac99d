import math

import pytest
from pyspark.sql import functions as F

from topicloom.operators import weights
from topicloom.runtime import number_rows

DOCS = [(1, ["tax", "tax", "law"]), (2, ["law", "war"]), (3, ["law"]), (4, [])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")


def test_counts_and_stats(docs):
    assert {tuple(r) for r in weights.term_counts(docs).collect()} == {(1, "tax", 2), (1, "law", 1), (2, "law", 1), (2, "war", 1), (3, "law", 1)}
    assert {tuple(r) for r in weights.term_stats(docs).collect()} == {("tax", 1, 2), ("law", 3, 3), ("war", 1, 1)}


def test_document_frequency_bounds_are_kept(docs):
    stats = weights.term_stats(docs)
    assert {r[0] for r in weights.prune_by_df(stats, 4, 1, 0.75).collect()} == {"tax", "law", "war"}
    assert {r[0] for r in weights.prune_by_df(stats, 4, 1, 0.74).collect()} == {"tax", "war"}
    assert {r[0] for r in weights.prune_by_df(stats, 4, 2, 1.0).collect()} == {"law"}


def test_cap_breaks_ties_by_term(docs):
    assert [r[0] for r in weights.cap_features(weights.term_stats(docs), 2).collect()] == ["law", "tax"]


def expected():
    idf = {"law": math.log(5 / 4) + 1, "tax": math.log(5 / 2) + 1, "war": math.log(5 / 2) + 1}
    rows = {}
    for doc, words in DOCS:
        raw = {w: words.count(w) * idf[w] for w in words}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        rows.update({(doc, w): x / norm for w, x in raw.items()})
    return rows


@pytest.mark.parametrize("local_terms", [10, 0])
@pytest.mark.parametrize("cap", [None, 10])
def test_weights_in_both_forms(docs, local_terms, cap):
    fit = weights.fit_weights(docs, weights.WeightParams(1.0, 1, cap, (), local_terms))
    assert fit.n_docs == 4 and fit.n_terms == 3
    names = {r.term_id: r.term for r in fit.vocabulary.collect()}
    assert names == {0: "law", 1: "tax", 2: "war"}
    got = {(r.doc_id, names[r.term_id]): r.weight for r in fit.weighted(docs).collect()}
    assert got == pytest.approx(expected())
    matrix = {r.doc_id: dict(zip((names[t] for t in r.term_ids), r.weights)) for r in fit.matrix(docs).collect()}
    assert set(matrix) == {1, 2, 3, 4} and matrix[4] == {}
    assert {(d, w): x for d, row in matrix.items() for w, x in row.items()} == pytest.approx(expected())


def test_small_vocabulary_lowers_min_df(docs):
    assert weights.fit_weights(docs, weights.WeightParams(max_df=1.0)).n_terms == 3


def test_fallback_and_empty_corpus(spark, docs):
    fit = weights.fit_weights(docs, weights.WeightParams(0.5, 50, 5000, ("tax",)))
    assert {r.term for r in fit.vocabulary.collect()} == {"law", "tax", "war"}
    with pytest.raises(ValueError, match="no terms remain"):
        weights.fit_weights(docs.where("doc_id = 4"), weights.WeightParams())


def test_unseen_terms_are_ignored(spark, docs):
    fit = weights.fit_weights(docs, weights.WeightParams(1.0, 1, None))
    other = spark.createDataFrame([(9, ["war", "new"]), (10, ["new"])], "doc_id long, tokens array<string>")
    assert [(r.doc_id, r.term_id, r.weight) for r in fit.weighted(other).collect()] == [(9, 2, 1.0)]


def test_save_and_load(spark, docs, tmp_path):
    fit = weights.fit_weights(docs, weights.WeightParams(1.0, 1, None))
    fit.save(str(tmp_path / "weights"))
    back = weights.TermWeights.load(spark, str(tmp_path / "weights"))
    assert back.n_docs == 4 and {tuple(r) for r in back.weighted(docs).collect()} == {tuple(r) for r in fit.weighted(docs).collect()}


def test_rows_are_numbered_across_partitions(spark):
    keys = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = number_rows(keys, "k").collect()
    assert sorted(got) == [(i, i) for i in range(1000)]


def test_a_third_of_all_words_being_one_word(spark):
    """One hot term and one huge document: counts stay whole in both forms."""
    big = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.array_repeat(F.lit("hot"), 50_000).alias("tokens"))
    small = spark.range(1, 2001).select(F.col("id").alias("doc_id"), F.array(F.lit("hot"), F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("tokens"))
    docs = big.union(small)
    stats = {r.term: (r.df, r.total) for r in weights.term_stats(docs).collect()}
    assert stats["hot"] == (2001, 52_000) and stats["t7"] == (40, 40)
    forms = []
    for local_terms in (1000, 0):
        fit = weights.fit_weights(docs, weights.WeightParams(1.0, 1, None, (), local_terms))
        forms.append({(r[0], r[1]): round(r[2], 9) for r in fit.weighted(docs).collect()})
    assert forms[0] == forms[1] and len(forms[0]) == 4001


@pytest.mark.parametrize("cap", [1, 5, 57, 300, 599, 600, 601, 5000])
def test_a_large_cap_is_counted(spark, monkeypatch, cap):
    """The same terms as a sort gives, with many ties and wide counts, and no step in a single task."""
    totals = [1] * 200 + [2] * 150 + [3] * 100 + [i * i for i in range(2, 152)]
    rows = [(f"t{(i * 7919) % 600:04d}", 1, n) for i, n in enumerate(totals)]
    stats = spark.createDataFrame(rows, "term string, df long, total long")
    wanted = {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:cap]}
    monkeypatch.setattr(weights, "SORTABLE_TERMS", 0)
    kept = weights.cap_features(stats, cap)
    assert {r.term for r in kept.collect()} == wanted and kept.count() == len(wanted)
    assert "TakeOrdered" not in kept._jdf.queryExecution().executedPlan().toString()
    assert weights.cap_features(stats.limit(0), cap).count() == 0


def test_hot_terms_are_cut_into_parts(spark, monkeypatch):
    """No (term, part) has more than about the stated number of rows, and the weights stay the same."""
    docs = spark.range(4000).select("id", F.expr("array('everywhere', concat('rare', id % 500), 'everywhere')").alias("tokens"))
    params = weights.WeightParams(1.0, 1, None, (), 0)
    fit = weights.fit_weights(docs, params, "id")
    whole = fit.weighted_by_join(docs, "id").collect()
    monkeypatch.setattr(weights, "PART_ROWS", 200)
    parts = fit.weighted_by_join(docs, "id")
    assert {(r[0], r[1]): r[2] for r in parts.collect()} == pytest.approx({(r[0], r[1]): r[2] for r in whole})
    frequent = weights.hot_parts(weights.term_counts(docs, "id"), fit.vocabulary, "id")
    sizes = {(r.term, r._part): r["count"] for r in frequent.groupBy("term", "_part").count().collect()}
    assert max(sizes.values()) < 300 and len([k for k in sizes if k[0] == "everywhere"]) == 20


def test_saved_weights_know_their_settings(docs, spark, tmp_path):
    fit = weights.fit_weights(docs, weights.WeightParams(0.9, 1, 7, ("war",), 5))
    fit.save(str(tmp_path / "w"))
    back = weights.TermWeights.load(spark, str(tmp_path / "w"))
    assert back.params == fit.params and back.n_docs == 4 and sorted(back.vocabulary.collect()) == sorted(fit.vocabulary.collect())
