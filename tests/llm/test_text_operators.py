"""Quality, language, rules, token ids, licences: odd inputs, held-out accuracy, round trips."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import language, licences, pieces, quality, registry, rules

MODEL = registry.PIECE_MODEL


@pytest.fixture(scope="module")
def net(documents):
    taught = documents.where(F.col("doc_id") % 3 != 1)
    return language.fit(taught.select(F.col("doc_id").alias("id"), "text", "lang"), language.LanguageParams(steps=200))


def test_language_held_out(documents, net):
    found = language.predict(documents.where(F.col("doc_id") % 3 == 1), net).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd_rows(odd, none, net):
    got = language.predict(odd, net)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert by[4]["lang_pred"] != "und" and by[6]["lang_pred"] == by[7]["lang_pred"]
    assert language.predict(none, net).count() == 0
    untaught = language.fit(none.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r["lang_pred"] for r in language.predict(odd, untaught).collect()} == {"und"}


def test_windows_cover_the_text():
    data = bytes(range(256)) * 3 + b"end"
    grid, sizes = language.windows_of(data, 100)
    assert bytes(grid.reshape(-1)[: len(data)]) == data and sizes.sum() == len(data)


def test_votes_and_accuracies_are_recovered():
    """Labels drawn from known accuracies: the model finds them without seeing the truth."""
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.95, 0.9, 0.85, 0.9])
    votes = np.where(rng.random((20000, 8)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_label_model(patterns, counts.astype(float))
    assert np.allclose(list(model.accuracies().values()), right, atol=0.03) and abs(model.prior - 0.8) < 0.03
    assert (model.posterior(votes) > 0.5).astype(int).tolist().count(1) == pytest.approx(truth.sum(), rel=0.03)


def test_quality_agrees_with_labels(spark, sf, documents):
    model, scorer, _ = quality.fit(documents)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(documents, model, scorer).join(labels, "doc_id").select("quality", "kept").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.9
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert np.mean(good) > 0.95


def test_quality_odd_rows(odd, none):
    model, scorer, _ = quality.fit(odd)
    got = quality.classify(odd, model, scorer)
    assert got.count() == odd.count()
    assert not any(r["kept"] for r in got.where("doc_id in (1, 2, 3)").collect())
    model, scorer, _ = quality.fit(none)
    assert quality.classify(none, model, scorer).count() == 0


def counts_by_hand(text):
    words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_by_hand(spark):
    rng = random.Random(4)
    texts = [None, "", "a b c d e a b c d e a b c d e", "x\nx\n\n \nx"] + [" ".join(rng.choice(["a", "b", "é#", "c\nc", "d", "e"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r[0]: tuple(r[1:6]) for r in rules.apply_rules(docs).collect()}
    assert got == {i: counts_by_hand(t) for i, t in enumerate(texts)}


def test_rules_odd_rows_and_limits(spark, odd, none):
    got = {r["doc_id"]: r for r in rules.apply_rules(odd).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert rules.apply_rules(none).count() == 0
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "s") for i in range(200)]
    junk = [(1000, " ".join(f"w{j}$$$###" for j in range(30)), "en", "s")]
    docs = spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in rules.apply_rules(docs).where("NOT kept").collect()} == {1000}


def test_sketches_merge(documents):
    """The sketch of the whole is the sum of the sketches of its parts."""
    counts = rules.with_counts(documents).cache()
    p = rules.RuleParams()
    whole = rules.sketches(counts, p)
    parts = rules.sketches(counts.where("doc_id % 2 = 0"), p).union(rules.sketches(counts.where("doc_id % 2 = 1"), p))
    merged = parts.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0


def test_ids_equal_the_library(documents):
    from sentencepiece import SentencePieceProcessor

    library, model = SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    rng = random.Random(2)
    bits = ["a", "the", "ing", "é", "ß", "中", "𝄞", "\n", "\t", "▁", "\x00", " ", "  ", " " * 20, "日本", "x" * 9, "Становништво", "ñ", "!"]
    texts = ["", " ", "  a ", "▁", "\n"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    texts += [r["text"] for r in documents.select("text").collect()]
    encoder = pieces.Encoder(model)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert pieces.decoded(model, ids) == text.replace("▁", " ")


def test_ids_round_trip_in_spark(odd, none):
    model = pieces.load(MODEL)
    coded = pieces.encode(odd, model)
    by = {r["doc_id"]: r for r in coded.collect()}
    assert by[1]["ids"] is None and by[1]["n_tokens"] == 0 and by[1]["decodes"] is None
    assert by[2]["ids"] == [] and by[6]["decodes"] and by[6]["ids"] == by[7]["ids"]
    back = pieces.decode(coded.select("doc_id", "ids"), model)
    assert back.exceptAll(odd.select("doc_id", "text")).count() == 0
    assert pieces.encode(none, model).count() == 0


def test_a_worker_holds_a_bounded_number_of_words():
    """Many distinct words leave the memory of an encoder small; words that were forgotten get the same ids again."""
    from sentencepiece import SentencePieceProcessor

    library, encoder = SentencePieceProcessor(model_file=MODEL), pieces.Encoder(pieces.load(MODEL))
    text = lambda n: " ".join(f"n{i * 7919 % 1000003}" for i in range(8000 * n, 8000 * (n + 1)))
    tracemalloc.start()
    try:
        for k in range(5):
            encoder.encode([text(10 * k + j) for j in range(10)])
        assert tracemalloc.get_traced_memory()[1] < 90 << 20  # 112 MB when every word was kept and a megabyte of them encoded at once
    finally:
        tracemalloc.stop()
    assert len(encoder.words) + len(encoder.older) < 300_000  # of 400,000
    for n in (0, 39, 49, 0):  # forgotten, in the older generation, in the newer one, met again
        assert encoder.encode([text(n) + " the"])[0].tolist() == library.encode(text(n) + " the")


def test_texts_are_split_in_parts_of_bounded_size():
    texts = pa.array(["ab", "", None, "x" * 9, "c", "d"])
    assert list(pieces.parts_of(texts, 3, 4)) == [(0, 3), (3, 1), (4, 2)]
    assert list(pieces.parts_of(texts, 2, 100)) == [(0, 2), (2, 2), (4, 2)]
    assert list(pieces.parts_of(texts.slice(0, 0), 3, 4)) == []
    assert list(pieces.parts_of(pa.array([None, None], pa.large_string()), 1, 4)) == [(0, 1), (1, 1)]


def test_licences(spark, odd, none, documents):
    model = licences.fit(documents)
    lines = {
        1: ("plain words\nReleased under the MIT License.\nmore", {"MIT"}),
        2: ("Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", {"Apache-2.0", "CC-BY-NC"}),
        3: ("A driver must carry a valid license at all times.", set()),
        4: ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        5: ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in lines.items()], "doc_id long, text string")
    for r in licences.scan(docs, model).collect():
        assert {x["family"] for x in r["licences"] if x["confirmed"]} == lines[r["doc_id"]][1]
    two = model.scan("Dual licensed under the MIT license or the Apache License, Version 2.0.")[1]
    assert {f for _, f, _, s in two if s >= model.p.min_similarity} == {"MIT", "Apache-2.0"}
    by = {r["doc_id"]: r for r in licences.scan(odd, model).collect()}
    assert by[1]["n_paragraphs"] == 0 and by[3]["n_paragraphs"] == 0 and by[6]["n_paragraphs"] == 1500
    assert licences.scan(none, licences.fit(none)).count() == 0


@pytest.mark.parametrize("share", [0, 0.01, 0.1, 0.4])
def test_frequent_licences_are_found(share):
    """Licence lines of the corpus teach nothing, so no share of them hides a notice."""
    rng = random.Random(3)
    plain = [[f"w{rng.randrange(3000)}".encode() for _ in range(20)] for _ in range(1500)]
    often = licences.tokens_of(b"This project uses the MIT license, see LICENSE.")
    model = licences.LicenceModel(licences.LicenceParams(variants=60, steps=150))
    model.fit([often if rng.random() < share else w for w in plain])
    for line, family in (
        ("Released under the MIT License.", "MIT"),
        ("Licensed under the MIT license.", "MIT"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"),
        ("All rights reserved.", "proprietary"),
        ("Use of this source code is governed by a BSD-style license.", "BSD"),
    ):
        assert [(f, s) for _, f, _, s in model.scan("some words\n" + line)[1]] == [(family, 1.0)], line
    assert [f for _, f, _, _ in model.scan("This project uses the MIT license, see LICENSE.")[1]] == ["MIT"]
