import pytest
from pyspark.sql import functions as F

from topicloom.functions import text, urls
from topicloom.functions.topics import condense
from topicloom.functions.wordlists import COMMON_NAMES, DOMAIN_WORDS, STATE_ABBREVIATIONS, default_stop_words
from topicloom.operators import tokens


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_normalise_replaces_in_order(spark):
    assert one(spark, "Don't", text.normalize) == "do "
    assert one(spark, "Court's", text.normalize) == "court s"
    assert one(spark, "a    b c", text.normalize) == "a b c"
    assert one(spark, "I'm we'll\r\n\tx", text.normalize) == "i  we    x"
    assert one(spark, "Élan 12", text.normalize) == " lan   "
    assert one(spark, None, text.normalize) == ""


def test_words_of_nothing(spark):
    for value in (None, "", " 12 "):
        assert one(spark, value, text.words) == []


# Worked out by hand: what each text becomes.
BY_HAND = {
    "Don't stop; we'll  see it.": "do  stop  we   see it ",
    "naïve café's  I'm": "na ve caf  s  i ",
    "x\ty\nz": "x y z",
    "n't'm'll 'n't": "      ",
}


def test_normalised_by_hand(spark):
    for sample, wanted in BY_HAND.items():
        assert one(spark, sample, text.normalize) == wanted
        assert one(spark, sample, text.words) == wanted.split()


def scanned(sample):
    """One walk over the characters: a mark that starts here is skipped as a whole, any other sign leaves a blank."""
    sample, at, out = sample.lower(), 0, []
    while at < len(sample):
        mark = next((m for m in ("\xa0" * 4, "n't", "'ll", "'m") if sample.startswith(m, at)), sample[at])
        out.append(mark if len(mark) == 1 and "a" <= mark <= "z" else " ")
        at += len(mark)
    return "".join(out)


def test_random_texts_equal_python(spark):
    import random

    random.seed(11)
    parts = ["n't", "'m", "'ll", "\xa0", "\xa0\xa0\xa0\xa0", "\r\n", "\t", " ", "A", "b", "n", "t", "'", "é", "Ñ", "ß", "1", "-", "😀", "l", "m"]
    samples = ["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(3000)]
    rows = spark.createDataFrame([(s,) for s in samples], "v string").select("v", text.normalize("v"), text.words("v"), text.clean_tokens("v", ["bb", "nt"]))
    for sample, normal, words, kept in rows.collect():
        wanted = scanned(sample)
        assert normal == wanted, repr(sample)
        assert words == wanted.split()
        assert kept == [w for w in wanted.split() if len(w) > 1 and w not in ("bb", "nt")]


def test_stop_filters(spark):
    frame = spark.createDataFrame([(["a", "of", "", "law", "be"],)], "t array<string>")
    row = frame.select(text.drop_stop_words("t", ["of"]), text.drop_stop_words_study("t", ["of"]), text.drop_stop_words("t", [])).first()
    assert row[0] == ["law", "be"] and row[1] == ["", "law", "be"] and row[2] == ["of", "law", "be"]


def test_word_lists(spark):
    assert len(DOMAIN_WORDS) == len(set(DOMAIN_WORDS)) == 60
    assert len(COMMON_NAMES) == 16 and len(STATE_ABBREVIATIONS) == 50
    assert {"the", "certiorari", "mary", "wy", "extra"} <= set(default_stop_words(("extra",)))


def test_ellipsis(spark):
    assert one(spark, "x" * 101, lambda c: text.ellipsis(c, 100)) == "x" * 100 + "..."
    assert one(spark, "x" * 100, lambda c: text.ellipsis(c, 100)) == "x" * 100
    assert one(spark, "xy", lambda c: text.ellipsis(c, 80, always=True)) == "xy..."


def test_vectoriser_tokens(spark):
    assert one(spark, "Ab a été x1", text.vectoriser_tokens) == ["ab", "été", "x1"]


def test_years(spark):
    cases = {
        "http://h/1899/x.html": 1899, "http://h/x-1899-x": 1899, "http://h/0123/": 123, "http://h/1699": None,
        "http://h/2030": None, "http://h/none": None, "http://h/9999/1901": 9999, "http://h/12345": None,
    }
    for url, year in cases.items():
        assert one(spark, url, urls.year_from_url) == year, url
    assert one(spark, "http://h/9999/", lambda c: urls.year_from_url(c, 1760, 2018)) is None


def test_year_of_case_id_fails_on_bad_text(spark):
    import pytest

    assert one(spark, "1946-001", urls.year_from_case_id) == 1946
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "x-1", urls.year_from_case_id)


def test_dockets(spark):
    cases = {
        "/us/1/22.html": ("22", "22"), "/us/541/22-100.html/": ("22-100", ""), "/a/no-name": ("-", ""),
        "/a/none": ("", ""), "/a/12?x=3": ("123", "123"), "/a/1.html.html//": ("1", ""),
    }
    for url, (pipeline, study) in cases.items():
        assert (one(spark, url, urls.docket), one(spark, url, urls.docket_digits)) == (pipeline, study), url


def test_condense(spark):
    merged = spark.range(30).select(condense(F.col("id").cast("int")).alias("t"))
    assert merged.distinct().count() == 19
    assert {r[0] for r in merged.distinct().collect()}.isdisjoint({20, 25, 2, 27, 18, 5, 8, 22, 15, 9, 19})


def test_lemmatise_keeps_order_and_unknown_tokens(spark):
    docs = spark.createDataFrame([(1, "x", ["ran", "the", "ran", "fast"]), (2, "y", []), (3, "z", ["gone"])], "doc_id long, other string, tokens array<string>")
    book = spark.createDataFrame([("ran", " run "), ("gone", " ")], "form string, lemma string")
    got = {r["doc_id"]: r for r in tokens.lemmatise(docs, book).collect()}
    assert got[1]["tokens"] == ["run", "the", "run", "fast"] and got[1]["other"] == "x"
    assert got[2]["tokens"] == [] and got[3]["tokens"] == []


@pytest.mark.parametrize("part_words", [100, 1])
def test_lemmas_are_looked_up_inside_the_row(spark, part_words):
    """Rows of one key keep their own tokens, a base form is not replaced again, and no token moves."""
    rows = [(1, ["a", "b"]), (1, ["c", "d", "x"]), (None, ["b", None, " b "]), (2, None), (3, [])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    book = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "z"), ("c", None), (None, "n"), ("d", ""), ("unused", "u")], "form string, lemma string")
    found = tokens.lemmatise(docs, book, part_words=part_words)
    got = sorted(((r["doc_id"], r["tokens"]) for r in found.collect()), key=str)
    assert got == sorted([(1, ["b", "c"]), (1, ["c", "x"]), (None, ["c", "b"]), (2, []), (3, [])], key=str)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_stop_table_joined_and_inlined_agree(spark):
    docs = spark.createDataFrame([(1, ["b", "law", "of", "law"]), (2, ["of"]), (3, [])], "doc_id long, tokens array<string>")
    listed = spark.createDataFrame([("of",), ("of",), ("x",)], "word string")
    for bound, part in ((0, 10), (0, 1), (100, 10)):
        got = {r[0]: r[1] for r in tokens.filter_by_stop_table(docs, listed, literal_words=bound, part_words=part).collect()}
        assert got == {1: ["law", "law"], 2: [], 3: []}
