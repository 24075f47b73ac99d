import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, label string, drop int, h long, n long, words int"


def rows(pairs):
    """Documents with further columns whose names the operators use themselves."""
    return [(i, t, "en", "s", len(t or ""), 0.5, "k", "l", 1, 2, 3, 4) for i, t in pairs]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, short, repeated and very long texts, and a null id."""
    long_text = "\n".join(" ".join(f"w{(i * 7 + j) % 5003}x" for j in range(40)) for i in range(1500))
    pairs = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same words here again and again in a line"), (5, "same words here again and again in a line"), (None, "text without an id, long enough to count"), (6, long_text), (7, long_text), (8, "12 34 --")]
    return spark.createDataFrame(rows(pairs), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
