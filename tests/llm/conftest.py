import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators might use."""
    rows = [
        (1, "The quick fox. " * 40, "en", "a", 1), (1, "The quick fox. " * 40, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0),
        (None, "Null id here. " * 5, "fr", "b", 3), (4, " \n\t ", "de", "b", 4), (5, "word " * 30_000, "es", "c", 5), (6, "日本語 éß <|endoftext|> \U0001f600", "ja", "c", 6),
        (7, "one", "en", "a", 7), (8, "one two", "en", "a", 8), (9, "x" * 20_000, "en", "a", 9),
    ]
    data = [(*r, True, 5, "p") for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, start long, part string")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("false")
