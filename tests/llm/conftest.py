import pytest

LONG = "long words here " * 20000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, "the cat sat on the mat", "en", "a"),
        (2, "The  cat\tsat on the mat", "en", "a"),
        (3, None, None, None),
        (4, "", "fr", "b"),
        (5, " \n ", "fr", None),
        (6, LONG, "en", "a"),
        (7, LONG + "end", "en", "b"),
        (8, "the cat sat on the mat", "en", "a"),
        (8, "the cat sat on the mat", "en", "a"),
        (None, "no id at all", "en", "c"),
        (9, "un deux trois été", "fr", "c"),
        (10, "1234 !!", None, "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return docs.selectExpr(
        "*", "1 AS n_chars", "'x' AS h", "2 AS row", "3 AS fp", "4 AS size", "5 AS score", "6 AS kept", "7 AS u", "8 AS component_id"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
