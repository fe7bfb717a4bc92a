import pytest

TEXTS = [
    None, "", " ", "\n", "a", "one two three four", "one two three four five", "x  \n y", "é ñ 日本 it's 123 ,,", "word " * 3000, "one two three four five", "a<b>&amp;",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and a clashing extra column."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None, i) for i, t in enumerate(TEXTS)] + [(None, "no id here", "en", "src1", 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
