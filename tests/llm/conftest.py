import pytest

DOCS = "doc_id long, text string, lang string, n_tokens long, `TEXT` string, score string"
LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, clashing names."""
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "12 34 !!", "xx"), (5, LONG, "en"), (6, "same text here", "en"),
            (6, "same text here", "en"), (7, "one id", None), (7, "two texts", None), (None, "no id at all", "en"),
            (8, "Größe ÇA ½ 中文 İstanbul ΑΣ", "de"), (9, "a\nb\n\na\n a", "en")]
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame([(i, t, lang, 1, "other", "x") for i, t, lang in rows], DOCS)
    yield df
    spark.conf.set("spark.sql.caseSensitive", "false")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
