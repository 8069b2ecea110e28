import pytest


@pytest.fixture(scope="session")
def tiny(spark):
    """doc_id, text and columns whose names clash with working columns."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            df = df.selectExpr("doc_id", "text", "'x' AS _rh", "1 AS node", "2 AS row", "'en' AS lang", "cast(length(text) AS bigint) AS n_chars")
        return df

    return make


ODD = [
    (1, None), (2, ""), (3, "short"), (3, "short"), (None, "no id here at all, none"), (None, None), (4, "x" * 300_000),
    (5, "The same line here\nand another"), (6, "The same line here\nand another"), (7, "é ü 中文 \x1e\x00 𝄞 " * 40),
]


@pytest.fixture
def odd(tiny):
    return tiny(ODD)
