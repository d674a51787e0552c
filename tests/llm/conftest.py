import pytest


@pytest.fixture
def odd(spark):
    """Rows with nulls, blanks, repeats, ties, a very long text and clashing extra columns."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(60_000))
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (3, "", "de", "s"), (4, " \t\n\x0b\x0c\r ", "fr", ""), (5, long, "en", "s"), (6, long, "en", "s"), (7, "é ü 12 \\ 'x'", "de", "t"), (None, "no id at all", "en", "s"), (8, "a", "en", "s")]
    return spark.createDataFrame([(*r, 5, "x", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, anchor string, size int")
