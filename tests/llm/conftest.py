import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, key string, cid long"

#: Null, empty, blank, punctuation only, repeated rows, a null id, ties and a very long text.
ODD = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "?! 42", "en", "b", 5), (5, "one two three four five six", "en", None, 27),
       (5, "one two three four five six", "en", None, 27), (6, "one two three four five six", "en", "b", 27), (None, "eins zwei drei", "de", "b", 14),
       (8, "word " * 4000, "en", "c", 20000), (9, "Ünïcode naïve 東京 " * 30, "fr", "c", 540)]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with odd values, and extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 7) for r in ODD], FIELDS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
