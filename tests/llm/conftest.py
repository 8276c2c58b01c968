import pytest

#: doc_id, text, and an extra column whose name an operator might use itself.
AWKWARD = [
    (1, "One two three four five six.\nOne two three four five six.", "a"),
    (2, None, "b"),
    (3, "", None),
    (4, " \t\n\x0b\f\r ", "c"),
    (5, "word", "d"),
    (5, "word", "d"),
    (None, "a b a b a b a b", "e"),
    (7, "naïve café — 漢字 😀 " * 40, "f"),
    (8, "x" * 30000, "g"),
    (9, "tok " * 9000, "h"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, n_words string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_words string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
