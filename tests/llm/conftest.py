import pytest

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000
NEAR = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    near = " ".join(NEAR)
    rows = [
        (1, None, None, None, None, 7, "x"), (2, "", "en", "a", 0, 7, "x"), (3, LONG, "en", "a", 1, 7, "x"), (4, " \t\n", "en", None, 1, 7, "x"),
        (5, near, "en", "b", 1, 7, "x"), (5, near, "en", "b", 1, 7, "x"), (6, near + " extra", "en", "b", 1, 7, "x"), (7, near, None, "b", 1, 7, "x"),
        (None, near, "en", "b", 1, 7, "x"), (8, "one two", "en", "b", 1, 7, "x"), (9, "one two", "fr", "c", 1, 7, "x"), (10, "The MIT License, and (MIT license)", "en", "c", 1, 7, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, word string")
