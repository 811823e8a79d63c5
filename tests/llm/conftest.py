
import pytest


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label int, size int, block string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    words = [f"w{(i * i) % 911}x{i % 37}" for i in range(4000)]
    long = " ".join(words)
    near = " ".join(words[:60] + ["other"] + words[61:300])
    rows = [
        (1, long, "en", "a", len(long), 1, 2, "x", 0.5),
        (1, long, "en", "a", len(long), 1, 2, "x", 0.5),
        (2, " ".join(words[:300]), "en", "a", None, None, None, None, None),
        (3, near, "en", None, 9, 0, 0, "", 0.0),
        (4, None, None, None, None, None, None, None, None),
        (5, "", "de", "b", 0, 0, 0, "b", 1.0),
        (6, " \t\n\r\x0b\x0c ", "de", "b", 7, 0, 0, "b", 1.0),
        (7, "one", "de", "b", 3, 0, 0, "b", 1.0),
        (8, "One", "de", "b", 3, 0, 0, "b", 1.0),
        (None, "one two", "de", "b", 7, 0, 0, "b", 1.0),
        (9, "é ü ß x \U0001f600 one", "fr", "c", 10, 0, 0, "b", 1.0),
        (10, "idiot scum " * 40, "fr", "c", 10, 0, 0, "b", 1.0),
        (11, "x" * 70_000, "fr", "c", 10, 0, 0, "b", 1.0),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
