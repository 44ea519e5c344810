import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names an operator might use itself."""

    def build(rows):
        rows = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 1, "x", 2) for r in rows]
        return spark.createDataFrame(rows, DOCS + ", size int, _id string, fp int")

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "word and Another " * 40_000
    return make([
        (1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, " \t\n\r\x0b\x0c "), (None, "a b c d"), (None, None),
        (6, long, "t"), (7, long + "end", "t"), (8, "ab cd", None), (9, "a b c d ", None), (10, " é\U0001f600 ß", "t"), (11, "x" * 200_000, "t"),
    ])
