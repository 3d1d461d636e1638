import pytest

#: Texts that every operator must bear: null, empty, blank, ties, repeated rows, long, outside ASCII.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, None, None, 5),
    (2, "", "a", 5),
    (3, " \t\n ", "a", 5),
    (4, "one", "b", 5),
    (5, "The same text stands here twice, word for word, and it is long enough for a few shingles.", "b", 5),
    (6, "The same text stands here twice, word for word, and it is long enough for a few shingles.", "c", 5),
    (6, "The same text stands here twice, word for word, and it is long enough for a few shingles.", "c", 5),
    (7, LONG, "c", 5),
    (8, "Ünïcödé straße 東京 — <|im_end|> \\ \U0001f600 token = 'abcdef123456'", None, 5),
    (None, "a row without an id", "a", 5),
]
SCHEMA = "doc_id long, text string, source string, n_words long"


@pytest.fixture(scope="session")
def docs(spark):
    """Hard rows, with a column whose name clashes with what operators add."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
