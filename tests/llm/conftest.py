import pytest

SCHEMA = "doc_id long, text string, lang string, n_words long, kept string, part int, value string, `range` string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text), with other columns whose names clash with what operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", -1, "x", 7, "v", "r") for i, t in rows], SCHEMA)

    return make


LONG = "alpha beta gamma delta, " * 6000
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two three four five six"), (7, "one two three four five six"),
    (7, "one two three four five six"), (None, "one two three four five six"), (8, "Zebra  zebra\n\nzebra 日本語 <|endoftext|> it's"), (9, LONG), (10, "x" * 9000),
]


@pytest.fixture
def edge():
    return list(EDGE)


@pytest.fixture(scope="session")
def tokenizers_at():
    return pytest.importorskip("public_tokenizers")
