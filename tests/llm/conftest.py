import pytest

DOCS = "doc_id long, text string, lang string, source string, digest string, id long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text and columns whose names clash."""

    def make(texts):
        rows = [(i, t, ["en", "de", None][i % 3] if i is not None else None, ["a", "b", None][i % 3] if i is not None else None, "x", 7) for i, t in texts]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    line = "the quick brown fox jumps over the lazy dog while it rains in the old town "
    return [
        (1, "Hello big  world again"), (2, "Hello\tbig world\nagain"), (3, None), (4, ""), (5, " \n\t"), (6, "Hello big world again"),
        (6, "Hello big world again"), (None, "Hello big world again"), (None, "alone without a name"), (7, "é漢🙂 ünï"), (8, line * 400), (9, "pre " + line * 4), (10, line * 4 + "post"), (11, "12 34 !"),
        (12, "word"), (13, "two words"),
    ]
