import pytest

from opsweave.llm.common import load

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id int, v string, taken int, _nr int, size string"


@pytest.fixture(scope="session")
def docs(spark):
    return load(spark, SF, "documents")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with null columns and columns whose names clash with those that operators use."""

    def make(rows):
        full = [(i, t, s, None, None, 1, "x", 7, 9, "y") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a null id and source, repeated rows, ties, a very long text."""
    long = " ".join(f"w{i}" for i in range(30_000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (5, "one two", "b"),
        (6, "one two", None), (7, long, "a"), (8, long + " end", "c"), (None, "no id here at all", "c"),
    ]
