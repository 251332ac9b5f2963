import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) pairs."""
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)

    return make


#: Nulls, empty and blank texts, a very long one, ties, repeated rows, odd characters.
EDGE = [
    (1, None), (2, ""), (3, "   \n "), (4, "word"), (5, "one two three four five six"), (5, "one two three four five six"), (None, "no id at all here"),
    (6, "é İ ß 世界 🙂 é! <|endoftext|>"), (7, "long text " * 30_000), (8, "one two three four five six"), (9, "tab\tand\r\nline\x00feed"),
]


@pytest.fixture
def edge(make_docs):
    return make_docs(EDGE)
