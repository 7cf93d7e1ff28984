import pytest

from tidewatch.llm.common import session


@pytest.fixture(autouse=True)
def _settings(spark):
    session(spark)


@pytest.fixture
def make_docs(spark):
    """Documents with columns that clash with names used inside the operators."""
    def build(rows):
        full = [(i, t, "en", "s", None, "x", 1, [0]) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, leaks string, base long, ids array<int>")

    return build


#: texts every operator must stand: null, empty, white space, no letters, one word, very long, emoji, repeated lines
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "12 34 !?"), (5, "word"), (6, "ab " * 40_000), (7, "x" * 100_000), (8, "a b \U0001f600 é \x00"),
       (9, "same line here\n" * 50), (9, "same line here\n" * 50), (None, "no id at all in this row of text")]
