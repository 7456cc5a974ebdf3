"""Small tables with every awkward row there may be."""

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, sig string"


@pytest.fixture()
def documents(spark):
    """Makes ``documents`` from (doc_id, text) pairs, with columns that clash with
    the names operators use inside."""
    def make(rows, lang="en", source="s"):
        return spark.createDataFrame(
            [(i, t, lang, source, None if t is None else len(t), 7, "clash") for i, t in rows], DOCUMENTS)
    return make


@pytest.fixture()
def awkward():
    """Null and empty texts, null ids, ties, repeated rows, white space only, a long text."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
    return [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""),
            (None, "no id here at all, none"), (None, None), (4, " \t\n "), (5, "short"), (6, long),
            (7, "one two three four five six"), (8, "\U0001f600 é ñ ß 中文 text"), (9, "...!!!")]
